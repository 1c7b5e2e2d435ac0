"""Operators over pages."""

from __future__ import annotations

import random

import numpy as np
import pytest

from metricframe.llm import boosting, dom, extract, urlfilter
from metricframe.llm.entries import URL_RULES
from metricframe.llm.storage import importable
from tests.llm import brute

ODD = [
    None, "", "no scheme", "http://", "://x.com/a", "HTTP://Example.COM/en/", "https://example.com", "https://example.com?x=/en/", "https://example.com/en",
    "https://example.com/en/", "https://a.b.example.com/en/x#f", "https://www.example.com/en/1", "https://xexample.com/en/1", "https://net/es/", "https://a.net/fr/1",
    "https://com/", "https://com", "ftp://.com/", "http://example.com./en/", "http://a//b://c.com/", "https://WWW.EXAMPLE.com/EN/", "http://example-x.com/en/",
]


@pytest.fixture(scope="module")
def urls(spark):
    importable(spark)
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "b.example.com", "net", "x.net", "org", "example.org", "example.net"]
    made = [f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/', '/fr/', '/en', '/de/'])}{rng.choice(['', 'p', '?q', '#f'])}" for _ in range(400)]
    return list(enumerate(ODD + made + ["https://hot.example.com/en/1"] * 500))


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_url_rules(spark, urls, ranges):
    table = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    found = urlfilter.judge(table, URL_RULES, ranges=ranges).collect()
    assert len(found) == len(urls)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute.url_verdict(r["url"]), r["url"]


def test_url_rules_empty(spark, urls):
    table = spark.createDataFrame(urls, "page_id long, url string")
    none = urlfilter.judge(table, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {(r["rule"], r["verdict"]) for r in none.select("rule", "verdict").distinct().collect()} == {(None, "allow")}
    assert urlfilter.judge(table.limit(0), URL_RULES).count() == 0


def test_url_rules_of_many_depths(spark):
    rng = random.Random(5)
    labels = ["a", "b", "c-d", "com", "e"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 5)))
    rules = list({(host(), rng.choice(["/", "/x", "/x/y", ""])): rng.choice(["allow", "block"]) for _ in range(80)}.items())
    rows = [(i, f"http://{host()}{rng.choice(['', '/', '/x', '/x/y/z', '/q'])}") for i in range(500)]
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), [(h, p, v) for (h, p), v in rules], ranges=4).collect()
    for r in found:
        fits = [(h, p, v) for (h, p), v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fits, key=lambda x: (x[0].count("."), len(x[0]), len(x[1])), default=None)
        assert (r["rule"], r["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow")), r


# Main text.


@pytest.fixture(scope="module")
def model():
    return extract.trained()


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    fitted = boosting.fit(x[:1000], y[:1000], 3)
    assert (fitted.log_probabilities(x[1000:]).argmax(1) == y[1000:]).mean() > 0.85


def test_held_out_pages(model):
    rng, right, share = random.Random(77), 0, []
    for _ in range(150):
        page = dom.read(extract.made_up_page(rng))
        y = extract.labels(page)
        want = [t for t, k in zip(page.texts, y, strict=True) if t and k == extract.MAIN]
        got = extract.texts_of([page], model)[0]
        right += got == " ".join(want)
        a, b = set(got.split()), set(" ".join(want).split())
        share.append(2 * len(a & b) / max(1, len(a) + len(b)))
    assert right >= 125 and np.mean(share) > 0.96


def test_reader():
    page = dom.read("<p>a &amp; b<p>c<b>d</b>e<br>f<script>x</script><ul><li>g<li>h</ul>&copy;&nbsp;i<!-- j -->k</p><td>l")
    assert [t for t in page.texts if t] == ["a & b", "cde", "f", "g", "h", "© ik", "l"]
    for broken in ("<", "<p", "</", "<!--", "<a href='x", "<script>", "<div" * 500, "</p>" * 50, "<div>" * 3000, "<p a=\"'>x</p>", "\0<p>\0"):
        dom.read(broken)


def test_decoding_is_consistent(model):
    rng = random.Random(6)
    for _ in range(30):
        page = dom.read(extract.made_up_page(rng))
        logs = np.log(np.random.default_rng(rng.randint(0, 99)).dirichlet([1, 1, 1], len(page.tag)))
        keep = extract.decode(page, logs)
        assert len(keep) == len(page.tag)


ARTICLE = "<h1>Title here</h1><p>First &lt;part&gt; of it.</p><p>Second\n  part, with <a href=/x>a link</a>.</p>"
WANT = "Title here First <part> of it. Second part, with a link."


@pytest.mark.parametrize(
    "page",
    [
        "<html><body><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class=\"ad\">Buy this now.</div><article>{}</article><footer>&copy; x</footer></body></html>",
        "<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><main>{}</main><aside><p>More to read.</p></aside>",
        "<body><div class='cookie-notice'><p>We use cookies.</p></div><div id=content>{}</div><div id=comments><h3>Comments</h3><div class=comment><p>Nice.</p></div></div></body>",
    ],
)
def test_known_layouts(model, page):
    assert extract.texts_of([dom.read(page.format(ARTICLE))], model) == [WANT]


def test_extract_table(spark, model):
    importable(spark)
    long = "<article>" + "<p>word and word.</p>" * 20000 + "</article>"
    rows = [(1, None), (2, ""), (3, "<article><p>Only this.</p></article>"), (3, "<article><p>Only this.</p></article>"), (4, long), (5, "<nav>menu</nav>")]
    table = spark.createDataFrame([(i, h, "x", "y") for i, h in rows], "page_id long, html string, text string, n_chars string")
    found = extract.extract(table, model).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert by[1]["text"] == by[2]["text"] == "" and by[3]["text"] == "Only this." and by[4]["n_chars"] == 20000 * 15 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract.extract(table.limit(0), model).count() == 0
