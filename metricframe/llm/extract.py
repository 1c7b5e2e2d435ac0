"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

Each block element and each run of text of a page is a node.  Gradient-boosted trees
(:mod:`metricframe.llm.boosting`) give it the probabilities to be wholly main text,
wholly not, or mixed, from its tag, the words of its attributes and those of its
ancestors, its depth, the density of text and links in its subtree, its place in the
page and its siblings.  Decoding takes the most probable labelling of the whole tree
in which all below a main node is main and all below a dropped node is dropped; only
under a mixed node may children differ.  So no ancestor contradicts a descendant.

The trees are trained here, on :data:`TRAINING_PAGES` made-up pages of many layouts
whose nodes are labelled as they are made, once in each driver; no page of the data
is learnt from.

Text: references decoded, white space in a block to one space, blocks joined by one
space in page order.  Defined cases: null or empty html, and a page without text,
give the empty text; markup may be broken in any way; rows that repeat give equal
results; an empty table gives an empty result; columns named like the new ones are
replaced, others pass through.  Pages of any length are read whole.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metricframe.llm.boosting import Boosted, fit
from metricframe.llm.dom import Page, features, read

MAIN, DROP, MIXED = range(3)
TRAINING_PAGES, SEED = 600, 5
#: Characters of html that are taken together.
LOT = 1 << 21


def decode(page: Page, logs: np.ndarray) -> list[bool]:
    """Whether each node's text is main, by dynamic programming over the tree.

    ``logs`` are log probabilities, nodes x (main, drop, mixed).
    """
    n = len(page.tag)
    values, parents, texts = logs.tolist(), page.parent, page.texts
    main, drop, mixed = ([row[k] for row in values] for k in range(3))
    filled = [t is not None for t in texts]
    for i in range(n - 1, -1, -1):
        up = parents[i]
        if texts[i] is not None:
            mixed[i] = -1e18  # a run of text is one or the other
        elif not filled[i]:
            main[i] = drop[i] = mixed[i] = 0.0  # no text: any label does
        if up >= 0:
            main[up] += main[i]
            drop[up] += drop[i]
            mixed[up] += max(main[i], drop[i], mixed[i])
            filled[up] = filled[up] or filled[i]
    keep = [False] * n
    fixed: list[bool | None] = [None] * n  # what an ancestor has settled
    for i in range(n):
        up = parents[i]
        if up >= 0 and fixed[up] is not None:
            fixed[i] = fixed[up]
        elif mixed[i] < max(main[i], drop[i]):
            fixed[i] = main[i] >= drop[i]
        keep[i] = bool(fixed[i])
    return keep


def texts_of(pages: list[Page], model: Boosted) -> list[str]:
    """The main text of each page."""
    if not any(p.tag for p in pages):
        return [""] * len(pages)
    logs, at, out = model.log_probabilities(features(pages)[0]), 0, []
    for page in pages:
        keep = decode(page, logs[at : at + len(page.tag)])
        at += len(page.tag)
        out.append(" ".join(t for t, k in zip(page.texts, keep, strict=True) if t and k))
    return out


def labels(page: Page) -> np.ndarray:
    """The labels of a made-up page's nodes, -1 where there is no text: runs under the nearest ``data-main`` mark."""
    n = len(page.tag)
    main, length = np.zeros(n), np.zeros(n)
    marked = [False] * n
    for i in range(n):
        inherited = marked[page.parent[i]] if page.parent[i] >= 0 else False
        marked[i] = 'data-main="1"' in page.marks[i] or (inherited and 'data-main="0"' not in page.marks[i])
        if page.texts[i]:
            length[i], main[i] = 1, marked[i]
    for i in range(n - 1, -1, -1):
        if page.parent[i] >= 0:
            length[page.parent[i]] += length[i]
            main[page.parent[i]] += main[i]
    return np.where(length == 0, -1, np.where(main == length, MAIN, np.where(main == 0, DROP, MIXED)))


def made_up_page(rng: random.Random) -> str:
    """A page of a random layout, its main text marked."""
    syllables = ["ka", "lo", "mi", "ter", "an", "sel", "vo", "ri", "den", "pu", "zai", "el", "or", "ti", "né", "stö"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(low: int, high: int) -> str:
        return " ".join(words(1, 16).capitalize() + rng.choice(".....!?") for _ in range(rng.randint(low, high)))

    def attr(*names: str) -> str:
        how, name = rng.random(), rng.choice(names)
        if how < 0.35:
            return ""
        prefix = rng.choice(["", "", "site-", "page-", "main-", "the-", "js-"])
        return f' {rng.choice(["class", "class", "id"])}="{prefix}{name}{rng.choice(["", "", " clearfix", "-1", " box"])}"'

    link = lambda text: f'<a href="/{word()}">{text}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def box(tag: str, inside: str, *names: str) -> str:
        real = tag if rng.random() < 0.7 else "div"
        named = attr(*names) if real == tag else f' class="{rng.choice(names)}"'
        return f"<{real}{named}>{inside}</{real}>"

    def menu() -> str:
        return box("nav", links(2, 12) if rng.random() < 0.8 else " | ".join(link(words(1, 2)) for _ in range(6)), "nav", "menu", "navbar", "breadcrumbs")

    def advert() -> str:
        body = rng.choice([prose(1, 3), link(words(3, 9)), f"<p>{prose(1, 2)}</p>", f"<h4>{words(1, 3)}</h4><p>{prose(1, 2)} {link(word())}</p>"])
        return f'<div data-main="0" class="{rng.choice(["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "ad-box", "advertisement"])}">{body}</div>'

    def notice() -> str:
        kind = rng.choice(["cookie-notice", "consent", "notice", "alert", "gdpr-banner", "announcement"])
        return f'<div data-main="0" class="{kind}"><p>{prose(1, 3)}</p>{rng.choice(["", "<button>" + word() + "</button>"])}</div>'

    def form() -> str:
        fields = "".join(f"<label>{words(1, 2)}</label><input name=x>" for _ in range(rng.randint(1, 4)))
        return f'<form data-main="0"{attr("newsletter", "subscribe", "search", "login")}><p>{words(2, 9)}</p>{fields}<button>{word()}</button></form>'

    def side() -> str:
        blocks = [f"<h3>{words(1, 3)}</h3>{links(2, 6)}", f"<p>{prose(1, 3)}</p>", advert(), f"<div class=widget>{links(1, 5)}</div>"]
        return box("aside", "".join(rng.sample(blocks, rng.randint(1, 3))), "sidebar", "widget", "related", "rail")

    def comments() -> str:
        each = lambda: f'<div class="{rng.choice(["comment", "reply", "c"])}"><b>{word()}</b><p>{prose(1, 4)}</p></div>'
        return f'<{(t := rng.choice(["section", "div", "div"]))} data-main="0" {rng.choice(["id", "class"])}="{rng.choice(["comments", "discussion", "comment-list", "respond"])}"><h3>{words(1, 2)}</h3>{"".join(each() for _ in range(rng.randint(1, 6)))}</{t}>'

    def head() -> str:
        return box("header", rng.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 5)}</p>", link(word())]) + rng.choice(["", menu(), f"<p>{words(2, 6)}</p>"]), "header", "masthead", "topbar")

    def foot() -> str:
        inside = rng.choice([f"&copy; {word()}.example.com &middot; {prose(1, 2)}", f"<p>&copy; {words(1, 5)}</p>{links(1, 6)}", f"<p>{prose(1, 3)}</p>"])
        return box("footer", inside, "footer", "bottom", "copyright", "colophon")

    def paragraph() -> str:
        how = rng.random()
        body = prose(1, rng.choice([1, 2, 5, 12]))
        if how < 0.08:
            body = f"<b>{body}<br>" if rng.random() < 0.5 else f"<b>{body}</b>"
            return f"<p>{body}"
        if how < 0.14:
            return f"<h2>{words(1, 6)}</h2>"
        if how < 0.2:
            return "<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if how < 0.24:
            return f"<blockquote><p>{body}</p></blockquote>"
        if how < 0.27:
            return "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if how < 0.4:
            body = body.replace(" ", " " + link(words(1, 2)) + " ", 1)
        return rng.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<div>{body}</div>"])

    heading = rng.choice([f"<h1>{words(2, 10)}</h1>", f"<h1>{words(2, 10)}</h1>", f"<header><h1>{words(2, 8)}</h1></header>", ""])
    inner = [paragraph() for _ in range(rng.choice([1, 1, 2, 4, 8, 16, 30]))]
    for extra, chance in ((advert, 0.25), (form, 0.12), (side, 0.1), (comments, 0.15), (notice, 0.2)):
        if rng.random() < chance:
            block = extra()
            block = block if 'data-main="0"' in block[:60] else f'<div data-main="0">{block}</div>'
            inner.insert(len(inner) if extra is comments else rng.randint(0, len(inner)), block)
    body = heading + "".join(inner)
    how = rng.random()
    if how < 0.5:
        body = f'<article data-main="1">{body}</article>'
    elif how < 0.65:
        body = f'<main data-main="1">{body}</main>'
    else:
        name = rng.choice(["content", "post", "entry-content", "story", "article-body", "main", "text", "article"])
        body = f'<div data-main="1" {rng.choice(["id", "class"])}="{name}">{body}</div>'
    after = [comments()] if rng.random() < 0.2 else []
    around = [menu(), advert(), notice(), side(), form(), head()]
    before = [x for x, chance in zip(around, (0.8, 0.5, 0.25, 0.15, 0.15, 0.45), strict=True) if rng.random() < chance]
    after += [x() for x, chance in ((side, 0.3), (advert, 0.2), (form, 0.1), (menu, 0.1)) if rng.random() < chance]
    if rng.random() < 0.5:
        rng.shuffle(before)
    middle = body + "".join(after)
    if rng.random() < 0.35:
        wrap = rng.choice(["wrapper", "container", "page", "layout", "site"])
        middle = f"<div class={wrap}>{middle}</div>" if rng.random() < 0.6 else f"<div id={wrap}><div>{middle}</div></div>"
    tail = foot() if rng.random() < 0.85 else ""
    ending = rng.choice(["</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{''.join(before)}{middle}{tail}{ending}"


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    """The trees, trained on so many made-up pages."""
    rng = random.Random(seed)
    made = [read(made_up_page(rng)) for _ in range(pages)]
    y = np.concatenate([labels(p) for p in made])
    return fit(features(made)[0][y >= 0], y[y >= 0], 3, rounds=30, depth=5, rate=0.2)


def extract(df: DataFrame, model: Boosted | None = None, html: str = "html") -> DataFrame:
    """``df`` with ``text`` and ``n_chars`` in place of ``html``."""
    model = model or trained()
    kept = [f for f in df.schema.fields if f.name != html and f.name.lower() not in ("text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            source = part.column(part.schema.get_field_index(html))
            lot: list[Page] = []
            found: list[str] = []
            size = 0
            for value in source:
                body = value.as_py() or ""
                lot.append(read(body))
                size += len(body)
                if size >= LOT:
                    found += texts_of(lot, model)
                    lot, size = [], 0
            found += texts_of(lot, model)
            arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.mapInArrow(batches, schema)
