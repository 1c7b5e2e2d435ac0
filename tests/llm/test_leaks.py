"""Decontamination as a table operator: blocks, ids, short items and clashing columns, against the edit distance of every pair."""

import random

import pytest

from metricframe.llm import decontaminate
from metricframe.llm.entries import importable
from tests.llm.test_recall import edited, prose


def corpus(rng, lengths, count=40):
    items = [(f"item{k}", prose(rng, rng.randint(*lengths))) for k in range(count)]
    rows = []
    for k, (_, text) in enumerate(items):
        for share in (0, 0.1, 0.18):
            rows.append((f"doc{len(rows)}", f"{prose(rng, 90)} {edited(rng, text, int(share * len(text)))} {prose(rng, 60)}"))
        rows.append((None if k % 4 == 0 else f"clean{k}", prose(rng, 200)))
    return items, [*rows, ("doc-null", None), ("doc-empty", ""), (None, f"{prose(rng, 50)} {items[0][1]} end")]


def every_pair(items, rows):
    """All (row, item) within the similarity, by the exact edit distance alone."""
    fold = lambda t: " ".join((t or "").lower().split()).encode()
    return {
        (i, name)
        for i, (_, body) in enumerate(rows)
        for name, text in items
        if decontaminate.edits_within(fold(text), fold(body), decontaminate.allowed(len(fold(text))))
    }


@pytest.mark.parametrize("lengths", [(20, 60), (64, 110), (120, 300)])
def test_results_equal_every_pair_and_do_not_depend_on_blocks(spark, lengths):
    importable(spark)
    items, rows = corpus(random.Random(lengths[0]), lengths)
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id string, text string, item_id string, similarity double")
    bench = spark.createDataFrame(items, "item_id string, text string")
    with_short = bench.unionAll(spark.createDataFrame([("short", "qqzz kkw"), ("none", None), ("blank", " \n")], bench.schema))
    found = [
        sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in decontaminate.leaks(table, b, block_bytes=size).collect())
        for b, size in ((bench, 1 << 20), (bench, 700), (with_short, 1 << 20))
    ]
    assert found[0] == found[1] == found[2]
    want = sorted((str(rows[i][0]), name) for i, name in every_pair(items, rows))
    got = [(d, k) for d, k, _ in found[0]]
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    for size in (1 << 20, 700):
        kept = decontaminate.without_leaks(table, bench, block_bytes=size)
        assert kept.columns == table.columns
        left = [r["text"] for r in kept.collect()]
        assert rows[-1][1] not in left and sum(t in (None, "") for t in left) == 2
        assert len(left) == len(rows) - len({i for i, _ in every_pair(items, rows)} - lost(rows, got, every_pair(items, rows)))


def lost(rows, got, pairs):
    named = {d for d, _ in got}
    return {i for i, _ in pairs if str(rows[i][0]) not in named}


def test_short_items_are_found_verbatim_between_words(spark):
    importable(spark)
    rows = [(1, "it says  Open\nSesame, twice"), (2, "reopen sesame"), (3, "open sesames"), (4, "open sesame"), (5, "opens same")]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(7, "open sesame")], "item_id int, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()) == [(1, 7, 0), (4, 7, 0)]
    assert dict(found.dtypes)["doc_id"] == "int"


def test_long_text_with_many_places(spark):
    importable(spark)
    rng = random.Random(2)
    item = prose(rng, 120)
    body = " ".join([prose(rng, 200_000), item, prose(rng, 200_000), " " * 50_000, item, *[item] * 300])
    table = spark.createDataFrame([(1, body), (1, body), (2, prose(rng, 1000))], "doc_id long, text string")
    found = decontaminate.leaks(table, spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found) == [(1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0)]
