"""Repeats in texts that are made of shared clauses, where a suffix's nearest neighbours are not all its matches."""

import random

import pytest

from metricframe.llm import suffixes
from metricframe.llm.entries import importable
from tests.llm.test_documents import _repeated


def spans(found):
    return {r["doc_id"]: {x for s in r["spans"] for x in range(s["start"], s["end"])} for r in found.collect()}


def shared_clauses():
    rng = random.Random(3)
    clauses = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(8, 25))) for _ in range(60)]
    weights = [1 / k for k in range(1, 61)]
    return [(i, " ".join(rng.choices(clauses, weights, k=18))) for i in range(400)]


@pytest.mark.parametrize(("partitions", "block"), [(1, suffixes.BLOCK), (3, 40), (50, 7)])
def test_repeats_of_shared_clauses(spark, partitions, block):
    importable(spark)
    rows = shared_clauses()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = spans(suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=block))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == dict(_repeated(rows))


def test_left_core_and_right_with_different_partners(spark):
    """A core of 30 words whose texts share 15 words on the left with some and 15 on the right with others."""
    importable(spark)
    rng = random.Random(9)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    core, lefts, rights = words(30), [words(20) for _ in range(12)], [words(20) for _ in range(12)]
    rows = [(i, f"{words(5)} {rng.choice(lefts)} {core} {rng.choice(rights)} {words(5)}") for i in range(300)]
    rows += [(1000, " ".join(core for _ in range(700))), (1001, words(40_000)), (1002, None)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, other int")
    for block in (suffixes.BLOCK, 20):
        assert spans(suffixes.repeats(table, block=block)) == dict(_repeated(rows))
