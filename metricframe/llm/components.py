"""Connected components of a link table, entirely on the executors.

Alternates the large-star and small-star contractions (Kiveris et al., 2014):
both are one aggregate and one join over the links, a hub never gathers its
neighbours in one row, and the number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricframe.llm.storage import materialize, release


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    around = _both_ways(links)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links between long ids to ``(node, component)``, the smallest id reachable.

    Nodes without links do not appear.  Loops, repeated links and nulls are
    ignored; an empty table gives an empty result.
    """
    now = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), "links")
        release(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
