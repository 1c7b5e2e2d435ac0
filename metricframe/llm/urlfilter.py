"""URL rules by a sort-merge range join, with DataFrame functions only.

A host is keyed by its labels in reverse, each closed by a dot: ``www.example.com``
is ``com.example.www.``.  A rule's host and all its subdomains are then the keys
with the rule's key as prefix, the interval from ``com.example.`` up to
``com.example/`` (``/`` follows ``.``).  Such intervals nest or are disjoint.

Urls and the rules' begin and end events are sorted together and swept once.  The
sweep's stack has one slot for each depth (number of labels): a begin event fills
its depth's slot with the host's path rules, the end event clears it, so at any
key the filled slots are the nested rules in force.  From the deepest slot on, the
first path rule that the url's path starts with decides; in a slot the longest
path goes first.  As the deepest host wins before the longest path, a rule for a
subdomain always beats one for its parent.

The sweep is cut into key ranges.  Their bounds come from Spark's own range
partitioning of the distinct keys with their counts; an interval puts its begin
event into every range that it reaches into.  A range with more rows than its
share, such as one hot host, is salted into several sweeps, each with all events
of the range; rows take turns, so equal ones are spread too, and as a salt changes no
result, rows that a lost executor made again may get others.  No task ever holds more than its share of urls, and the driver
gets one key and count a range.

Defined cases: a null url, or one without ``://``, has an empty host and path and
meets no rule; a host's trailing or repeated dots are labels of no characters;
ties and repeated rows are judged alike, each by itself; a rule given twice
counts once, and of contradicting ones for the same host and path block wins;
a rule without a host fits nothing;
without rules every url gets the default; an empty table gives an empty result;
columns named like the new ones are replaced, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricframe.llm.storage import materialize

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above this multiple of a range's fair share of rows it is salted.
FAIR = 2


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: Column) -> Column:
    """The labels in reverse, each closed by a dot; nothing for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _range_of(key: Column, bounds: Sequence[str]) -> Column:
    """The number of the sorted bounds that are not above the key, in two looks: among every so many bounds, then between two of them."""
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds) - 1) + 1
    lists = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    under = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = under(F.array(*[F.lit(x[0]) for x in lists]))
    fine = F.array(*[F.array(*[F.lit(b) for b in x]) for x in lists])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * wide + under(F.element_at(fine, F.greatest(coarse, F.lit(1)))))


def judge(
    urls: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]],
    url: str = "url",
    default: str = ALLOW,
    ranges: int | None = None,
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (host, path, verdict) rows, of any number.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    new = {"host", "path", "rule", "verdict"}
    kept = [c for c in urls.columns if c.lower() not in new]
    host, path = split_url(F.col(url))
    parsed = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path")).withColumn(
        "key", host_key(F.col("host"))
    )

    one = rules.filter("host <> ''").groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    entry = F.struct(
        F.length("path").alias("n"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")
    )
    by_host = one.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("entries"))
    by_host = materialize(
        by_host.withColumn("key", host_key(F.col("host"))).withColumn("depth", F.size(F.split("host", r"\."))).select("key", "depth", "entries"),
        "url-rules",
    )
    depths = [r[0] for r in by_host.select("depth").distinct().collect()]  # a host has 127 labels at most

    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = parsed.groupBy("key").count().repartitionByRange(ranges, "key")
    shares = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"), F.sum("count").alias("n")).collect()
    shares.sort(key=lambda r: r["key"])  # one row a range
    bounds = [r["key"] for r in shares[1:]]
    fair = max(1, sum(r["n"] for r in shares) // ranges)
    salts = [1 if r["n"] <= FAIR * fair else -(-r["n"] // fair) for r in shares] or [1]

    def salted(number: Column) -> Column:
        more = {i: n for i, n in enumerate(salts) if n > 1}
        return F.coalesce(*[F.when(number == i, F.lit(n)) for i, n in more.items()], F.lit(1))

    rows = parsed.withColumn("range", _range_of(F.col("key"), bounds)).select(
        "range",
        F.pmod(F.monotonically_increasing_id(), salted(F.col("range"))).cast("int").alias("salt"),
        "key",
        F.lit(1).alias("turn"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast(by_host.schema["entries"].dataType).alias("entries"),
        "row",
        "host",
        "path",
    )
    stop = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    reach = by_host.withColumn("first", _range_of(F.col("key"), bounds)).withColumn("last", _range_of(stop, bounds))
    nothing = [F.lit(None).cast(parsed.schema[c].dataType).alias(c) for c in ("row", "host", "path")]
    events = (
        reach.withColumn("range", F.explode(F.expr("sequence(first, last)")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salted(F.col("range")) - 1)))
        .withColumn("end", F.explode(F.array(F.lit(False), F.lit(True))))
        .filter("not end or range = last")
        .select(
            "range",
            "salt",
            F.when(F.col("end"), stop).otherwise(F.col("key")).alias("key"),
            F.lit(0).alias("turn"),
            "depth",
            F.when(~F.col("end"), F.col("entries")).alias("entries"),
            *nothing,
        )
    )
    sweep = Window.partitionBy("range", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    # An end event has no entries; its slot must hold that, so the value is wrapped.
    slots = {
        d: F.last(F.when(F.col("depth") == d, F.struct("entries")), ignorenulls=True).over(sweep)["entries"] for d in depths
    }
    swept = rows.unionAll(events)
    for d, slot in slots.items():
        swept = swept.withColumn(f"slot_{d}", slot)
    fits = [
        F.get(F.filter(f"slot_{d}", lambda e: F.startswith(F.col("path"), e["path"])), F.lit(0))
        for d in sorted(depths, reverse=True)
    ]
    judged = swept.filter("turn = 1")
    best = F.coalesce(*fits) if fits else None
    if best is None:
        judged = judged.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    else:
        judged = judged.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn(
            "verdict", F.coalesce("best.verdict", F.lit(default))
        )
    return judged.select("row.*", "host", "path", "rule", "verdict") if kept else judged.select("host", "path", "rule", "verdict")
