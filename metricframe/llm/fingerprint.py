"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is the set of its paragraphs (pieces between line ends and full stops),
each a 64-bit digest.  A sketch has three tables of cells; a digest is added to
one cell of each table, which holds a count, the XOR of its digests and the XOR
of their checks.  One family of sketches serves all: the published fingerprint has tables of
:data:`PRINT_WIDTH` cells, and twice as wide ones refine it, two cells for each, so that a wider
sketch folded is the fingerprint.

Two versions are compared by their sketches.  The published ones are subtracted first: the
squares of the counts that are left estimate how many digests differ.  Sketches with
:data:`CELLS` cells for each of these are then made of both versions and subtracted cell by
cell, so that common paragraphs vanish.  A cell with a count of one or minus one whose
check fits its digest is *pure*: the digest is one that only one version has.
Peeling notes it and takes it out of its other cells, which makes more cells pure,
until none are left; what cannot be peeled, as more differed than was expected, is retried
with sketches :data:`RETRY` times as wide.  Likeness is the Jaccard index of the paragraph sets,
whose sizes the counts give and whose difference has been recovered.

Rows are spread by ranges of ``doc_id`` and, among equal or null ones, of the hash of their
text; a text moves once.  The next document is found by a window within its range, and the
first document of each range is also sent to the range before it, so no sort is global.  All
cell sums stay within their range's partition, where peeling runs as alternating flat-maps and
sums: no further exchange, and nothing that depends on a document's length in one row.

Defined cases: a null text is the empty text, whose one paragraph is empty; null
``doc_id`` come last; rows that repeat a ``doc_id`` are in order of their text's hash;
of a single row the next is itself; an empty table gives an empty result; further
columns are ignored; ``doc_id`` is a whole number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricframe.llm.storage import materialize
from metricframe.llm.urlfilter import _range_of

TABLES, PRINT_WIDTH = 3, 4
PRINT_CELLS = TABLES * PRINT_WIDTH
#: Cells for each digest that is expected to differ, and what a retry multiplies them by.
CELLS, RETRY = 2, 4
#: Sweeps over the tables in which a comparison peels; what is left then is retried.
SWEEPS = 2
#: Ranges for each shuffle partition: the cells of a range are many times its texts' digests.
RANGES = 4
_MOST = 2**63 - 1


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    pieces = F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n", -1)
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(1), digest)


def _cell(table: int | Column, digest: Column, width: Column | int) -> Column:
    """A digest's place in a table.  Widths are powers of two: a wider sketch, folded, is the narrower one."""
    return F.pmod(F.xxhash64(F.lit(10) + table, digest), F.lit(width) if isinstance(width, int) else width).cast("int")


def small_sketch(digests: Column) -> Column:
    """The published sketch: an array of count, XOR of digests and XOR of checks of each cell.

    Each digest is hashed once for a table, and each cell's digests are picked once: an
    expression that is named by a function's argument is evaluated once, one that is repeated
    may be evaluated every time.
    """
    hashed = F.transform(
        digests,
        lambda d: F.struct(d.alias("digest"), _check(d).alias("check"), *[_cell(t, d, PRINT_WIDTH).alias(f"place{t}") for t in range(TABLES)]),
    )

    def cell(mine: Column) -> Column:
        xor = lambda name: F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[name]))
        return F.struct(F.size(mine).alias("n"), xor("digest").alias("digest"), xor("check").alias("check"))

    def picked(held: Column, table: int, place: int) -> Column:
        return F.filter(held, lambda x: x[f"place{table}"] == place)

    def cells(held: Column) -> Column:
        return F.transform(F.array(*[picked(held, t, p) for t in range(TABLES) for p in range(PRINT_WIDTH)]), cell)

    return F.transform(F.array(hashed), cells)[0]


def sketch_text(sketch: Column) -> Column:
    """The published sketch as text: 8, 16 and 16 hexadecimal digits of count, digests and checks a cell."""
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.lower(F.array_join(F.transform(sketch, lambda c: F.concat(hexed(c["n"], 8), hexed(c["digest"], 16), hexed(c["check"], 16))), ""))


def expected_difference(a: Column, b: Column) -> Column:
    """How many digests two published sketches differ in, estimated from the second moment of their subtracted counts.

    In a table of ``w`` cells the expected sum of squares is ``d + (s * s - d) / w`` for ``d``
    differing digests, ``s`` being the difference of the texts' numbers of digests.
    """
    counts = F.zip_with(a, b, lambda x, y: x["n"] - y["n"])
    squares = F.aggregate(counts, F.lit(0).cast("double"), lambda t, n: t + n * n) / TABLES
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda t, n: t + n) / TABLES
    return F.greatest((squares - total * total / PRINT_WIDTH) / (1 - 1 / PRINT_WIDTH), F.abs(total), F.lit(2.0))


def _next_texts(docs: DataFrame, text: str, doc_id: str, ranges: int) -> DataFrame:
    """``(range, rn, doc_id, text, next_text)``: in descending ``doc_id``, the first follows the last."""
    body = F.coalesce(F.col(text), F.lit(""))
    # All that is read from a range's partition is the same columns, so that one exchange serves every reader.
    base = docs.select(
        F.col(doc_id).isNotNull().alias("named"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("key"),
        F.shiftrightunsigned(F.xxhash64(body), 1).alias("tie"),
        body.alias("text"),
    )
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    code = F.concat(F.when(F.col("named"), "0").otherwise("1"), digits(F.col("key").bitwiseXOR(F.lit(_MOST))), digits(F.col("tie")))
    coded = base.withColumn("code", code)
    # One row a range.  Rows of one doc_id, or without one, are spread by the hash of their text.
    bounds = sorted(r["code"] for r in coded.select("code").repartitionByRange(ranges, "code").groupBy(F.spark_partition_id()).agg(F.min("code").alias("code")).collect())
    # A range is never null, so that no join adds a filter to one reader of the exchange only.
    rows = coded.withColumn("range", F.coalesce(_range_of(F.col("code"), bounds[1:]), F.lit(0))).withColumn("guest", F.lit(0))
    if bounds:
        # The first row of a range also ends the range before it; that of the first ends the last.
        first = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("range"))
        guests = rows.filter(F.col("code") == first).withColumn("range", F.coalesce(F.pmod(F.col("range") - 1, F.lit(len(bounds))), F.lit(0))).withColumn("guest", F.lit(1))
        rows = rows.unionByName(guests)
    order = Window.partitionBy("range").orderBy("guest", F.desc("named"), F.desc("key"), "tie", "text")
    spread = rows.drop("code").repartition(ranges, "range")
    led = spread.withColumn("rn", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    return led.filter("guest = 0").select("range", "rn", F.when(F.col("named"), F.col("key")).alias("doc_id"), "text", "next_text")


def _cells(versions: DataFrame) -> DataFrame:
    """The three sketches of each row, a row a place that any uses: counts ``n0`` to ``n2``, XORs ``digest0`` and so on, ``check0`` and so on.

    Sketch 0 is that of ``a``, 1 that of ``b0`` and 2 that of ``b1``; ``versions`` has ``range``, ``rn``, ``width`` and these.
    """

    def of(version: int, digests: str) -> Column:
        return F.transform(digests, lambda d: F.struct(F.lit(version).alias("version"), d.alias("digest")))

    row = ["range", "rn", "width"]
    held = versions.select(*row, F.explode(F.concat(of(0, "a"), of(1, "b0"), of(2, "b1"))).alias("x")).select(*row, "x.*")
    digest, width = F.col("digest"), F.col("width")
    places = [F.struct(F.lit(t).alias("table"), _cell(t, digest, width).alias("place")) for t in range(TABLES)]
    placed = held.select(*row, "version", "digest", _check(digest).alias("check"), F.inline(F.array(*places)))
    sums = []
    for v in range(3):
        mine = lambda x, v=v: F.when(F.col("version") == v, x).otherwise(F.lit(0).cast("long"))
        sums += [F.sum(mine(F.lit(1).cast("long"))).alias(f"n{v}"), F.bit_xor(mine(digest)).alias(f"digest{v}"), F.bit_xor(mine(F.col("check"))).alias(f"check{v}")]
    return placed.groupBy(*row, "table", "place").agg(*sums)


def _compared(versions: DataFrame) -> DataFrame:
    """``(range, rn, pair, plus, minus, left)`` of the pairs ``a`` and ``b0`` (0), ``a`` and ``b1`` (1).

    The second sketch is subtracted from the first cell by cell.  ``plus`` and ``minus``
    are the numbers of recovered digests that only the first and only the second version
    has, ``left`` that of the cells that could not be peeled.
    """
    keys = ["range", "rn", "width", "pair", "table", "place"]

    def entry(table: Column, place: Column, n: Column, digest: Column, check: Column) -> Column:
        return F.struct(
            table.cast("int").alias("table"), place.alias("place"), n.alias("n"), digest.alias("digest"), check.alias("check")
        )

    used = "n <> 0 or digest <> 0 or check <> 0"

    def subtracted(i: int) -> Column:
        xor = lambda x: F.col(f"{x}0").bitwiseXOR(F.col(f"{x}{i + 1}")).alias(x)
        return F.struct(F.lit(i).alias("pair"), (F.col("n0") - F.col(f"n{i + 1}")).alias("n"), xor("digest"), xor("check"))

    sketches = _cells(versions)
    cells = sketches.select("range", "rn", "width", "table", "place", F.inline(F.array(subtracted(0), subtracted(1)))).filter(used)
    digest, width = F.col("digest"), F.col("width")
    zero = F.lit(0).cast("long")
    for table in [t for _ in range(SWEEPS) for t in range(TABLES)]:
        # A digest is in one cell of a table, so that taking one table at a time notes none twice.
        pure = (F.col("table") == table) & (F.abs("n") == 1) & (F.col("check") == _check(digest))
        out = [entry(F.lit(t), _cell(t, digest, width), -F.col("n"), digest, F.col("check")) for t in range(TABLES) if t != table]
        noted = entry(F.when(F.col("n") > 0, TABLES).otherwise(TABLES + 1), F.lit(0), F.lit(1).cast("long"), zero, zero)
        same = entry(F.col("table"), F.col("place"), F.col("n"), digest, F.col("check"))
        entries = F.when(pure, F.array(*out, noted)).otherwise(F.array(same))
        peeled = cells.select("range", "rn", "width", "pair", F.explode(entries).alias("e")).select("range", "rn", "width", "pair", "e.*")
        sums = [F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check")]
        cells = peeled.groupBy(*keys).agg(*sums).filter(used)
    tally = lambda t: F.sum(F.when(F.col("table") == t, F.col("n")).otherwise(0))
    return cells.groupBy("range", "rn", "pair").agg(
        tally(TABLES).alias("plus"),
        tally(TABLES + 1).alias("minus"),
        F.sum(F.when(F.col("table") < TABLES, 1).otherwise(0)).alias("left"),
    )


def _side(compared: DataFrame, sides: int) -> DataFrame:
    """One row for each ``(range, rn)``: the differing digests of each pair, and whether one is left unpeeled."""
    made = []
    for i in range(sides):
        of = F.col("pair") == i
        made.append(F.sum(F.when(of, F.col("plus") + F.col("minus")).otherwise(0)).alias(f"d{i}"))
    return compared.groupBy("range", "rn").agg(*made, F.max(F.col("left") > 0).alias("failed"))


def _likeness(a: str, b: str, d: Column) -> Column:
    return (F.size(a) + F.size(b) - d) / (F.size(a) + F.size(b) + d)


def _settle(base: DataFrame, label: str) -> DataFrame:
    """``base`` with the likenesses of ``a`` to ``b0`` and ``b1``; digests stay only with rows that failed."""
    spark: SparkSession = base.sparkSession
    # Both sides of the join lie in the same partitions by range, which is part of its key.
    conf, was = "spark.sql.requireAllClusterKeysForCoPartition", None
    was = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        diff = _side(_compared(base.select("range", "rn", "width", "a", "b0", "b1")), 2)
        joined = base.join(diff, ["range", "rn"], "left")
        failed = F.coalesce("failed", F.lit(False))
        near = [_likeness("a", f"b{i}", F.coalesce(f"d{i}", F.lit(0))).alias(f"near{i}") for i in (0, 1)]
        keep = [F.when(failed, F.col(c)).alias(c) for c in ("a", "b0", "b1")]
        rest = [c for c in base.columns if c not in ("a", "b0", "b1")]
        return materialize(joined.select(*rest, *near, failed.alias("failed"), *keep), label)
    finally:
        spark.conf.set(conf, was)


def compare_versions(base: DataFrame) -> DataFrame:
    """``(range, rn, width, a, b0, b1, ...)`` to ``near0``, ``near1`` and the other columns, retrying larger until all is peeled."""
    done = []
    while True:
        settled = _settle(base, "fingerprints")
        done.append(settled.filter("not failed").drop("failed", "width", "a", "b0", "b1"))
        left = settled.filter("failed")
        if left.isEmpty():
            break
        again = left.drop("failed", "near0", "near1").withColumn("width", F.col("width") * RETRY)
        base = again.repartition(F.col("range"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def fingerprint_versions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses.

    The edited text has its last half (rounded down) replaced by as many first code
    points of the next document in descending ``doc_id``.  Gives ``doc_id``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.
    """
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = _next_texts(docs, text, doc_id, ranges)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    base = (
        led.withColumn("edited", edited)
        .select(
            "range",
            "rn",
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            paragraphs(F.col("text")).alias("a"),
            paragraphs(F.col("edited")).alias("b0"),
            paragraphs(F.col("next_text")).alias("b1"),
        )
        .withColumns({f"s{c}": small_sketch(F.col(c)) for c in ("a", "b0", "b1")})
    )
    expected = F.greatest(expected_difference(F.col("sa"), F.col("sb0")), expected_difference(F.col("sa"), F.col("sb1")))
    # The published width is doubled until there are cells enough.
    doubled = F.ceil(F.log2(expected * CELLS / PRINT_CELLS))
    width = (F.lit(PRINT_WIDTH) * F.pow(F.lit(2), F.greatest(doubled, F.lit(0)))).cast("long")
    sketched = base.withColumn("width", width).withColumn("fingerprint", sketch_text(F.col("sa"))).withColumn("edited_fingerprint", sketch_text(F.col("sb0")))
    return compare_versions(sketched.drop("sa", "sb0", "sb1")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        F.col("near0").alias("near_edited"),
        F.col("near1").alias("near_next"),
    )
