"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit halves.  Of two fingerprints that
differ in at most two bits, one half differs in at most one, so both share a
*variant* of that half with one position made a wildcard.  The variants are
indexed, equality-joined and the pairs verified on all 64 bits.

Only distinct fingerprints are indexed, by the smallest ``doc_id`` that has
them: a group of exact copies is one row however large it is.  A pair whose
half differs in exactly one bit meets under exactly one wildcard, because the
variant with the bit clear joins only the one with the bit set.  A pair whose
half is equal is found under a second cut of the other half into three pieces,
one of which must be equal too, so that a crowded half is split up again.

Defined cases: a null or empty text, or one of white space, has the zero
fingerprint, and is linked like any other; a repeated ``doc_id`` joins the
groups of all its rows; rows with a null ``doc_id`` get a fingerprint and a null
component; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from metricframe.llm.components import components
from metricframe.llm.storage import materialize

SHINGLE, SEED, REACH = 3, 42, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of bits that are summed at once, so that a long text takes bounded memory.
_ROWS = 1 << 15


def fingerprint_of(text: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer.

    >>> fingerprint_of(None), fingerprint_of(b" \\t")
    (0, 0)
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    hashes = np.array(
        [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)],
        dtype="<u8",
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint's bits as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [fingerprint_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(1).cast(pa.binary())]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        batches, "doc_id long, fp long"
    )


def _half(seg: int) -> F.Column:
    return (F.shiftrightunsigned("fp", 32) if seg else F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))


def links_between(reps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of distinct fingerprints ``(node, fp)`` at two differing bits or fewer."""
    bits = F.array(*[F.lit(i) for i in range(32)])
    wild, equal = [], []
    for seg in (0, 1):
        half, other = _half(seg), _half(1 - seg)
        wild.append(
            reps.withColumn("i", F.explode(bits)).select(
                (F.col("i") + 32 * seg).alias("slot"),
                half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i)"))).alias("value"),
                F.expr(f"(shiftrightunsigned(fp, i + {32 * seg}) & 1) = 1").alias("set"),
                "node",
                "fp",
            )
        )
        pieces = F.array(
            *[
                F.struct(F.lit(100 + 3 * seg + j).alias("slot"), F.expr(f"shiftright(other, {low}) & {(1 << wide) - 1}").alias("piece"))
                for j, (low, wide) in enumerate(((0, 11), (11, 11), (22, 10)))
            ]
        )
        equal.append(
            reps.withColumn("half", half).withColumn("other", other).withColumn("p", F.explode(pieces)).select(
                F.col("p.slot").alias("slot"), F.expr("half | shiftleft(p.piece, 32)").alias("value"), "node", "fp"
            )
        )
    wild_all, equal_all = wild[0].unionAll(wild[1]), equal[0].unionAll(equal[1])
    clear = wild_all.filter("not `set`").drop("set").unionAll(equal_all)
    there = wild_all.filter("`set`").drop("set").unionAll(equal_all)
    pairs = (
        clear.alias("l")
        .join(there.alias("r"), ["slot", "value"])
        .filter(f"bit_count(l.fp ^ r.fp) <= {REACH} and l.fp <> r.fp and (slot < 100 or l.fp < r.fp)")
    )
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: the smallest ``doc_id`` its links reach."""
    prints = materialize(fingerprints(docs, text, doc_id), "simhash")
    reps = prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    same = prints.join(reps, "fp").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    again = prints.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    # Exact copies hang on their representative, so they need no place in the contraction,
    # unless a repeated doc_id ties fingerprints together.
    tied = same.join(again.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")
    found = components(links_between(reps).unionAll(tied))
    nodes = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(nodes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group the smallest ``doc_id`` stays.

    Its rows stay once for each different text that they have.  Rows with a null
    ``doc_id`` cannot be grouped and stay.
    """
    groups = simhash_groups(docs, text, doc_id)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.join(kept, doc_id, "left_semi").dropDuplicates([doc_id, text]).select(*docs.columns)
    return named.unionByName(docs.filter(F.col(doc_id).isNull()))
