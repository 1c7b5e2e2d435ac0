"""Repeated passages through a sparse suffix array.

Texts are words, A-Z lower-cased.  Of a text's suffixes those are retained that
start at a minimiser: where the hash of the next :data:`GRAM` words is the least of
:data:`NEAR` consecutive ones.  Any passage of ``GRAM + NEAR - 1`` = :data:`LEAST`
words or more holds such a place, at the same words wherever the passage is.

Suffixes whose first ``GRAM`` words occur only once can match nothing and go.  The
others are sorted, range-partitioned, by their next :data:`LEAST` words, and each is
compared with its neighbour: that gives the words that they share on their right.
Suffixes that share ``LEAST - l`` words or more to the right are a stretch of the order;
of a stretch those match that also share the ``l`` words before them, for every ``l`` up to
``NEAR - 1``.  So each match is extended to the right and to the left until it has ``LEAST``
words, with whichever partner, not only the nearest.  Longer passages are covered by
their further suffixes, as another one follows within ``NEAR`` words.

Only suffixes with the same first ``GRAM`` words, a *run* of the order, can match.  A run is
settled in memory with others, :data:`BLOCK` suffixes at a time.  Runs that a partition's
bounds may cut, and those of more suffixes, are settled in pieces; of each piece every
different stretch of ``LEAST`` words about its suffixes is sent on once, by its hash, and
those that two pieces share are matches too.  So a group of copies, however large, is cut
freely, and what is found does not depend on the partitions.

Defined cases: null, empty and shorter texts hold no passage; a text may repeat a
passage of its own, also one that overlaps it; rows that are equal in ``doc_id`` and
text are one text met twice; an empty table gives an empty result; further columns
are ignored; ``doc_id`` is a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricframe.llm.storage import materialize, release, small_batches
from metricframe.llm.textbuf import LOWER, SPACES, lots, minimisers, mix, shingles, words

LEAST, GRAM = 50, 20
NEAR = LEAST - GRAM + 1
LEFT = NEAR - 1
#: Suffixes that are settled together; a run of more is cut.
BLOCK = 16_000
#: Bytes of texts whose words are hashed together, with several arrays of eight bytes for each.
LOT = 1 << 17
_SEED = "key long, row long, pos int"
_SUFFIX = "row long, doc_id long, pos int, right binary, left binary"
_SPAN = "row long, doc_id long, start int, end int, other long"
#: A span, or with a hash the stretch of words that starts at ``start``; its ``row`` is null if the piece has it twice.
_FOUND = f"hash long, {_SPAN}"
_ODD = np.random.default_rng(50).integers(1, 2**63, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(
        F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).filter("text is not null")


def seeds(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(key, row, pos)``: the hash of the next words at each retained suffix."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = part.column(0).to_numpy(zero_copy_only=False)
            for first, last, raw, offsets in lots(part.column(1), LOT):
                hashes, _, _, begin = words(raw, offsets, LOWER, SPACES)
                if not len(hashes):
                    continue
                keys, whole = shingles(hashes, begin, GRAM)
                keys[~whole] = np.uint64(2**64 - 1)
                lengths = np.diff(begin)
                long_enough = np.repeat(lengths >= LEAST, lengths)
                at = np.flatnonzero(minimisers(keys, NEAR) & whole & long_enough)
                text = np.searchsorted(begin, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at].view(np.int64)),
                        pa.array(rows[first:last][text]),
                        pa.array((at - begin[text]).astype(np.int32)),
                    ],
                    names=["key", "row", "pos"],
                )

    return _keyed(docs, text, doc_id).select("row", "text").mapInArrow(batches, _SEED)


def _contexts(placed: DataFrame) -> DataFrame:
    """``(row, doc_id, text, places)`` to the suffixes at the places: big-endian 32-bit word hashes, zero past the text."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, ids, places = part.column(0), part.column(1), part.column(3)
            for first, last, raw, offsets in lots(part.column(2), LOT):
                hashes, _, _, begin = words(raw, offsets, LOWER, SPACES)
                short = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                held = places.slice(first, last - first)
                counts = np.diff(held.offsets.to_numpy())
                owner = np.repeat(np.arange(last - first), counts)
                pos = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                for low in range(0, len(pos), 20_000):
                    own, at = owner[low : low + 20_000], pos[low : low + 20_000]
                    sides = []
                    for step in (np.arange(LEAST), -1 - np.arange(LEFT)):
                        where = at[:, None] + step + begin[own][:, None]
                        inside = (where >= begin[own][:, None]) & (where < begin[own + 1][:, None])
                        got = np.where(inside, short[np.clip(where, 0, max(len(short) - 1, 0))], 0).astype(">u4")
                        size = got.shape[1] * 4
                        sides.append(
                            pa.BinaryArray.from_buffers(
                                pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * size).astype(np.int32)), pa.py_buffer(got.tobytes())]
                            )
                        )
                    take = pa.array(own + first)
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(take), ids.take(take), pa.array(at.astype(np.int32)), *sides],
                        names=["row", "doc_id", "pos", "right", "left"],
                    )

    return placed.select("row", "doc_id", "text", "places").mapInArrow(batches, _SUFFIX)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, ">u4").reshape(len(column), width).astype(np.uint32)


def _shared(right: np.ndarray) -> np.ndarray:
    """How many words each suffix shares with the one before it; a zero is past the text and equals nothing."""
    differ = (right[1:] != right[:-1]) | (right[1:] == 0)
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), LEAST)])


def _sums(sides: np.ndarray) -> np.ndarray:
    """Hashes of each row's first 0, 1, 2, ... words."""
    sums = np.zeros((len(sides), sides.shape[1] + 1), np.uint64)
    np.cumsum(sides * _ODD[: sides.shape[1]], axis=1, out=sums[:, 1:])
    return sums


class _Block:
    """Consecutive suffixes of the order."""

    def __init__(self, table: pa.Table) -> None:
        column = lambda name: table.column(name).combine_chunks()
        self.row, self.pos = column("row").to_numpy(), column("pos").to_numpy()
        self.doc_id = column("doc_id")
        self.right, self.left = _matrix(column("right"), LEAST), _matrix(column("left"), LEFT)

    def settle(self) -> pa.RecordBatch:
        """The spans that each suffix lies in together with another one of the block, and the least other ``doc_id``."""
        n = len(self.row)
        shared, lefts = _shared(self.right), _sums(self.left)
        before = (self.left != 0).argmin(1)
        before[(self.left != 0).all(1)] = LEFT
        ids = self.doc_id.fill_null(np.iinfo(np.int64).max).to_numpy()
        least = np.full(n, np.iinfo(np.int64).max)
        met = np.zeros((n, NEAR), bool)
        for extra in range(NEAR):
            starts = shared < LEAST - extra
            lone = starts & np.concatenate([starts[1:], [True]])
            at = np.flatnonzero(~lone & (before >= extra))
            if not len(at):
                continue
            stretch = np.cumsum(starts)[at].astype(np.uint64)
            key = mix(lefts[at, extra] + mix(stretch))
            order = np.lexsort((ids[at], key))
            at, key = at[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            sizes = np.diff(np.concatenate([first, [len(at)]]))
            lead = np.repeat(first, sizes)
            both = np.repeat(sizes > 1, sizes)
            other = np.where(np.arange(len(at)) == lead, np.minimum(lead + 1, len(at) - 1), lead)
            own = at[both]
            met[own, extra] = True
            least[own] = np.minimum(least[own], ids[at[other[both]]])
        # Stretches that follow one another are one span.
        edge = np.diff(np.pad(met, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        one, low = np.nonzero(edge > 0)
        _, high = np.nonzero(edge < 0)
        start, end = self.pos[one] - (high - 1), self.pos[one] - low + LEAST
        other = pa.array(least[one], mask=least[one] == np.iinfo(np.int64).max)
        return _found(pa.nulls(len(one), pa.int64()), pa.array(self.row[one]), self.doc_id.take(pa.array(one)), start, end, other)

    def stretches(self, at: np.ndarray) -> pa.RecordBatch:
        """Each different stretch of ``LEAST`` words about the suffixes ``at`` once; the ``row`` is null if it is there twice."""
        rights, lefts = _sums(self.right[at]), _sums(self.left[at])
        after, before = (self.right[at] != 0).sum(1), (self.left[at] != 0).sum(1)
        hashes, owners, extras = [], [], []
        for extra in range(NEAR):
            fits = np.flatnonzero((after >= LEAST - extra) & (before >= extra))
            hashes.append(mix(rights[fits, LEAST - extra] + mix(lefts[fits, extra] + np.uint64(extra))))
            owners.append(at[fits])
            extras.append(np.full(len(fits), extra))
        hash_, owner, extra = map(np.concatenate, (hashes, owners, extras))
        different, first, counts = np.unique(hash_, return_index=True, return_counts=True)
        owner, start = owner[first], self.pos[owner[first]] - extra[first]
        row = pa.array(self.row[owner], mask=counts > 1)
        ids = self.doc_id.take(pa.array(owner))
        return _found(pa.array(different.view(np.int64)), row, ids, start, start + LEAST, pa.nulls(len(owner), pa.int64()))


def _found(hash_: pa.Array, row: pa.Array, ids: pa.Array, start: np.ndarray, end: np.ndarray, other: pa.Array) -> pa.RecordBatch:
    arrays = [hash_, row, ids, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), other]
    return pa.RecordBatch.from_arrays(arrays, names=["hash", "row", "doc_id", "start", "end", "other"])


def _settled(ordered: DataFrame, size: int) -> DataFrame:
    """The spans that suffixes of one partition share, and the stretches of words of the pieces of runs that others may hold too."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        cut = True  # whether the run that ``kept`` begins with may have begun before

        def piece(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Settles the whole runs of the table; the last one too, as a piece, if it is the ``last`` or long."""
            nonlocal kept, cut
            right = _matrix(table.column("right").combine_chunks(), LEAST)
            begins = np.flatnonzero(_shared(right) < GRAM)
            split = last or (len(begins) == 1 and table.num_rows >= size)
            upto = table.num_rows if split else int(begins[-1])
            kept = table.slice(upto)
            if not upto:
                return
            block = _Block(table.slice(0, upto))
            yield block.settle()
            # The runs that may go on elsewhere: the first, if it was cut, and the last.
            edges = [np.arange(0, begins[1] if len(begins) > 1 else upto)] if cut else []
            if split and (len(begins) > 1 or not cut):
                edges.append(np.arange(begins[-1], upto))
            for at in edges:
                yield block.stretches(at)
            cut = split

        for part in parts:
            if part.num_rows:
                batch = pa.Table.from_batches([part])
                table = batch if kept is None or not kept.num_rows else pa.concat_tables([kept, batch])
                if table.num_rows < size:
                    kept = table
                    continue
                yield from piece(table, False)
        if kept is not None and kept.num_rows:
            yield from piece(kept, True)

    return ordered.mapInArrow(batches, _FOUND)


def _again(ordered: DataFrame) -> DataFrame:
    """Spans of windows that are in no other span and whose hash, by which they are sorted, is met twice."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        told = False  # whether the row kept, the first of its hash, was given already
        for part in parts:
            if not part.num_rows:
                continue
            table = pa.Table.from_batches([part]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([part])])
            hashes = table.column("hash").to_numpy()
            n = len(hashes)
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            leads = np.flatnonzero(new)
            lead = leads[np.cumsum(new) - 1]
            last = np.concatenate([new[1:], [True]])
            own = np.arange(n)
            other = np.where(own == lead, np.minimum(own + 1, n - 1), lead)
            give = ~(new & last) & table.column("row").is_valid().to_numpy()
            if kept is not None and told:
                give[0] = False
            told = lead[-1] < n - 1 or bool(kept is not None and told and lead[-1] == 0)
            kept = table.slice(int(lead[-1]), 1)
            own, other = pa.array(own[give]), pa.array(other[give])
            if len(own):
                start = table.column("pos").take(own).to_numpy().astype(np.int32)
                columns = [table.column("row").take(own), table.column("doc_id").take(own), pa.chunked_array([pa.array(start)])]
                columns += [pa.chunked_array([pa.array(start + np.int32(LEAST))]), table.column("doc_id").take(other)]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names=["row", "doc_id", "start", "end", "other"])

    return ordered.mapInArrow(batches, _SPAN)


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``(doc_id, row, spans, twin)`` of each text with a repeated passage.

    ``spans`` are word ranges (start, end exclusive), apart and in order; ``twin`` is
    a ``doc_id`` that holds one of them too, the least of those it was settled with.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        found = materialize(seeds(docs, text, doc_id), "suffix-seeds")
    again = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    places = found.join(again, "key").groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    with small_batches(spark):
        suffixes = materialize(_contexts(_keyed(docs, text, doc_id).join(places, "row")), "suffixes")
    release(found)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["right", "row", "pos"]
    settled = materialize(_settled(suffixes.repartitionByRange(wide, *by).sortWithinPartitions(*by), block), "suffix-matches")
    release(suffixes)
    pieces = settled.filter("hash is not null").select("hash", "row", "doc_id", F.col("start").alias("pos"))
    across = _again(pieces.repartition(wide, "hash").sortWithinPartitions("hash", F.col("doc_id").asc_nulls_last()))
    every = settled.filter("hash is null").drop("hash").unionAll(across)
    # Spans that touch are one: a span is new where it begins after all that began before it have ended.
    order = Window.partitionBy("row", "doc_id").orderBy("start", "end")
    told = every.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    numbered = told.withColumn("island", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("row", "doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    return islands.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.min("other").alias("twin"))
