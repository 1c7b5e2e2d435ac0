"""Benchmark decontamination: random-walk embeddings, bit-sampling LSH over windows, exact edit verification.

Texts and items are folded (A-Z to lower case, each run of white space one space).
An item is contained in a text if its length's share of unedited characters, by the
edit distance to the best matching stretch of the text, is at least :data:`SIMILARITY`.

The embedding (Chakraborty, Goldenberg and Koucky) walks along a window: at each step it
notes the byte under it and goes on to the next byte, or stays, by a random bit that hangs
on the step and the byte.  Walks over two windows run apart at an edit and soon meet
again, so a small edit distance becomes a small Hamming distance of what they noted.

Items fall into classes by their length (:data:`CLASSES`).  A class's windows have the size of
its items: as many steps as let a window begin at several words of the item and still end in it.
They begin at every word of the items and of the texts, or, for short items and those of few
words, at every place.  In each repetition some steps of one walk are sampled, one of each of as
many parts of the walk, and windows that agree in all of them are candidates.  The numbers of
samples and repetitions are those at which items with as many random edits as the similarity
allows were found with probability 0.99, which the tests measure for each length; other
targets scale the repetitions.  Verbatim items of :data:`SHORTEST` bytes or more always agree.

Every candidate is verified exactly.  An item is cut into pieces of at most :data:`WINDOW`
bytes; the sum of their edit distances to the text about their places, many at once by bit
vectors (Myers 1999), is never more than the item's, so a candidate above the limit by that
bound is out, and the others are decided on the whole item.  Nothing that is found for an item
depends on the other items, or on the block that it is in.

Items are broadcast in blocks of at most :data:`BLOCK_BYTES`, which take about sixty times as
much in a worker; the texts are read once for each block, one after another.  Defined cases: a
null or empty text holds no item; a null item, and one without a character, is in no text; items with
fewer than :data:`SHORTEST` folded bytes are found verbatim only, between characters that are
no letters or digits; equal items are each reported; an empty table gives an empty
result; rows that repeat a ``doc_id`` or have none are judged each by itself; ids keep their
type; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from metricframe.llm.storage import materialize, release
from metricframe.llm.textbuf import LOWER, SPACES, lots

SIMILARITY, RECALL = 0.8, 0.99
WINDOW, SHORTEST = 64, 16
BLOCK_BYTES = 1 << 20
#: Pieces judged at once, and candidates kept at once.
LANES, CANDIDATES = 1 << 12, 1 << 19
WALKS, STEPS = 2, 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = LOWER.copy()
_FOLD[SPACES] = 32
_RNG = np.random.default_rng(1986)
#: Whether the walk goes on: walks x steps x bytes.
_GOES = _RNG.integers(0, 2, (WALKS, STEPS, 256)).astype(np.intp)
_CODE = _RNG.integers(1, 2**63, (STEPS, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Size:
    """Items of ``least`` bytes or more: the steps of their windows, samples and repetitions; begins at ``words`` or every place."""

    least: int
    steps: int
    samples: int
    repetitions: int
    words: bool


CLASSES = (
    Size(16, 16, 6, 24, False),
    Size(32, 24, 7, 14, False),
    Size(64, 40, 9, 18, True),
    Size(80, 48, 10, 26, True),
    Size(160, 64, 12, 10, True),
)
#: An item has a word in so many bytes at least, or else it belongs to the last class that begins at every place.
BYTES_A_WORD = 12


def fold(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and offsets of several texts; none begins with a space."""
    mapped = _FOLD[raw]
    blank = mapped == 32
    drop = np.zeros_like(blank)
    drop[1:] = blank[1:] & blank[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    drop[edges] = blank[edges]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return mapped[~drop], kept[offsets]


def allowed(length: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * length + 1e-9)


def repetitions(size: Size, recall: float = RECALL) -> int:
    """Repetitions for a target: each one misses with the same probability."""
    return max(1, int(np.ceil(size.repetitions * np.log(1 - recall) / np.log(0.01))))


def samples(size: Size, repetition: int) -> tuple[int, np.ndarray]:
    """The walk and the steps that a repetition samples: one of each of ``size.samples`` parts of its first half, three quarters or all."""
    rng = np.random.default_rng([size.least, repetition])
    cuts = np.linspace(0, size.steps * (2 + repetition % 3) // 4, size.samples + 1).astype(int)
    return repetition // 3 % WALKS, np.array([rng.integers(low, high) for low, high in zip(cuts, cuts[1:], strict=False)])


def walk(body: np.ndarray, begins: np.ndarray, number: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """What the walk notes, steps x windows, and where each step is; ``body`` has a margin of so many bytes."""
    at = begins.astype(np.intp)
    noted, places = np.empty((steps, len(at)), np.uint8), np.empty((steps, len(at)), np.int32)
    for step in range(steps):
        places[step] = at
        np.take(body, at, out=noted[step], mode="clip")
        at = at + _GOES[number, step][noted[step]]
    return noted, places


def _notes(body: np.ndarray, begins: np.ndarray, number: int, steps: int) -> np.ndarray:
    at, noted = begins.astype(np.intp), np.empty((steps, len(begins)), np.uint8)
    for step in range(steps):
        np.take(body, at, out=noted[step], mode="clip")
        at += _GOES[number, step].take(noted[step])
    return noted


def _keys(noted: np.ndarray, repetition: int, steps: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    key = np.uint64(repetition + 1)
    for slot, step in enumerate(steps):
        key = key + _CODE[slot][noted[step][at]]
    return key * _SPREAD


def _slots(noted: np.ndarray, repetition: int, steps: np.ndarray, bits: int) -> np.ndarray:
    """Places of the windows' keys in a bitmap of so many bits: a quicker hash for the first look."""
    code = np.full(noted.shape[1], np.uint32(repetition + 1))
    for step in steps:
        np.multiply(code, np.uint32(0x9E3779B1), out=code)
        np.add(code, noted[step], out=code)
    code ^= code >> np.uint32(16)
    code *= np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - bits)).astype(np.intp)


def _begins(body: np.ndarray, offsets: np.ndarray, words: bool) -> np.ndarray:
    if not words:
        return np.arange(len(body))
    first = np.ones(len(body), bool)
    first[1:] = body[:-1] == 32
    first[offsets[:-1][offsets[:-1] < len(body)]] = True
    return np.flatnonzero(first & (body != 32))


@dataclass(frozen=True)
class Index:
    """The sampled keys of one class's windows, sorted, and the items and offsets that they come from."""

    size: Size
    samples: list[tuple[int, np.ndarray]]
    bits: int
    bitmap: np.ndarray
    keys: np.ndarray
    #: Where the run of equal keys ends that begins here.
    ends: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def build(size: Size, members: list[int], texts: list[bytes], recall: float) -> Index:
        chosen = [samples(size, r) for r in range(repetitions(size, recall))]
        lengths = np.array([len(texts[m]) for m in members])
        body = np.frombuffer(b"".join(texts[m] for m in members), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        begins = _begins(body, bounds, size.words)
        own = np.searchsorted(bounds, begins, side="right") - 1
        padded = np.concatenate([body, np.zeros(STEPS, np.uint8)])
        walks = [walk(padded, begins, number, size.steps) for number in range(WALKS)]
        # Where it is small, four times as many places as the others need: fewer windows are looked up in vain.
        slots = len(begins) * len(chosen) * 8
        bits = max(16, min(26, slots.bit_length()), min(22, (slots * 4).bit_length()))
        bitmap = np.zeros(1 << bits, bool)
        keys, owners, offsets = [], [], []
        for r, (number, steps) in enumerate(chosen):
            noted, places = walks[number]
            inside = places[steps[-1]] < bounds[own + 1]
            keys.append(_keys(noted, r, steps)[inside])
            owners.append(np.array(members)[own[inside]])
            offsets.append((begins - bounds[own])[inside])
            bitmap[_slots(noted, r, steps, bits)[inside]] = True
        key, owner, offset = map(np.concatenate, (keys, owners, offsets))
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = np.searchsorted(key, key, side="right")
        return Index(size, chosen, bits, bitmap, key, ends, owner[order].astype(np.int32), offset[order].astype(np.int32))

    def meetings(self, begins: np.ndarray, walks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(place where the item should begin, item)`` for windows that share a key, in parts of bounded size."""
        for r, (number, steps) in enumerate(self.samples):
            at = np.flatnonzero(self.bitmap.take(_slots(walks[number], r, steps, self.bits)))
            key = _keys(walks[number], r, steps, at)
            low = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            at, low = at[met := self.keys[low] == key], low[met]
            high = self.ends[low]
            ends = np.cumsum(high - low)
            total = int(ends[-1]) if len(ends) else 0
            for first in range(0, total, CANDIDATES):
                n = np.arange(first, min(total, first + CANDIDATES))
                row = np.searchsorted(ends, n, side="right")
                entry = high[row] - (ends[row] - n)
                yield begins[at[row]] - self.offsets[entry], self.owners[entry]


@dataclass(frozen=True)
class Items:
    """Folded items of one block: their pieces as bit patterns by class of byte, and the indexes of their windows."""

    ids: list
    texts: list[bytes]
    most: np.ndarray
    classes: np.ndarray
    patterns: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    indexes: list[Index]
    short: dict[int, dict[bytes, list[int]]]

    @staticmethod
    def build(rows: list[tuple], recall: float = RECALL, similarity: float = SIMILARITY) -> Items:
        ids, texts = [], []
        for item, text in rows:
            body = np.frombuffer((text or "").encode(), np.uint8)
            folded = fold(body, np.array([0, len(body)]))[0].tobytes().rstrip()
            if folded:
                ids.append(item)
                texts.append(folded)
        known = np.unique(np.frombuffer(b"".join(texts), np.uint8))
        classes = np.zeros(256, np.intp)
        classes[known] = np.arange(1, len(known) + 1)
        starts, sizes, owners, first = [], [], [], [0]
        for item, text in enumerate(texts):
            at = list(range(0, len(text), WINDOW))
            starts += at
            sizes += [min(WINDOW, len(text) - x) for x in at]
            owners += [item] * len(at)
            first.append(len(starts))
        patterns = np.zeros((len(starts), len(known) + 1), np.uint64)
        # A pattern ends at the top bit; bits below a short one match everything.
        for piece, (item, start, size) in enumerate(zip(owners, starts, sizes, strict=True)):
            patterns[piece] = np.uint64((1 << (64 - size)) - 1)
            bit = np.uint64(1) << np.arange(64 - size, 64, dtype=np.uint64)
            np.bitwise_or.at(patterns[piece], classes[np.frombuffer(texts[item], np.uint8)[start : start + size]], bit)
        by: dict[Size, list[int]] = {}
        short: dict[int, dict[bytes, list[int]]] = {}
        for item, text in enumerate(texts):
            if len(text) < SHORTEST:
                short.setdefault(len(text), {}).setdefault(text, []).append(item)
                continue
            fits = [c for c in CLASSES if c.least <= len(text) and (not c.words or (text.count(b" ") + 1) * BYTES_A_WORD >= len(text))]
            by.setdefault(fits[-1], []).append(item)
        indexes = [Index.build(size, members, texts, recall) for size, members in sorted(by.items(), key=lambda x: x[0].least)]
        most = np.array([allowed(len(t), similarity) for t in texts], np.int64)
        return Items(ids, texts, most, classes, patterns, np.array(sizes, np.int64), np.array(starts, np.int64), np.array(first, np.int64), indexes, short)

    def scores(self, body: np.ndarray, places: np.ndarray, pieces: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """The least edits from each piece to a stretch of ``body`` that lies within ``slack`` of its place.

        Myers' columns, one piece a lane.  ``body`` has classes.
        """
        out = np.zeros(len(places), np.int64)
        turn = np.argsort(slack, kind="stable")
        flat, wide = self.patterns.ravel(), self.patterns.shape[1]
        for low in range(0, len(places), LANES):
            lane = turn[low : low + LANES]
            piece, loose = pieces[lane], slack[lane]
            at = places[lane] - loose - 1
            n, base = len(piece), piece * wide
            one, top = np.uint64(1), np.uint64(63)
            pv = np.uint64(2**64 - 1) << (np.uint64(64) - self.sizes[piece].astype(np.uint64))
            mv, score = np.zeros(n, np.uint64), self.sizes[piece].astype(np.uint64)
            best = score.copy()
            eq, xv, xh, ph, mh, t = (np.empty(n, np.uint64) for _ in range(6))
            c = np.empty(n, np.intp)
            for _ in range(int((self.sizes[piece] + 2 * loose).max())):
                np.add(at, 1, out=at)
                np.take(body, at, out=c, mode="clip")
                np.add(c, base, out=c)
                np.take(flat, c, out=eq, mode="clip")
                np.bitwise_or(eq, mv, out=xv)
                np.bitwise_and(eq, pv, out=xh)
                np.add(xh, pv, out=xh)
                np.bitwise_xor(xh, pv, out=xh)
                np.bitwise_or(xh, eq, out=xh)
                np.bitwise_or(xh, pv, out=ph)
                np.invert(ph, out=ph)
                np.bitwise_or(ph, mv, out=ph)
                np.bitwise_and(pv, xh, out=mh)
                np.right_shift(ph, top, out=t)
                np.add(score, t, out=score)
                np.right_shift(mh, top, out=t)
                np.subtract(score, t, out=score)
                np.minimum(best, score, out=best)
                np.left_shift(ph, one, out=ph)
                np.left_shift(mh, one, out=mh)
                np.bitwise_or(xv, ph, out=t)
                np.invert(t, out=t)
                np.bitwise_or(mh, t, out=pv)
                np.bitwise_and(ph, xv, out=mv)
            out[lane] = best.astype(np.int64)
        return out

    def possible(self, body: np.ndarray, begins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which candidates may be within their edits: the pieces' least edits together are a lower bound of the item's."""
        edits, alive, turn = np.zeros(len(items), np.int64), np.arange(len(items)), 0
        done = np.zeros(len(items), bool)
        while len(alive):
            item = items[alive]
            piece = self.first[item] + turn
            left = piece < self.first[item + 1]
            done[alive[~left]] = True
            alive, item, piece = alive[left], item[left], piece[left]
            edits[alive] += self.scores(body, begins[alive] + self.starts[piece], piece, self.most[item])
            alive, turn = alive[edits[alive] <= self.most[item]], turn + 1
        return done

    def candidates(self, body: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """``(place where it should begin, item)`` for the windows that meet and may be within the item's edits."""
        if not self.indexes or not len(body):
            return []
        pad = int(self.most.max()) + 1
        classed = np.zeros(len(body) + 2 * pad, np.intp)
        classed[pad : pad + len(body)] = self.classes[body]
        padded = np.concatenate([body, np.zeros(STEPS, np.uint8)])
        found: set[tuple[int, int]] = set()
        for words in (True, False):
            mine = [x for x in self.indexes if x.size.words == words]
            if not mine:
                continue
            starts = _begins(body, ends, words)
            walks = [_notes(padded, starts, number, max(x.size.steps for x in mine)) for number in range(WALKS)]
            kept: list[np.ndarray] = []

            def settle(kept: list[np.ndarray]) -> None:
                pairs = np.unique(np.concatenate(kept))
                begins, items = (pairs >> 32) - (1 << 20), pairs & 0xFFFFFFFF
                good = self.possible(classed, begins + pad, items)
                found.update(zip(begins[good].tolist(), items[good].tolist(), strict=True))

            size = 0
            for index in mine:
                for begin, item in index.meetings(starts, walks):
                    kept.append(((begin + (1 << 20)) << 32) | item)
                    size += len(item)
                    if size >= CANDIDATES:
                        settle(kept)
                        kept, size = [], 0
            if kept:
                settle(kept)
        return sorted(found)

    def verbatim(self, body: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(place, item)`` of the items shorter than a window, between characters that are no letters or digits."""
        if not self.short or not len(body):
            return
        parted = np.ones(len(body) + 1, bool)
        parted[1:-1] = ~(_WORDY[body[1:]] & _WORDY[body[:-1]])
        parted[ends] = True
        text = body.tobytes()
        key = np.zeros(len(body), np.uint64)
        for length in range(1, max(self.short) + 1):
            key = key[: len(body) - length + 1] * _SPREAD + body[length - 1 :] + np.uint64(1)
            if length not in self.short or not len(key):
                continue
            wanted = []
            for item in self.short[length]:
                code = np.zeros(1, np.uint64)
                for byte in item:
                    code = code * _SPREAD + np.uint64(byte + 1)
                wanted.append(code)
            at = np.flatnonzero(np.isin(key, np.concatenate(wanted)))
            for place in at[parted[at] & parted[at + length]].tolist():
                for item in self.short[length].get(text[place : place + length], ()):
                    yield place, item


def edits_within(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """Least edits from ``item`` to any stretch of ``text`` and that stretch's end, if at most ``most``.

    >>> edits_within(b"abcd", b"xxabdyy", 1)
    (1, 5)
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = full, 0, m, most + 1, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, where = score, j + 1
    return (best, where) if best <= most else None


def allowed(length: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * length + 1e-9)


def find_in(items: Items, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(text, item, edits, place)`` for the items that the texts hold, each once a text with its fewest edits."""
    body, ends = fold(raw, offsets)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    covered: dict[tuple[int, int], int] = {}
    text_of = lambda place: int(np.searchsorted(ends, place, side="right")) - 1
    for place, item in items.verbatim(body, ends):
        text = text_of(place)
        if place + len(items.texts[item]) <= ends[text + 1]:
            found.setdefault((text, item), (0, place))
    for place, item in items.candidates(body, ends):
        sought, most = items.texts[item], int(items.most[item])
        # The text that the most of the item would lie in.
        text = min(max(text_of(place + len(sought) // 2), 0), len(ends) - 2)
        if (text, item) in covered and place <= covered[text, item]:
            continue  # within the stretch that has just been searched
        low, high = int(ends[text]), int(ends[text + 1])
        if low <= place and body[place : place + len(sought)].tobytes() == sought and place + len(sought) <= high:
            hit = (0, place)
        else:
            begin = max(low, place - 2 * most)
            got = edits_within(sought, body[begin : min(high, place + len(sought) + 2 * most)].tobytes(), most)
            hit = (got[0], begin + got[1] - len(sought)) if got else None
            covered[text, item] = place + most
        if hit and ((text, item) not in found or hit[0] < found[text, item][0]):
            found[text, item] = hit
    return [(text, item, hit[0], max(0, hit[1] - int(ends[text]))) for (text, item), hit in sorted(found.items())]


def blocks(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in lists of bounded size, streamed to the driver a partition at a time."""
    block, size = [], 0
    for row in items.select(item_id, text).filter(F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _each_block(benchmark: DataFrame, item_id: str, text: str, limit: int, one: Callable, first: DataFrame, label: str) -> DataFrame:
    """``one(result so far, broadcast items)`` for each block; only one block is built and broadcast at a time."""
    spark = first.sparkSession
    now, waiting = first, None
    for block in blocks(benchmark, item_id, text, limit):
        if waiting is not None:  # more than one block: run what there is, then let its items go
            done = materialize(now, label)
            waiting.destroy()
            release(before)
            now = done
        before = now
        waiting = spark.sparkContext.broadcast(Items.build(block))
        now = one(now, waiting)
    return now


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, item_id, edits, similarity)`` for each text and each item that it holds."""
    spark = docs.sparkSession
    kinds = [docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType]
    schema = T.StructType(
        [
            T.StructField("doc_id", kinds[0]),
            T.StructField("item_id", kinds[1]),
            T.StructField("edits", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    item_type = to_arrow_type(kinds[1])

    def search(found: DataFrame, shared) -> DataFrame:  # noqa: ANN001
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for part in parts:
                rows: list[tuple] = []
                for first, _, raw, offsets in lots(part.column(1)):
                    for row, item, edits, _ in find_in(items, raw, offsets):
                        rows.append((first + row, items.ids[item], edits, 1 - edits / len(items.texts[item])))
                if rows:
                    a, b, c, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(a)), pa.array(b, item_type), pa.array(c, pa.int32()), pa.array(d, pa.float64())],
                        names=["doc_id", "item_id", "edits", "similarity"],
                    )

        return found.unionAll(narrow.mapInArrow(batches, schema))

    return _each_block(benchmark, item_id, text, block_bytes, search, spark.createDataFrame([], schema), "leaks")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` less the rows that hold an item, each judged by its text alone, whatever its id."""

    def keep(left: DataFrame, shared) -> DataFrame:  # noqa: ANN001
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for part in parts:
                clean = np.ones(part.num_rows, bool)
                for first, _, raw, offsets in lots(part.column(part.schema.get_field_index(text))):
                    clean[[first + row for row, *_ in find_in(items, raw, offsets)]] = False
                yield part.filter(pa.array(clean))

        return left.mapInArrow(batches, left.schema)

    return _each_block(benchmark, item_id, text, block_bytes, keep, docs, "clean")
