"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library's model works on characters, so each of the 256 bytes stands for one
printable character (the usual byte-level table).  The vocabulary and the merges
are derived from a rank file: a token's merge is the pair that is left when its
own bytes are merged by all lower ranks.  Text is cut by the pattern first, and
each piece is merged alone.  Decoding looks every id up, reverses the byte table
and joins the bytes; characters that tokens split between them come together
again, because only the joined bytes are read as UTF-8.

Defined cases: null text encodes as the empty text (no ids, offsets or bytes);
an id list that is null decodes to the empty bytes; bytes that are no UTF-8
(lists cut inside a character) decode to U+FFFD as text and unchanged as bytes;
an id outside the vocabulary raises; rows are independent, so ties and repeats
need no rule; other columns pass through, and columns named like the new ones
are replaced.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are handed to the library in lots of about so many bytes.
LOT_BYTES = 1 << 20
#: Words whose ids a worker remembers.
CACHED = 700_000


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def derive_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of two or more bytes, in rank order."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                (r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) <= rank
            )
            if best[0] == rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class ByteBPE:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        shown = lambda raw: "".join(table[b] for b in raw)
        vocab = {shown(token): rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[(shown(a), shown(b)) for a, b in derive_merges(ranks)]))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        back = {c: b for b, c in enumerate(table)}
        self.known: dict[str, bytes] = {}
        self.bytes_of: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
        for text, rank in vocab.items():
            self.bytes_of[rank] = bytes(back[c] for c in text)
        self.lengths = np.array([len(x or b"") for x in self.bytes_of], np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Put the ids of ``" " + word`` in the cache, for words that neither start nor end with white space."""
        words = [word for word in words if word and not word[0].isspace() and not word[-1].isspace()]
        if len(self.known) + len(words) > CACHED:
            self.known.clear()
        if not words:
            return
        ids = self._library(["".join([" " + word for word in words])])[0]
        ends = np.cumsum([len(word.encode()) + 1 for word in words])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        raw, at = ids.tobytes(), 0
        for word, cut in zip(words, (cuts * 4).tolist(), strict=True):
            self.known[word] = raw[at:cut]
            at = cut

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        No match of the pattern goes on from a character that is no white space to a
        space, and what it matches from a space on that stands alone between two such
        characters doesn't depend on what is before.  So a text whose spaces all stand
        alone is the sequence of its words, each with the space before it, and the
        library encodes each different word once while a bounded cache holds it.
        Other texts go to the library whole.
        """
        words = [text.split(" ") for text in texts]
        needed = {word for row in words for word in row[1:]}
        if fresh := needed.difference(self.known):
            if len(self.known) + len(fresh) > CACHED:
                self.known.clear()
                fresh = needed
            self._learn(fresh)
        found, whole = [], []
        for i, row in enumerate(words):
            try:
                rest = b"".join(map(self.known.__getitem__, row[1:]))
            except KeyError:
                whole.append(i)
                found.append(b"")
                continue
            if row[0] and row[0][-1].isspace() and len(row) > 1:
                whole.append(i)
            found.append(rest)
        odd = set(whole)
        firsts = [i for i in range(len(words)) if i not in odd]
        for i, ids in zip(firsts, self._library([words[i][0] for i in firsts]), strict=True):
            found[i] = ids.tobytes() + found[i]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            found[i] = ids.tobytes()
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(raw, dtype="<u4") for raw in self.encode_bytes(texts)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
        """Ids, and for each the code points that its bytes touch (start, end exclusive)."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(np.array(e.ids, dtype="<u4"), e.offsets) for e in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """The vocabulary of a rank file, built once in each Python worker."""
    return ByteBPE(read_ranks(path), pattern)


def lots(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts, about :data:`LOT_BYTES` together; null is the empty text."""
    lot, size = [], 0
    for text in texts:
        lot.append(text or "")
        size += len(lot[-1])
        if size >= LOT_BYTES:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _extended(df: DataFrame, new: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return [f.name for f in kept], T.StructType(kept + new)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (and ``offsets``, structs of start and end) of every text."""
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        new.append(T.StructField("offsets", T.ArrayType(span)))
    kept, schema = _extended(df, new)
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in parts:
            rows, at = part.column(part.schema.get_field_index(text)).to_pylist(), 0
            for lot in lots(rows):
                arrays = [part.column(part.schema.get_field_index(c)).slice(at, len(lot)) for c in kept]
                if offsets:
                    found = bpe.encode_with_offsets(lot)
                    ids = [x for x, _ in found]
                    extra = [pa.array([[{"start": s, "end": e} for s, e in o] for _, o in found], arrow_span)]
                else:
                    ids, extra = bpe.encode(lot), []
                arrays += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), *extra]
                at += len(lot)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.mapInArrow(batches, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded_bytes`` and ``decoded_text`` of every id list."""
    new = [T.StructField("decoded_bytes", T.BinaryType()), T.StructField("decoded_text", T.StringType())]
    kept, schema = _extended(df, new)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in parts:
            raw = [bpe.decode(np.array(x or [], np.int64)) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
            arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.mapInArrow(batches, schema)


def round_trip_digests(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and decoded in one pass.

    The id lists stay in the worker that made them, so nothing but digests leaves it.
    """
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in parts:
            counts, ids_sha, text_sha = [], [], []
            for lot in lots(part.column(1).to_pylist()):
                for raw in bpe.encode_bytes(lot):
                    ids = np.frombuffer(raw, dtype="<u4")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=schema.fieldNames(),
            )

    return df.select(key, text).mapInArrow(batches, schema)
