"""Language identification with averaged hashed subword embeddings and a linear softmax.

Every position of a text gives one byte n-gram of each order; each is hashed to a
row of an embedding table, the rows are averaged, and a linear layer with softmax
gives a probability a language.  The tables are trained here, by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  The average of a
linear map is the map of the average, so for prediction embeddings and layer are
multiplied into one small table of class scores, which every task gets.

A part of the sample is kept from training.  On it a temperature is fitted to the
logits, so that the score is a probability, and a threshold is set below which at
most :data:`LOST` of the rightly classified texts fall, :data:`DOUBT` at the highest;
scores below are rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; equal texts get equal results; an empty table gives an empty result; a model of
no labelled row at all calls every text ``und`` with score 0, but rejects only those
without a letter; other columns pass through, and those
named like the new ones are replaced.  Whole texts are read, at any length, in
pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS, BUCKET_BITS, WIDTH = (2, 3, 4), 14, 16
#: The bounds of the training sample: rows a label, and positions a row, spread over its whole text.
ROWS_PER_LABEL, POSITIONS = 600, 400
LOST = 0.002
#: A language that is more probable than all others together is never rejected.
DOUBT = 0.5
UNKNOWN = "und"
#: Bytes of text that are scored at once.
PIECE = 1 << 18

_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8
)
_PAD = b"    "


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _codes(raw: np.ndarray, at: np.ndarray | slice) -> list[np.ndarray]:
    """The bucket of the n-gram of each order at the positions; ``raw`` has a margin of four bytes."""
    wide = raw.astype(np.uint32)
    n = len(raw) - len(_PAD)
    first = wide[:n][at]
    code, found = first, []
    for k, order in enumerate(range(2, max(ORDERS) + 1)):
        code = (code << np.uint32(8)) | wide[order - 1 : n + order - 1][at]
        found.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (k << BUCKET_BITS))
    return found


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    table: np.ndarray  # n-gram buckets x labels
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, texts x labels."""
        sums = np.zeros((len(texts), len(self.labels)))
        counts = np.zeros(len(texts))
        lot: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not lot:
                return
            raw = _FOLD[np.frombuffer(_PAD.join(lot) + _PAD, np.uint8)]
            per = sum(self.table[c] for c in _codes(raw, slice(None)))
            lengths = np.array([len(x) for x in lot])
            starts = np.cumsum(lengths + len(_PAD)) - lengths - len(_PAD)
            bounds = np.stack([starts, starts + lengths], 1).ravel()
            bounds = bounds[:-1] if bounds[-1] >= len(per) else bounds
            own = np.array(owners)
            np.add.at(sums, own, np.add.reduceat(per, bounds, axis=0)[::2])
            np.add.at(counts, own, lengths)
            lot.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            raw = text.encode()
            for at in range(0, len(raw), PIECE):
                lot.append(raw[at : at + PIECE])
                owners.append(i)
                size += len(lot[-1])
                if size >= PIECE:
                    flush()
        flush()
        logits = (sums / np.maximum(len(ORDERS) * counts, 1)[:, None] + self.bias) / self.temperature
        return _softmax(logits)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sampled(labelled: DataFrame, text: str, label: str, key: str, rows: int, positions: int) -> tuple[list[str], list[np.ndarray]]:
    """Labels and bucket lists of at most ``2 * rows`` rows a label, in a fixed order."""
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if not counts:
        return [], []
    share = F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string")), F.lit(1_000_003)) / 1_000_003
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == value) & (share < min(1.0, 1.2 * rows / n)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for value in part.column(2).to_pylist():
                raw = _FOLD[np.frombuffer(value.encode() + _PAD, np.uint8)]
                n = len(raw) - len(_PAD)
                at = np.unique(np.linspace(0, max(n - 1, 0), min(n, positions)).astype(np.int64)) if n else np.zeros(0, np.int64)
                found.append(np.concatenate(_codes(raw, at)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["key", "label", "codes"]
            )

    chosen = known.filter(keep).select(F.col(key).cast("string").alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    got = chosen.mapInArrow(batches, "key string, label string, codes array<int>").limit(2 * rows * len(counts)).toPandas()
    got = got.sort_values(["key", "label"], kind="stable")
    return got["label"].tolist(), [np.asarray(x, np.int64) for x in got["codes"]]


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    rows_per_label: int = ROWS_PER_LABEL,
    positions: int = POSITIONS,
    epochs: int = 8,
    rate: float = 4.0,
    seed: int = 7,
) -> LanguageModel:
    """A model of the labels of ``labelled``, from about ``rows_per_label`` rows of each, chosen by a hash of ``key``."""
    labels, codes = _sampled(labelled, text, label, key, rows_per_label, positions)
    names = tuple(sorted(set(labels)))
    if not names:
        return LanguageModel((), np.zeros((len(ORDERS) << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = set(order[: len(y) // 5].tolist()) if len(y) >= 50 else set()
    fit = [i for i in order.tolist() if i not in held and len(codes[i])]
    emb = rng.normal(0, 0.1, (len(ORDERS) << BUCKET_BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    size, steps = 16, 0
    total = max(1, epochs * ((len(fit) + size - 1) // size))
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), size):
            rows = fit[at : at + size]
            lens = np.array([len(codes[i]) for i in rows])
            flat = np.concatenate([codes[i] for i in rows])
            starts = np.cumsum(lens) - lens
            mean = np.add.reduceat(emb[flat], starts, axis=0) / lens[:, None]
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            step = rate * (1 - steps / total) / len(rows)
            back = (wrong @ out.T / lens[:, None]).astype(np.float32)
            out -= step * (mean.T @ wrong)
            bias -= step * wrong.sum(0)
            # Embeddings are met by few texts of a lot, hence their own, larger step.
            np.subtract.at(emb, flat, np.repeat(step * 50 * back, lens, axis=0))
            steps += 1
    table = (emb @ out).astype(np.float32)
    temperature, threshold = _calibrate(table, bias, [codes[i] for i in sorted(held)], y[sorted(held)])
    return LanguageModel(names, table, bias, temperature, threshold)


def _calibrate(table: np.ndarray, bias: np.ndarray, codes: list[np.ndarray], y: np.ndarray) -> tuple[float, float]:
    if not len(codes):
        return 1.0, 0.0
    logits = np.array([table[c].sum(0) / max(1, len(c)) for c in codes]) + bias
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    probs = _softmax(logits / temperature)
    right = np.sort(probs.max(1)[probs.argmax(1) == y])
    threshold = min(DOUBT, float(right[int(LOST * len(right))])) if len(right) else 0.0
    return temperature, threshold


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (of that label, 0 to 1) and ``rejected``."""
    new = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    kept = [f for f in df.schema.fields if f.name.lower() not in {"lang_pred", "score", "rejected"} or f.name == text]
    schema = T.StructType([f for f in kept if f.name not in {x.name for x in new}] + new)
    passed = [f.name for f in schema.fields[:-3]]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            letters = np.array([has_letter(x) for x in texts], bool)
            if texts and model.labels:
                probs = model.scores([x if ok else "" for x, ok in zip(texts, letters.tolist(), strict=True)])
            else:
                probs = np.zeros((len(texts), 1))
            best, score = probs.argmax(1), np.where(letters, np.round(probs.max(1), 6), 0.0)
            names = [model.labels[b] if ok and model.labels else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            arrays = [part.column(part.schema.get_field_index(c)) for c in passed]
            arrays += [pa.array(names, pa.string()), pa.array(score), pa.array(~letters | (score < model.threshold))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.mapInArrow(batches, schema)
