"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are words of letters and digits, A-Z lower-cased, everything else
parting them; a shingle is five words, or all of a shorter template.  For each size
of template a text is covered by windows that overlap so far that a license lies
wholly in one.  The windows' MinHash signatures are cut into bands; a window that
shares a band with a template is a candidate.  :func:`bands_for` chooses the number
of bands from the least Jaccard index that a window with the wanted containment can
have, so that it collides with probability :data:`RECALL` at least.

A candidate is verified exactly: the share of the template's distinct shingles that
occur in the window and its margins must be :data:`CONTAINED`.

Defined cases: a null or empty text has no license; a template without a word is
ignored; templates with the same text are each reported; overlapping finds of one
template are one, at its best place; rows that repeat are judged alike; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricframe.llm.textbuf import LOWER, lots, mix, shingles, sliding, words

SHINGLE, CONTAINED, RECALL = 5, 0.8, 0.995
#: Templates below so many shingles get a window at every word.
SMALL = 8
_FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 48) & (LOWER <= 57) | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)
_GAP = np.zeros(256, bool)
_GAP[32] = True

#: Short notices and the openings of the texts they stand for.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "mpl-2.0-text",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, you can obtain one at mozilla.org.",
    ),
    (
        "gpl-text",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
)


def bands_for(jaccard: float, rows: int, recall: float = RECALL) -> int:
    """Bands of ``rows`` hashes after which windows of that Jaccard index have collided with probability ``recall``."""
    p = min(jaccard, 1.0) ** rows
    return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def template_words(text: str) -> tuple[np.ndarray, int, int]:
    """Shingle hashes of a template, its shingle's width and its number of words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    hashes, _, _, first = words(raw, np.array([0, len(raw)]), _FOLD, _GAP)
    width = min(SHINGLE, len(hashes))
    if not width:
        return np.zeros(0, np.uint64), 0, 0
    keys, whole = shingles(hashes, first, width)
    return keys[whole], width, len(hashes)


@dataclass(frozen=True)
class SizeClass:
    """Templates that share windows: ``block`` shingles a block, ``blocks`` of them a window."""

    width: int
    block: int
    blocks: int
    rows: int
    bands: int
    members: tuple[int, ...]
    #: Sorted band keys of the members, and whose they are.
    keys: np.ndarray
    owners: np.ndarray


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """Band keys, bands x windows, of signatures, hashes x windows."""
    out = []
    for band in range(len(minima) // rows):
        key = np.full(minima.shape[1], np.uint64(band + 1))
        for row in minima[band * rows : (band + 1) * rows]:
            key = mix(key * np.uint64(31) + row)
        out.append(key)
    return np.stack(out)


def size_classes(shingle_sets: Sequence[tuple[np.ndarray, int, int]], contained: float = CONTAINED) -> list[SizeClass]:
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, (keys, width, _) in enumerate(shingle_sets):
        if not width:
            continue
        n = len(keys)
        block = 1 if n < SMALL else 1 << int(math.log2(n) - 1)
        blocks = n if n < SMALL else -(-n // block) + 1
        groups.setdefault((width, block, blocks), []).append(i)
    made = []
    for (width, block, blocks), members in sorted(groups.items()):
        jaccards = []
        for i in members:
            n = len(shingle_sets[i][0])
            kept = math.ceil(contained * n)
            jaccards.append(kept / (block * blocks + n - kept))
        least = min(jaccards)
        rows = 1 if least >= 1 else 2 if least < 0.6 else 3
        bands = bands_for(least, rows)
        salts = _salts(rows * bands)
        keys, owners = [], []
        for i in members:
            minima = np.array([[mix(shingle_sets[i][0] ^ s).min()] for s in salts])
            keys.append(_band_keys(minima, rows)[:, 0])
            owners.append(np.full(bands, i))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        made.append(SizeClass(width, block, blocks, rows, bands, tuple(members), keys[order], owners[order]))
    return made


def find_in(
    sets: Sequence[tuple[np.ndarray, int, int]], classes: Sequence[SizeClass], raw: np.ndarray, offsets: np.ndarray, contained: float = CONTAINED
) -> list[tuple[int, int, float, int, int]]:
    """``(text, template, containment, first word, end word)``, the best place of each template in each text."""
    hashes, _, _, begin = words(raw, offsets, _FOLD, _GAP)
    if not len(hashes):
        return []
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in classes:
        if c.width not in by_width:
            keys, whole = shingles(hashes, begin, c.width)
            by_width[c.width] = (np.where(whole, keys, np.uint64(2**64 - 1)), whole)
        keys, whole = by_width[c.width]
        count = len(keys) // c.block
        tail = len(keys) - count * c.block
        padded = np.concatenate([keys, np.full(c.block - tail if tail else 0, np.uint64(2**64 - 1))])
        minima = []
        for salt in _salts(c.rows * c.bands):
            salted = mix(padded ^ salt)
            per_block = salted.reshape(-1, c.block).min(1) if c.block > 1 else salted
            minima.append(sliding(per_block, min(c.blocks, len(per_block)), np.minimum))
        bands = _band_keys(np.stack(minima), c.rows)
        low, high = np.searchsorted(c.keys, bands, "left"), np.searchsorted(c.keys, bands, "right")
        _, windows = np.nonzero(high > low)
        met = sorted({(int(w), int(o)) for w, (x, y) in zip(windows, zip(low[high > low], high[high > low], strict=True), strict=True) for o in c.owners[x:y]})
        for window, member in met:
            wanted = np.unique(sets[member][0])
            # The window with a block on each side; what of it lies in each text is held against the template.
            a, b = max(0, (window - 1) * c.block), min(len(keys), (window + c.blocks + 1) * c.block)
            for text in range(int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b, "left"))):
                s, e = max(a, int(begin[text])), min(b, int(begin[text + 1]))
                here = np.flatnonzero(np.isin(keys[s:e], wanted) & whole[s:e]) + s
                share = len(np.unique(keys[here])) / len(wanted) if len(here) else 0.0
                if share >= contained and share > best.get((text, member), (0.0,))[0]:
                    start = int(begin[text])
                    best[text, member] = (share, int(here[0]) - start, int(here[-1]) + c.width - start)
    return [(text, member, *found) for (text, member), found in sorted(best.items())]


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    text: str = "text",
    doc_id: str = "doc_id",
    contained: float = CONTAINED,
) -> DataFrame:
    """``(doc_id, license, containment, first_word, end_word)`` of each text and each license that it holds.

    The templates go to every task; they are licenses, not documents.
    """
    sets = [template_words(body) for _, body in templates]
    classes = size_classes(sets, contained)
    names = [name for name, _ in templates]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for first, _, raw, offsets in lots(part.column(1)):
                for row, member, share, start, end in find_in(sets, classes, raw, offsets, contained):
                    rows.append((part.column(0)[first + row].as_py(), names[member], share, start, end))
            if rows:
                ids, licenses, shares, starts, ends = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(licenses), pa.array(shares, pa.float64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    names=["doc_id", "license", "containment", "first_word", "end_word"],
                )

    schema = "doc_id long, license string, containment double, first_word int, end_word int"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, schema)
