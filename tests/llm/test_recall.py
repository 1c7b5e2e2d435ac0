"""Recall of decontamination by length of the item and share of edits; no Spark is needed."""

import random

import numpy as np
import pytest

from metricframe.llm import decontaminate

LETTERS = "etaoinshrdlu"


def prose(rng, length):
    """Invented words that share syllables, cut to the length, without a space at the ends."""
    syllables = ["".join(rng.choices(LETTERS, k=rng.randint(1, 3))) for _ in range(150)]
    text = ""
    while len(text) < length + 2:
        text += "".join(rng.choices(syllables, k=rng.randint(1, 4))) + " "
    text = text[:length]
    return text.rstrip() + "x" * (length - len(text.rstrip()))


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        kind, at = rng.randrange(4), rng.randrange(len(letters))
        if kind < 2:
            letters[at] = rng.choice(LETTERS)
        elif kind == 2:
            del letters[at]
        else:
            letters.insert(at, rng.choice(LETTERS + " "))
    return "".join(letters)


def share_found(rng, items, edits):
    """Share of the items within the similarity that are found, each edited in a text of its own."""
    built = decontaminate.Items.build(list(enumerate(items)))
    texts = [f"{prose(rng, 150)} {edited(rng, item, edits(len(item)))} {prose(rng, 150)}".encode() for item in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = {(t, i) for t, i, _, _ in decontaminate.find_in(built, np.frombuffer(b"".join(texts), np.uint8), offsets)}
    within = [i for i, text in enumerate(texts) if decontaminate.edits_within(items[i].encode(), text, decontaminate.allowed(len(items[i])))]
    return sum((i, i) in found for i in within) / len(within)


@pytest.mark.parametrize("length", [16, 40, 64, 81, 100, 130, 226, 394])
@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_edited_items_are_found(length, rate):
    rng = random.Random(length)
    items = [prose(rng, length) for _ in range(600 if rate == 0.2 and length < 130 else 200)]
    # The target is 0.99 at the most edits; one deviation of 600 items is 0.004.
    assert share_found(rng, items, lambda n: int(rate * n)) >= 0.983


@pytest.mark.parametrize("lengths", [(16, 17), (30, 45), (64, 69), (70, 104), (16, 100)])
def test_verbatim_items_are_found(lengths):
    rng = random.Random(lengths[0])
    items = [prose(rng, rng.randint(*lengths)) for _ in range(200)]
    assert share_found(rng, items, lambda n: 0) == 1


def test_few_windows_are_looked_up_in_vain():
    rng = np.random.default_rng(41)
    rows = [(i, "".join(rng.choice(list("etaoin shrdlu cmf"), 70 + i))) for i in range(200)]
    for index in decontaminate.Items.build(rows).indexes:
        assert 0 < index.bitmap.mean() < 0.04 and len(index.bitmap) == 1 << index.bits
