"""The pipeline against plain Python on a small corpus."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from metricframe.llm import entries, secrets, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(31)
    sounds = {"aa": "ka lo mi no pu".split(), "bb": "schein ung lich zwei".split(), "cc": "ción ado mente que".split()}
    words = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 3))) for _ in range(n))
    items = [words("aa", 30) for _ in range(5)]
    docs = [(i, words(lang, rng.randint(20, 90)), lang) for i, lang in enumerate(rng.choices(sorted(sounds), k=150))]
    docs += [(200 + i, docs[i][1], docs[i][2]) for i in range(10)]  # copies
    docs += [(300 + i, f"{words('aa', 10)} {item} {words('aa', 10)}", "aa") for i, item in enumerate(items)]
    docs += [(400, words("bb", 20) + " token = s3cr3tvalue " + words("bb", 20), "bb"), (401, "12 34 !!", None), (402, None, None), (403, "", "aa")]
    docs += [(404, words("cc", 5000), "cc")]
    return docs, items


def test_pipeline(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t, _ in docs if t and any(map(str.isalpha, t))}
    prints = {i: simhash.fingerprint_of(t.encode()) for i, t in kept.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    kept = {i: kept[i] for i, c in brute.groups(prints, links).items() if i == c}
    kept = {i: t for i, t in kept.items() if not any(item in t for item in items)}
    for i, t in kept.items():
        for start, _, end, _ in reversed(brute.base_spans(t)):
            t = t[:start] + secrets.MASK + t[end:]
        kept[i] = t
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(entries.RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {i: hashlib.sha256(np.array(own.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in kept.items()}

    found = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == expected and 400 in found and 401 not in found and 200 not in found and 300 not in found


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs[:60]], SCHEMA)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, table, str(tmp_path))
        assert made.columns == table.columns
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_repeated_and_missing_ids(spark, tmp_path):
    """No text is lost to another of the same id, and no contaminated row stays for want of one."""
    _, items = corpus()
    leak = f"before it {items[0]} and after"
    rows = [(1, "ka lo mi no pu and so on"), (1, "schein ung lich zwei or else"), (1, "schein ung lich zwei or else"), (2, leak), (None, leak), (None, "ka lo")]
    table = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r["text"] for r in stages["near_duplicates"](spark, table, "").collect() if r["doc_id"] == 1) == sorted({t for i, t in rows if i == 1})
    left = stages["decontamination"](spark, table, str(tmp_path)).collect()
    assert len(left) == 4 and leak not in {r["text"] for r in left}
