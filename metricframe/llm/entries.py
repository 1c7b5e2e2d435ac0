"""The thin ``opN_*`` queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricframe.llm import bpe, decontaminate, extract, fingerprint, langid, licenses, secrets, simhash, suffixes, urlfilter
from metricframe.llm.storage import importable

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_versions(table(spark, sf_dir, "documents"))


def fold(doc_id: str = "doc_id") -> F.Column:
    """The fold of a document: crc32 of its id as text, modulo 3; fold 1 is held out, a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold() != 1).select("doc_id", "text", "lang"))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"))
    words = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("spans").alias("n_spans"), words.alias("repeated_words"), listed.alias("spans"), "twin")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_url_filter,
        op2_byte_bpe,
        op3_main_text,
        op4_fingerprint,
        op5_licenses,
        op6_language,
        op7_secrets,
        op8_simhash,
        op9_decontaminate,
        op10_suffixes,
    )
    return {f.__name__: f for f in made}


def _rules_sql() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


OP1_SQL = f"""
WITH rules(rule_host, start, verdict) AS (VALUES {_rules_sql()}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
fits AS (
    SELECT page_id, arg_max(rule_host || start, length(rule_host) * 100000 + length(start)) AS rule,
        arg_max(verdict, length(rule_host) * 100000 + length(start)) AS verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM (SELECT coalesce(page_id) AS page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts) p LEFT JOIN fits f ON p.page_id = f.page_id
"""


def _spans_sql(rule: secrets.Rule, rank: int) -> tuple[str, str]:
    """A rule's spans as a list of (start, rank, end, kind), from the lengths of the pieces between its matches."""
    pattern = rule.pattern.replace("'", "''")
    found, gaps = f"regexp_extract_all(body, '{pattern}', 0)", f"regexp_split_to_array(body, '{pattern}')"
    kept = f"regexp_extract_all(body, '{pattern}', {rule.group})" if rule.group else "f"
    return f"""list_transform(
        list_filter(range(1, len(f{rank}) + 1), lambda i: length(k{rank}[i]) >= {rule.least}),
        lambda i: {{'start': CAST(coalesce(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f{rank}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
            'rank': {rank},
            'end': CAST(coalesce(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f{rank}[1:i], lambda x: length(x))), 0) AS BIGINT),
            'kind': '{rule.kind}'}})""", f"{found} AS f{rank}, {gaps} AS g{rank}, {kept if rule.group else found} AS k{rank}"


def _secrets_sql() -> str:
    made = [_spans_sql(rule, rank) for rank, rule in enumerate(secrets.RULES)]
    lists = ", ".join(f"{spans} AS s{rank}" for rank, (spans, _) in enumerate(made))
    matches = ", ".join(m for _, m in made)
    base = " || ".join(f"s{i}" for i in range(len(secrets.BASE_RULES)))
    every = " || ".join(f"s{i}" for i in range(len(secrets.RULES)))
    shown = lambda spans: f"array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.start || ':' || s.end), ',')"
    return f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
matches AS (SELECT doc_id, {matches} FROM bodies),
spans AS (SELECT doc_id, {lists} FROM matches)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access, CAST(len(s2) AS BIGINT) AS n_hex,
    sha256({shown(base)}) AS base_sha256, {shown(every)} AS spans
FROM spans
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op7_secrets": _secrets_sql()}
