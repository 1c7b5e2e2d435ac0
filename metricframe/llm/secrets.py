"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived
(:mod:`metricframe.llm.trigrams`).  The index holds a posting ``(trigram, doc_id)``
for each trigram that some query mentions and each text that contains it, case
folded.  A query is answered by intersecting postings: an alternative is met by
the documents that have all its trigrams.  Only those are then matched with the
rule itself; a rule without a mandatory trigram scans every text.

Spans are code points, end exclusive.  Spark gives matched strings without their
place, so a span is summed up from the lengths of the pieces between matches.

Defined cases: a null text is the empty text; rows with a null ``doc_id`` are in no
posting and are matched against every rule; rows that share a ``doc_id`` share
candidates, and each is verified by itself; an empty table gives an empty result;
columns named like the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricframe.llm.trigrams import trigram_query

#: Not in any pattern's result: stands in for each secret that is taken out.
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``group`` of at least ``least`` characters is what keeps a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: A longer run never starts earlier than a shorter one that fails, so the least lengths of
#: access and hex stand in their patterns; a failing assignment, though, uses up its text.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index ``(doc_id, trigram)`` over the trigrams that the rules' queries mention."""
    wanted = sorted({g for rule in rules for part in trigram_query(rule.pattern) or () for g in part})
    folded = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in wanted] or [F.lit(None).cast("string")]))
    return folded.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, kinds)``: the rules whose trigram queries a document's postings meet."""
    asked = [
        (rule.kind, i, gram, len(part))
        for rule in rules
        for i, part in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or ())))
        for gram in part
    ]
    # As many rows as the rules' queries have trigrams, whatever the documents are.
    ask = docs.sparkSession.createDataFrame(asked, "kind string, part int, trigram string, need int")
    met = (
        postings(docs, rules, text, doc_id)
        .join(F.broadcast(ask), "trigram")
        .groupBy("doc_id", "kind", "part")
        .agg(F.count("*").alias("n"), F.min("need").alias("need"))
        .filter("n >= need")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """The rule's spans in a text: structs of start, rank, end, kind in order of start."""
    pattern = F.lit(rule.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))),
        kept,
        lambda step, value: F.struct(step["gap"].alias("gap"), step["hit"].alias("hit"), (F.length(value) >= rule.least).alias("ok")),
    )
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def add(so_far: Column, step: Column) -> Column:
        begin = so_far["at"] + step["gap"]
        end = begin + step["hit"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            end.alias("at"), F.when(step["ok"], F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans")
        )

    return F.when(F.rlike(text, pattern), F.aggregate(steps, start, add, lambda x: x["spans"])).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``secrets``: all spans (start, rank, end, kind), sorted by start and the rules' order."""
    base = docs.drop("secrets")
    picked = candidates(docs, rules, text, doc_id).select(F.col("doc_id").alias("__key"), F.col("kinds").alias("__kinds"))
    body = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank, body)
        if trigram_query(rule.pattern) is not None:
            due = F.col(doc_id).isNull() | F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
            spans = F.when(due, spans).otherwise(empty)
        parts.append(spans)
    joined = base.join(picked, base[doc_id] == picked["__key"], "left")
    return joined.withColumn("secrets", F.array_sort(F.concat(*parts) if parts else empty)).drop("__key", "__kinds")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every found secret, overlapping ones together, replaced by :data:`MASK`."""
    found = scan(docs, rules, text, doc_id)
    body, whole = F.col(text), F.col("secrets")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        clear = span["start"] >= so_far["at"]
        piece = F.concat(so_far["out"], F.substring(body, so_far["at"] + 1, span["start"] - so_far["at"]), F.lit(MASK))
        return F.struct(F.greatest(so_far["at"], span["end"]).alias("at"), F.when(clear, piece).otherwise(so_far["out"]).alias("out"))

    cleaned = F.aggregate(whole, start, step, lambda x: F.concat(x["out"], F.substring(body, x["at"] + 1, F.length(body))))
    masked = F.when(F.size(whole) > 0, cleaned).otherwise(body)
    return found.withColumn(text, masked).select(*docs.drop("secrets").columns)
