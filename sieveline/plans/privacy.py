"""Queries over detectors, policy and sanitizing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, planning, policy
from ..operators.detectors import detect
from ..sources.tables import dealt, table
from . import twins
from .registry import Registry

QUERIES = Registry()
_COLUMNS = "key, category, tier, confidence, start_off, end_off, matched, rule"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents"))


@QUERIES.add(twins.detections_sql(twins.DOCUMENTS) + f" SELECT {_COLUMNS} FROM det")
def pii_scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    return detect(documents(spark, folder), "doc_id")


@QUERIES.add(twins.detections_sql("SELECT conv_id * 1000 + turn AS key, coalesce(text, '') AS text FROM conversations") + f" SELECT {_COLUMNS} FROM det")
def pii_scan_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return detect(table(spark, folder, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key")


@QUERIES.add(twins.detections_sql(twins.DOCUMENTS) + " SELECT category, tier, count(*) AS n, count(DISTINCT key) AS n_keys FROM det GROUP BY category, tier")
def pii_counts_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return detect(documents(spark, folder), "doc_id").groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


@QUERIES.add(
    twins.detections_sql(twins.DOCUMENTS)
    + " SELECT source, lang, count(d.key) AS n, count(DISTINCT d.key) AS n_documents FROM documents LEFT JOIN det d ON d.key = doc_id GROUP BY source, lang"
)
def pii_by_source_lang(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = detectors.with_detections(docs.select("doc_id", "source", "lang", "text")).withColumn("n", F.size("detections"))
    return found.groupBy("source", "lang").agg(F.sum("n").alias("n"), F.count_distinct(F.when(F.col("n") > 0, F.col("doc_id"))).alias("n_documents"))


@QUERIES.add(twins.sanitized_sql())
def sanitized_documents(spark: SparkSession, folder: str) -> DataFrame:
    return policy.sanitize(documents(spark, folder), "doc_id")


#: Choices of a case; an event stands for one of each, by the digits of its number.
_CHOICES = {
    "category": ["email", "phone", "contact", "credit-card", "iban", "payment", "aadhaar", "dob", "financial", "health", "password", "otp", "jwt", "secret", "face", "address", "passport"],
    "tier": ["checksum-verified", "pattern-matched", "context-inferred"], "confidence": [0.2, 0.5, 0.7, 0.9, 0.98], "necessity": ["required", "optional", "unknown"],
    "recipient": ["remote-planner", "task-website", "local-logs", "local-display"], "ambiguity": ["low", "high"], "authorized": [True, False],
}


def _digits(choices: dict[str, list]) -> dict[str, tuple[int, int]]:
    """What a number is divided by, and the number of choices, for each digit."""
    out, by = {}, 1
    for name, options in choices.items():
        out[name], by = (by, len(options)), by * len(options)
    return out


def chosen(rows: DataFrame, number: str, choices: dict[str, list]) -> DataFrame:
    """One of each choice by the digits of a number."""
    pick = lambda name, by, n: F.get(F.array(*map(F.lit, choices[name])), (F.floor(F.col(number) / by) % n).cast("int")).alias(name)
    return rows.select(*[pick(name, by, n) for name, (by, n) in _digits(choices).items()])


def chosen_sql(table: str, number: str, choices: dict[str, list]) -> str:
    listed = lambda name: str(choices[name]).replace("True", "true").replace("False", "false")
    return "SELECT " + ", ".join(f"{listed(name)}[({number} // {by}) % {n} + 1] AS {name}" for name, (by, n) in _digits(choices).items()) + f" FROM {table}"


_MATRIX = f"""WITH m AS (SELECT category, tier, CAST(confidence AS DOUBLE) AS confidence, necessity, recipient, ambiguity, authorized, count(*) AS n FROM ({chosen_sql("events", "event_id", _CHOICES)}) GROUP BY ALL)
SELECT *, CASE WHEN ambiguity = 'high' OR confidence < 0.3 THEN 'OMIT'
  WHEN recipient = 'task-website' THEN CASE WHEN authorized THEN 'ALLOW_LITERAL' ELSE 'ASK_LOCAL' END
  WHEN recipient = 'local-logs' THEN 'ABSTRACT' WHEN recipient = 'local-display' THEN 'ALLOW_LITERAL'
  WHEN category = 'face' THEN 'MASK_VISUAL'
  WHEN category IN ('payment','credit-card','iban') THEN CASE WHEN necessity = 'required' AND confidence >= 0.7 THEN 'TOKENIZE' ELSE 'OMIT' END
  WHEN category IN ('contact','email','phone') THEN CASE WHEN necessity = 'required' THEN 'TOKENIZE' ELSE 'ABSTRACT' END
  WHEN category IN ('financial','aadhaar','dob') THEN 'TOKENIZE' WHEN category = 'health' THEN 'OMIT'
  WHEN category IN ('secret','password','otp','jwt') THEN 'BLOCK'
  WHEN (tier = 'checksum-verified' AND confidence >= 0.9) OR (tier = 'pattern-matched' AND confidence >= 0.7) THEN 'TOKENIZE' ELSE 'ABSTRACT' END AS decision
FROM m
"""


@QUERIES.add(_MATRIX)
def policy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The decision of every case that the events stand for, and how many do."""
    cases = chosen(table(spark, folder, "events"), "event_id", _CHOICES).groupBy(*_CHOICES).agg(F.count(F.lit(1)).alias("n"))
    return cases.withColumn("decision", policy.decision(*[F.col(c) for c in _CHOICES]))



_PHRASES = " OR ".join("contains(lower(text), '" + p + "')" for p in policy.INJECTION)


@QUERIES.add(f"SELECT conv_id, turn, coalesce({_PHRASES}, false) AS injection FROM conversations")
def injection_flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", policy.injected(F.col("text")).alias("injection"))


@QUERIES.add(
    twins.detections_sql(twins.DOCUMENTS)
    + f""" SELECT category, {twins._case(policy.REDACTION_CATEGORY, "'unknown'")} AS redaction, {twins._case(policy.REDACTION_SHAPE, "'text'")} AS shape,
    {twins._case(policy.ABSTRACTION, "'[' || category || ' value]'")} AS wording, count(*) AS n FROM det GROUP BY category"""
)
def redaction_maps(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("category")
    return detect(documents(spark, folder), "doc_id").groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
        "category", policy.lookup(policy.REDACTION_CATEGORY, c, F.lit("unknown")).alias("redaction"), policy.lookup(policy.REDACTION_SHAPE, c, F.lit("text")).alias("shape"),
        policy.lookup(policy.ABSTRACTION, c, F.concat(F.lit("["), c, F.lit(" value]"))).alias("wording"), "n",
    )


#: Ten documents by number are an envelope: the first is the task, the others its nodes.
_ENVELOPES = f"""SELECT envelope, blocked, CASE WHEN blocked THEN 'high' WHEN injected OR n > 5 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS risk, CAST(n AS BIGINT) AS n_redactions, CASE WHEN blocked THEN 0 ELSE n_nodes END AS n_nodes,
  CASE WHEN blocked THEN '' ELSE task END AS sanitized_task, CASE WHEN blocked THEN '' ELSE nodes END AS nodes_sha256 FROM (
 SELECT key // 10 AS envelope, first_block IS NOT NULL AS blocked, sum(CASE WHEN key <= coalesce(first_block, key) THEN n_redactions ELSE 0 END) AS n, count(*) FILTER (key % 10 <> 0) AS n_nodes, coalesce(max(CASE WHEN key % 10 = 0 THEN sanitized END), '') AS task,
  coalesce(bool_or(key % 10 = 0 AND injected), false) AS injected, coalesce(sha256(string_agg(sha256(sanitized), ',' ORDER BY key) FILTER (key % 10 <> 0)), sha256('')) AS nodes
 FROM (SELECT *, min(CASE WHEN blocked THEN key END) OVER (PARTITION BY key // 10) AS first_block FROM (SELECT s.*, {' OR '.join(f"contains(lower(d.text), '{p}')" for p in policy.INJECTION)} AS injected FROM ({twins.sanitized_sql()}) s JOIN documents d ON s.key = d.doc_id)) GROUP BY key // 10, first_block)"""


@QUERIES.add(_ENVELOPES)
def sanitized_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """A task and its nodes sanitized together: what is blocked ends the envelope."""
    docs = documents(spark, folder)
    rows = policy.sanitize(docs, "doc_id").join(docs.select(F.col("doc_id").alias("key"), planning.any_of([F.contains(F.lower("text"), F.lit(p)) for p in policy.INJECTION]).alias("injected")), "key")
    rows = rows.withColumn("envelope", F.floor(F.col("key") / 10))
    ends = rows.where("blocked").groupBy("envelope").agg(F.min("key").alias("first_block"))
    task = F.col("key") % 10 == 0
    # An envelope has nine nodes at most, so their hashes are a short list.
    out = rows.join(ends, "envelope", "left").groupBy("envelope").agg(
        F.max("first_block").isNotNull().alias("blocked"), F.sum(F.when(F.col("key") <= F.coalesce("first_block", "key"), F.col("n_redactions")).otherwise(0)).alias("n"), F.count(F.when(~task, 1)).alias("n_nodes"),
        F.coalesce(F.max(F.when(task, F.col("sanitized"))), F.lit("")).alias("task"), F.coalesce(F.bool_or(task & F.col("injected")), F.lit(False)).alias("injected"),
        F.array_sort(F.collect_list(F.when(~task, F.struct("key", F.sha2("sanitized", 256).alias("h"))))).alias("nodes"),
    )
    blocked = F.col("blocked")
    risk = F.when(blocked | F.col("injected") | (F.col("n") > 5), "high").when(F.col("n") > 0, "medium").otherwise("low")
    return out.select(
        "envelope", "blocked", risk.alias("risk"), F.col("n").cast("bigint").alias("n_redactions"), F.when(blocked, 0).otherwise(F.col("n_nodes")).alias("n_nodes"), F.when(blocked, "").otherwise(F.col("task")).alias("sanitized_task"),
        F.when(blocked, "").otherwise(F.sha2(F.array_join(F.transform("nodes", lambda x: x["h"]), ","), 256)).alias("nodes_sha256"),
    )
