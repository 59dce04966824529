"""Detectors and context scores fused into decisions, and texts rewritten by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy, semantic
from .detectors import with_detections

#: The confidence from which a detection covers context scores, the
#: confidence from which a score is protected whatever its risk, and the family
#: of each detector's category.
COVERING, SURE = 0.85, 0.75
FAMILY = {
    "email": "contact", "phone": "contact", "address": "location", "credit-card": "financial", "account-number": "financial", "aadhaar": "identity_document", "pan": "identity_document",
    "ifsc": "financial", "iban": "financial", "password": "authentication", "otp": "authentication", "api-key": "authentication", "jwt": "authentication", "private-key": "authentication", "ssn": "identity_document",
}
DECISION = "array<struct<place:bigint,semantic:int,ord:int,category:string,subtype:string,confidence:double,start:bigint,end:bigint,policy:string>>"


def with_decisions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, text and decisions, in the order in which a text is rewritten.

    Every detection is protected. A context score is left out where a detection
    of at least ``COVERING`` spans its window; else it is protected if it is sure
    or of high risk, and allowed otherwise. Decisions stand from the last start
    to the first, detections before scores. Only the scores of a text, a few for
    each window, are gathered beside it.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(semantic.TAXONOMY) for x in (s.subtype, i)])
    scores = semantic.detections(rows, "key").groupBy("key").agg(F.collect_list(F.struct("start", "subtype", "category", "confidence", "risk")).alias("scores"))
    found = with_detections(rows).join(scores, "key", "left")
    sure = F.transform("detections", lambda d: F.struct(
        (-d["start"]).alias("place"), F.lit(0).alias("semantic"), d["ord"].alias("ord"), policy.lookup(FAMILY, d["category"], d["category"]).alias("category"), d["category"].alias("subtype"),
        d["confidence"].alias("confidence"), d["start"].alias("start"), d["end"].alias("end"), F.lit("tokenize").alias("policy"),
    ))

    def scored(s: Column) -> Column:
        end = F.least(s["start"] + semantic.WINDOW, F.length("text").cast("bigint"))
        what = F.when((s["confidence"] >= SURE) | s["risk"].isin("high", "critical"), "tokenize").otherwise("allow")
        return F.struct(
            (-s["start"]).alias("place"), F.lit(1).alias("semantic"), F.element_at(order, s["subtype"]).alias("ord"), s["category"].alias("category"), s["subtype"].alias("subtype"),
            s["confidence"].alias("confidence"), s["start"].alias("start"), end.alias("end"), what.alias("policy"),
        )

    covered = lambda s: F.exists("detections", lambda d: (d["confidence"] >= COVERING) & (d["start"] <= s["start"]) & (d["end"] >= s["end"]))
    open_ = F.filter(F.transform(F.coalesce("scores", F.array().cast("array<struct<start:bigint,subtype:string,category:string,confidence:double,risk:string>>")), scored), lambda s: ~covered(s))
    return found.select("key", "text", F.array_sort(F.concat(sure.cast(DECISION), open_.cast(DECISION))).alias("decisions"))


def decisions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per decision: key, source, category, subtype, confidence, start_off,
    end_off, policy."""
    rows = with_decisions(df, key, text).select("key", F.explode("decisions").alias("d"))
    return rows.select("key", F.when(F.col("d.semantic") == 1, "semantic").otherwise("deterministic").alias("source"), "d.category", "d.subtype", "d.confidence", F.col("d.start").alias("start_off"), F.col("d.end").alias("end_off"), "d.policy")


def sanitize(df: DataFrame, key: str, text: str = "text", salt: str = "salt", necessity: str = "unknown") -> DataFrame:
    """key, blocked, n_redactions, sanitized: texts for the remote recipient.

    Protected spans are replaced from the last start to the first, each in the
    text as it then is, by what the policy says of their subtype. A text with a
    blocked span comes out empty.
    """
    rows = with_decisions(df, key, text).withColumn("d", F.filter("decisions", lambda d: d["policy"] != "allow"))

    def what(d: Column) -> Column:
        tier = F.when(d["semantic"] == 1, "context-inferred").otherwise("pattern-matched")
        return policy.decision(d["subtype"], tier, d["confidence"], F.lit(necessity), F.lit("remote-planner"), F.lit("none"), F.lit(False))

    def marker(d: Column) -> Column:
        group = policy.lookup(policy.REDACTION_CATEGORY, d["subtype"], F.lit("unknown"))
        word = policy.lookup(policy.ABSTRACTION, d["subtype"], F.concat(F.lit("["), d["subtype"], F.lit(" value]")))
        return F.when(what(d) == "OMIT", F.concat(F.lit("[OMITTED:"), group, F.lit("]"))).when(what(d) == "ABSTRACT", word).otherwise(policy.token(salt, F.col("key"), d["start"], d["subtype"]))

    def put(out: Column, d: Column) -> Column:
        head = F.substring(out, F.lit(1), d["start"].cast("int"))
        return F.concat(head, d["r"], F.substring(out, (d["end"] + 1).cast("int"), F.length(out)))

    rows = rows.withColumn("blocked", F.exists("d", lambda d: what(d) == "BLOCK"))
    rows = rows.withColumn("steps", F.transform("d", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), marker(d).alias("r"))))
    done = F.when(F.col("blocked"), "").when(F.size("d") == 0, F.col("text")).otherwise(F.aggregate("steps", F.col("text"), put))
    return rows.select("key", "blocked", F.size("d").cast("long").alias("n_redactions"), done.alias("sanitized"))
