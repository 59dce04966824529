"""Personal data and secrets: patterns, checksums and contexts, by confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import luhn, mod97, verhoeff
from ..functions.spans import java, resolve_overlaps, with_matches


@dataclass(frozen=True)
class Detector:
    """A pattern with its category, tier, confidence and rule.

    gate: text that is somewhere in every match (a pattern itself). also: plain
    text that every match has too. group: the match's part that is reported,
    sought in it from the front or the back. check: a checksum or test, and what
    it changes or drops.
    """

    category: str
    tier: str
    confidence: float
    rule: str
    pattern: str
    gate: str = "[0-9]"
    group: str = ""
    check: str = ""
    also: str = ""


#: Categories, patterns, confidences and rules, in their order.
DETECTORS = (
    Detector("email", "pattern-matched", 0.95, "email-pattern", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "@"),
    Detector("credit-card", "pattern-matched", 0.8, "cc-pattern", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", check="luhn", gate=r"[0-9]{4}[\s-]?[0-9]{4}"),
    Detector("account-number", "pattern-matched", 0.92, "account-number-16digit-non-luhn", r"\b\d{16}\b", check="not luhn", gate="[0-9]{16}"),
    Detector("account-number", "context-inferred", 0.80, "account-number-context", r"(?i)\b(?:account|acc|a\/c|beneficiary|acct)\b[^\S\r\n]*(?:no\.?|num(?:ber)?)?[^\S\r\n]*[:\-]?[^\S\r\n]*(\d{9,18})\b", group="front", gate="[0-9]{9}"),
    Detector("aadhaar", "pattern-matched", 0.88, "aadhaar-pattern", r"\b\d{4}\s\d{4}\s\d{4}\b", check="verhoeff", gate=r"[0-9]{4}\s[0-9]{4}\s[0-9]{4}"),
    Detector("pan", "pattern-matched", 0.9, "pan-pattern", r"\b[A-Z]{5}\d{4}[A-Z]\b", gate="[A-Z]{5}[0-9]{4}"),
    Detector("ifsc", "pattern-matched", 0.9, "ifsc-pattern", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", gate="[A-Z]{4}0"),
    Detector("iban", "pattern-matched", 0.8, "iban-pattern", r"\b[A-Z]{2}\d{2}\s?[A-Z0-9]{4}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b", check="mod97", gate="[A-Z]{2}[0-9]{2}"),
    Detector("otp", "context-inferred", 0.82, "otp-context", r"(?i)\b(?:otp|one.?time.?(?:pass(?:word|code)?|code|pin))\s*[:\-]?\s*(\d{4,8})\b", group="back"),
    Detector("otp", "context-inferred", 0.82, "otp-context", r"(?i)\b(?:verification|verify|auth(?:entication)?)\s+(?:code|pin|otp)\s+(?:is\s*[:\-]?\s*)?(\d{4,8})\b", group="back"),
    Detector("otp", "context-inferred", 0.82, "otp-context", r"(?i)\bcode\s+is\s*[:\-]?\s*(\d{4,8})\b", group="back"),
    Detector("password", "context-inferred", 0.75, "password-context-complexity", r"(?i)\b(?:password|passwd|pwd|pass)\b[^\S\r\n]*(?:[=:\-]\s*|\s+)([^\s]{8,64})", "(?i)pass|pwd", group="front", check="complex"),
    Detector("address", "context-inferred", 0.72, "indian-address-pattern", r"\b\d{1,4}\s+[A-Za-z][A-Za-z\s.-]{3,40},\s*[A-Za-z][A-Za-z\s]{2,25},\s*[A-Za-z][A-Za-z\s]{2,25}\s+\d{6}\b", r"[0-9]{6}", also=","),
    Detector("address", "context-inferred", 0.72, "indian-address-pattern", r"\b[A-Za-z][A-Za-z\s.-]{3,40},\s*[A-Za-z][A-Za-z\s]{2,25}\s*[-–]\s*\d{6}\b", r"[-–]\s*[0-9]{6}", also=","),
    Detector("jwt", "pattern-matched", 0.95, "jwt-pattern", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "eyJ"),
    Detector("private-key", "pattern-matched", 0.99, "private-key-header", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "PRIVATE KEY"),
    Detector("api-key", "pattern-matched", 0.9, "api-key-pattern", r"""(?i)\b(?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token)\s*[=:]\s*['"]?([a-zA-Z0-9_\-]{20,})['"]?""", "(?i)key|token"),
    Detector("api-key", "pattern-matched", 0.9, "api-key-pattern", r"\bAIza[0-9A-Za-z_-]{35}\b", "AIza"),
    Detector("api-key", "pattern-matched", 0.9, "api-key-pattern", r"\bsk-[a-zA-Z0-9_-]{20,}\b", "sk-"),
    Detector("api-key", "pattern-matched", 0.9, "api-key-pattern", r"\bghp_[a-zA-Z0-9]{36}\b", "ghp_"),
    Detector("api-key", "pattern-matched", 0.9, "api-key-pattern", r"\bAKIA[0-9A-Z]{16}\b", "AKIA"),
    Detector("ssn", "pattern-matched", 0.7, "ssn-pattern", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", gate=r"[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}"),
    Detector("phone", "pattern-matched", 0.85, "phone-pattern", r"(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}", gate=r"[6-9][0-9]{4}[\s-]?[0-9]{5}"),
    Detector("phone", "pattern-matched", 0.85, "phone-pattern", r"(?:\+1[\s-]?)?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}", gate=r"[0-9]{3}[\s-]?[0-9]{4}"),
    Detector("phone", "pattern-matched", 0.85, "phone-pattern", r"(?:\+\d{1,3}[\s-]?)?\d{4,5}[\s-]?\d{4,6}", gate=r"[0-9]{4}[\s-]?[0-9]{4}"),
)
#: Every gate's matches have one of these: a character, a text, or a text once lower-cased.
ANY_CHARACTER, ANY_TEXT, ANY_LOWER = "[0-9@]", ("eyJ", "AIza", "sk-", "ghp_", "AKIA"), ("pass", "pwd", "key", "token")
#: What a passed checksum makes of a detection.
UPGRADES = {"luhn": (0.98, "cc-luhn-verified"), "verhoeff": (0.95, "aadhaar-verhoeff-verified"), "mod97": (0.98, "iban-mod97-verified")}
SPAN = "array<struct<category:string,tier:string,confidence:double,start:bigint,end:bigint,matched:string,rule:string,ord:int>>"


def _complex(value: Column) -> Column:
    """At least three of: upper case, lower case, digit, special character."""
    classes = ("[A-Z]", "[a-z]", "[0-9]", r"[!@#$%^&*()_+\-=\[\]{}|;:<>?,./]")
    return sum((value.rlike(c).cast("int") for c in classes), F.lit(0)) >= 3


def _setting(name: str, ord_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(d, name)) for d in DETECTORS]), ord_ + 1)


def _detection(m: Column) -> Column:
    """A match as a detection: its group, and what its check makes of it."""
    full, ord_ = m["value"], m["ord"]
    group, check = _setting("group", ord_), _setting("check", ord_)
    inner = full
    for i, d in enumerate(DETECTORS):
        if d.group:
            inner = F.when(ord_ == i, F.regexp_extract(full, java(d.pattern), 1)).otherwise(inner)
    value = F.when(group == "", full).when(check == "complex", F.regexp_replace(inner, "['\";,]+$", "")).otherwise(inner)
    front = F.instr(full, value) - 1
    back = F.length(full) - F.instr(F.reverse(full), F.reverse(value)) - F.length(value) + 1
    start = m["start"] + F.when(group == "front", front).when(group == "back", back).otherwise(0)
    passed = F.when(check == "luhn", luhn(value)).when(check == "verhoeff", verhoeff(value)).when(check == "mod97", mod97(value)).otherwise(False)
    ok = F.when(check == "not luhn", ~luhn(value)).when(check == "complex", _complex(value)).otherwise(True)
    return F.struct(
        _setting("category", ord_).alias("category"), F.when(passed, "checksum-verified").otherwise(_setting("tier", ord_)).alias("tier"),
        F.when(passed, _upgrade(check, 0)).otherwise(_setting("confidence", ord_)).alias("confidence"), start.cast("bigint").alias("start"),
        (start + F.length(value)).cast("bigint").alias("end"), value.alias("matched"),
        F.when(passed, _upgrade(check, 1)).otherwise(_setting("rule", ord_)).alias("rule"), ord_.alias("ord"), ok.alias("ok"),
    )


def _upgrade(check: Column, part: int) -> Column:
    out = F.lit(None)
    for name, values in UPGRADES.items():
        out = F.when(check == name, values[part]).otherwise(out)
    return out


def with_detections(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds detections: disjoint spans in order of place.

    Of overlapping spans the one with more confidence stays, at a tie the
    earlier, then the one of the earlier detector. Texts under three characters
    and null texts have none. A text that no gate can let through, as most cannot,
    is null for the detectors, so that it is read a few times and not by each gate.

    Spark would copy all of this into a filter on the number of detections and run it
    twice, each step as often as it is named; it does not take apart a projection that
    names the partition.
    """
    here = F.spark_partition_id() >= 0
    columns = df.columns
    df = df.withColumn("_low", F.lower(text))
    some = F.col(text).rlike(ANY_CHARACTER)
    for column, parts in ((text, ANY_TEXT), ("_low", ANY_LOWER)):
        for part in parts:
            some = some | F.contains(column, F.lit(part))
    df = df.withColumn("_text", F.when(some & here, F.col(text)))
    long, text_ = F.length("_text") >= 3, F.col("_text")
    df = with_matches(df, "_all", [java(d.pattern) for d in DETECTORS], [long & text_.contains(d.also) & text_.rlike(d.gate) for d in DETECTORS], "_text")
    df = df.withColumn("_all", F.filter(F.transform("_all", _detection), lambda s: s["ok"]))
    fields = ("category", "tier", "confidence", "start", "end", "matched", "rule", "ord")
    ranked = F.array_sort(F.transform("_all", lambda s: F.struct((-s["confidence"]).alias("c"), s["start"].alias("st"), s["ord"].alias("o"), F.struct(*[s[f].alias(f) for f in fields]).alias("s"))))
    df = df.withColumn("_all", F.transform(ranked, lambda x: x["s"]))
    df = df.withColumn("_all", resolve_overlaps(F.col("_all"), SPAN))
    by_place = F.transform(F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("st"), s.alias("s")))), lambda x: x["s"])
    return df.withColumn("detections", F.coalesce(F.when(here, by_place), F.array().cast(SPAN))).select(*columns, "detections")


def detect(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per detection: key, category, tier, confidence, start_off, end_off,
    matched, rule."""
    found = with_detections(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return found.select("key", F.explode("detections").alias("d")).select(
        "key", "d.category", "d.tier", "d.confidence", F.col("d.start").alias("start_off"), F.col("d.end").alias("end_off"), "d.matched", "d.rule"
    )
