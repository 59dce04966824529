"""Recipient-aware policy, category maps and text sanitizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import rebuild
from .detectors import with_detections

#: Groups of categories that the policy treats alike.
HIGH_RISK = ("credential", "payment", "biometric", "credit-card", "iban", "ifsc", "account-number")
CONTACT = ("contact", "email", "phone")
IDENTITY = ("financial", "identity-document", "aadhaar", "pan", "ssn", "dob")
SECRET = ("secret", "password", "otp", "cvv", "private-key", "api-key", "jwt", "cloud-credential")
#: Redaction category, shape and wording of each category.
REDACTION_CATEGORY = {
    "email": "contact", "phone": "contact", "address": "contact",
    "credit-card": "payment", "iban": "payment", "ifsc": "payment", "account-number": "payment",
    "password": "credential", "otp": "credential", "api-key": "credential", "jwt": "credential", "private-key": "credential", "cloud-credential": "credential",
    "aadhaar": "identity-document", "pan": "identity-document", "ssn": "identity-document", "dob": "identity-document",
    "face": "biometric",
}
REDACTION_SHAPE = {
    "email": "email", "phone": "phone", "credit-card": "card", "aadhaar": "numeric-code", "pan": "numeric-code",
    "ssn": "numeric-code", "account-number": "numeric-code", "address": "address", "face": "image",
}
ABSTRACTION = {
    "email": "[an email address]", "phone": "[a phone number]", "address": "[a physical address]", "contact": "[contact information]",
    "credit-card": "[a payment card number]", "iban": "[a bank account number]", "ifsc": "[a bank code]", "account-number": "[an account number]",
    "aadhaar": "[an identity number]", "pan": "[a tax identifier]", "ssn": "[a government identifier]", "dob": "[a date of birth]",
    "password": "[a credential]", "otp": "[a one-time code]", "api-key": "[an API key]", "jwt": "[an authentication token]",
    "private-key": "[a private key]", "cloud-credential": "[a cloud credential]", "face": "[biometric data]", "health": "[health information]",
}
#: Phrases of an injected instruction.
INJECTION = (
    "ignore all previous instructions", "ignore previous instructions", "you are now in admin mode", "admin mode", "system prompt",
    "override the privacy", "send all", "output all", "execute:", "eval(", "document.cookie", "window.localstorage",
    "forget your instructions", "disregard above", "new instructions:",
)


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), default)


def decision(category: Column, tier: Column, confidence: Column, necessity: Column, recipient: Column, ambiguity: Column, authorized: Column) -> Column:
    """One of ALLOW_LITERAL, TOKENIZE, ABSTRACT, MASK_VISUAL, OMIT, ASK_LOCAL, BLOCK."""
    required = necessity == "required"
    remote = (
        F.when(category == "face", "MASK_VISUAL")
        .when(category.isin(*HIGH_RISK), F.when(required & (confidence >= 0.7), "TOKENIZE").otherwise("OMIT"))
        .when(category.isin(*CONTACT), F.when(required, "TOKENIZE").otherwise("ABSTRACT"))
        .when(category.isin(*IDENTITY), "TOKENIZE")
        .when(category == "health", "OMIT")
        .when(category.isin(*SECRET), "BLOCK")
        .when((tier == "checksum-verified") & (confidence >= 0.9), "TOKENIZE")
        .when((tier == "pattern-matched") & (confidence >= 0.7), "TOKENIZE")
        .otherwise("ABSTRACT")
    )
    return (
        F.when((ambiguity == "high") | (confidence < 0.3), "OMIT")
        .when(recipient == "remote-planner", remote)
        .when(recipient == "task-website", F.when(authorized, "ALLOW_LITERAL").otherwise("ASK_LOCAL"))
        .when(recipient == "local-logs", "ABSTRACT")
        .otherwise("ALLOW_LITERAL")
    )


def injected(text: Column) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for phrase in INJECTION:
        found = found | F.contains(lower, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def risk_level(has_injection: Column, n_redactions: Column) -> Column:
    return F.when(has_injection | (n_redactions > 5), "high").when(n_redactions > 0, "medium").otherwise("low")


def token(salt: str, key: Column, start: Column, value: Column) -> Column:
    """A keyed hash in place of a random token, so that reruns agree."""
    text = F.concat_ws("|", F.lit(salt), key.cast("string"), start.cast("string"), value)
    return F.concat(F.lit("<SENSITIVE_"), F.upper(F.substring(F.sha2(text, 256), 1, 16)), F.lit(">"))


def sanitize(df: DataFrame, key: str, text: str = "text", salt: str = "salt", necessity: str = "unknown") -> DataFrame:
    """key, blocked, risk, n_redactions, sanitized.

    Deterministic spans are replaced as the remote recipient's policy says; the
    policy is given the tier ``pattern-matched``, whatever a checksum said. A
    text with a blocked span comes out empty.
    """
    found = with_detections(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))

    def decide(d: Column) -> Column:
        return decision(d["category"], F.lit("pattern-matched"), d["confidence"], F.lit(necessity), F.lit("remote-planner"), F.lit("low"), F.lit(False))

    def replace(d: Column) -> Column:
        group = lookup(REDACTION_CATEGORY, d["category"], F.lit("unknown"))
        marker = F.concat(F.lit("[OMITTED:"), group, F.lit("]"))
        word = lookup(ABSTRACTION, d["category"], F.concat(F.lit("["), d["category"], F.lit(" value]")))
        what = decide(d)
        return F.when(what == "OMIT", marker).when(what == "ABSTRACT", word).otherwise(token(salt, F.col("key"), d["start"], d["matched"]))

    decided = found.withColumn("blocked", F.exists("detections", lambda d: decide(d) == "BLOCK")).withColumn("r", F.transform("detections", replace))
    n = F.size("detections").cast("long")
    return decided.select(
        "key", "blocked",
        F.when(F.col("blocked"), "high").otherwise(risk_level(injected(F.col("text")), n)).alias("risk"), n.alias("n_redactions"),
        F.when(F.col("blocked"), "").otherwise(rebuild(F.col("text"), F.col("detections"), F.col("r"))).alias("sanitized"),
    )
