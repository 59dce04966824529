"""Rules over tasks, targets, actions and pages, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search phrases, their order, and keyword lists of risky targets.
SEARCH = (r"search\s+for", r"search", r"find", r"look\s+for", r"look\s+up", r"browse\s+for")
KEYWORDS = {
    "submit": ("submit", "confirm submission", "submit application", "confirm order", "place order", "apply", "register", "sign up", "create account"),
    "payment": ("pay", "pay now", "purchase", "checkout", "check out", "complete purchase", "buy", "buy now", "donate", "complete payment", "process payment"),
    "destructive": ("delete", "permanently delete", "erase", "remove permanently", "destroy", "wipe", "discard permanently"),
    "send": ("send", "send message", "send email", "transfer", "transfer funds", "send money", "wire transfer", "send payment", "submit message", "post message"),
}
CODE = (
    r"\bfunction\s*\(", r"\beval\s*\(", r"\bdocument\.(?:write|cookie|location)", r"\bwindow\.(?:open|location)", r"\bfetch\s*\(", r"\bXMLHttpRequest",
    r"\bimport\s*\(", r"\brequire\s*\(", r"(?i)<script", r"(?i)javascript:", r"on\w+\s*=",
)
RISK = {"scroll": "low", "focus": "low", "wait": "low", "request_observation": "low", "finish": "low", "click": "medium", "type_text": "medium", "select": "medium", "type_token": "high"}
HTTP_STATUS = {
    "provider_http_error": 502, "provider_request_failed": 504, "provider_response_invalid": 502,
    "content_extraction_failed": 502, "planner_json_parse_failed": 502, "planner_action_parse_failed": 502,
}


def any_of(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def is_search(task: Column) -> Column:
    return any_of([task.rlike(rf"(?i)\b{p}\b") for p in SEARCH])


def search_query(task: Column) -> Column:
    """What follows the first search phrase that has something after it."""
    found = [F.regexp_extract(task, rf"(?i)\b{p}\s+(.+)", 1) for p in SEARCH]
    return F.coalesce(*[F.when(f != "", F.trim(f)) for f in found])


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def names_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether the text is, starts with, or first holds as whole words a keyword.

    Only a keyword's first occurrence is examined for blanks around it.
    """
    tests = []
    for k in keywords:
        at = F.instr(text, F.lit(k))
        before = (at == 1) | F.substring(text, at - 1, F.lit(1)).rlike(r"\s")
        after = (at + len(k) > F.length(text)) | F.substring(text, at + len(k), F.lit(1)).rlike(r"\s")
        tests.append((text == k) | text.startswith(k + " ") | text.startswith(k + "\t") | ((at > 0) & before & after))
    return any_of(tests)


def action_risk(kind: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in RISK.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, kind), F.lit("critical"))


def has_code(text: Column) -> Column:
    return any_of([text.rlike(p) for p in CODE])


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, blanks are squeezed."""
    out = html
    for pattern, to in ((r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (r"<[^>]+>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


#: What read text is, in order: pattern, class, label (null: the text
#: itself) and confidence; and classes of regions by words, in order.
TEXT_KINDS = (
    (r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "text", "email address", 0.95), (r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "text", "phone number", 0.9),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "identifier", "card number", 0.9), (r"(?i)\b(?:acc(?:ount)?|id|no|number)[\s:#]*\d{5,}", "identifier", "account number", 0.8),
    (r"(?i)^\s*(?:pay\s*now|submit|confirm|send|buy|purchase|checkout)", "payment-control", None, 0.85), (r"(?i)^\s*(?:sign\s*in|log\s*in|sign\s*up|register|subscribe|next|continue|ok|cancel)", "control", None, 0.8),
    (r"\b\d{4}\s\d{4}\s\d{4}\b", "identifier", "identity number", 0.8), (r"\b[A-Z]{5}\d{4}[A-Z]\b", "identifier", "tax identifier", 0.85),
)
REGION_CLASSES = (("face", ("face",)), ("qr", ("qr", "barcode")), ("document", ("document", "card")), ("signature", ("signature",)), ("control", ("button", "control")), ("payment-control", ("payment", "pay")), ("text", ("text", "label")), ("image", ("image", "photo")))


def text_kind(text: Column) -> Column:
    """class, label and confidence of read text."""
    bare = F.trim(text)
    made = lambda c, label, n: F.struct(F.lit(c).alias("class"), (bare if label is None else F.lit(label)).alias("label"), F.lit(n).alias("confidence"))
    out = F.struct(F.lit("text").alias("class"), F.trim(F.substring(text, 1, 50)).alias("label"), F.lit(0.5).alias("confidence"))
    for pattern, c, label, n in reversed(TEXT_KINDS):
        out = F.when(text.rlike(pattern), made(c, label, n)).otherwise(out)
    return out


def region_class(name: Column) -> Column:
    out, low = F.lit("unknown"), F.lower(name)
    for c, words in reversed(REGION_CLASSES):
        out = F.when(any_of([F.contains(low, F.lit(w)) for w in words]), c).otherwise(out)
    return out
