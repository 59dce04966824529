"""Answers of a planner: their text in any shape, and what follows their JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status codes of the ways to fail.
STATUS = {"provider_http_error": 502, "provider_request_failed": 504, "provider_response_invalid": 502, "content_extraction_failed": 502, "planner_json_parse_failed": 502, "planner_action_parse_failed": 502}
#: A text in JSON's terms: strings, brackets one by one, and runs of all else.
PIECES = r'"(?:[^"\\]|\\.)*+"|[{}\[\]]|[^"{}\[\]]++|"'
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
BLANKS = " \t\n\r\f\v"


def contents(response: Column) -> tuple[Column, Column, Column]:
    """Shape, text and error of an answer's content.

    The content is a text, or an array of texts and of typed parts, of which those
    of type text count; the parts are put together. Exactly one of text and error
    is null.
    """
    get = lambda path, kind: F.try_variant_get(response, path, kind)
    kind = lambda v: F.schema_of_variant(v)
    choices, message, content = get("$.choices", "array<variant>"), get("$.choices[0].message", "variant"), get("$.choices[0].message.content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    plain = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    typed = lambda v: F.when(F.try_variant_get(v, "$.type", "string") == "text", plain(F.try_variant_get(v, "$.text", "variant")))
    texts = F.array_compact(F.transform(parts, lambda v: F.coalesce(plain(v), typed(v))))
    dicts, strings = F.exists(parts, lambda v: kind(v).startswith("OBJECT")), F.exists(parts, lambda v: kind(v) == "STRING")
    listed = kind(content).startswith("ARRAY")
    error = (
        F.when(F.coalesce(F.size(choices), F.lit(0)) <= 0, "no choices in provider response").when(~F.coalesce(kind(message).startswith("OBJECT"), F.lit(False)) | (kind(message) == "OBJECT<>"), "no message in first choice")
        .when(content.isNull() | (kind(content) == "VOID"), "message content is null").when(kind(content) == "STRING", None).when(~listed, "unsupported content type")
        .when(F.size(parts) == 0, "message content is empty array").when(F.size(texts) == 0, "content array contains no text-bearing elements")
    )
    shape = F.when(error.isNotNull(), None).when(~listed, "string").when(dicts & ~strings, "text_parts[]").when(strings & ~dicts, "string_parts[]").otherwise("mixed_parts[]")
    text = F.when(error.isNotNull(), None).when(listed, F.array_join(texts, "")).otherwise(plain(content))
    return shape, text, error


def unfenced(text: Column) -> Column:
    """Without blanks around it and without the marks of a code block."""
    bare = F.btrim(text, F.lit(BLANKS))
    lines = F.split(bare, "\n")
    tail = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    closed = F.btrim(F.coalesce(F.get(tail, F.size(tail) - 1), F.lit("")), F.lit(BLANKS)) == "```"
    inner = F.when(closed, F.slice(tail, 1, F.size(tail) - 1)).otherwise(tail)
    return F.when(bare.startswith("```"), F.btrim(F.array_join(inner, "\n"), F.lit(BLANKS))).otherwise(bare)


def first_json(text: Column) -> Column:
    """Where the JSON value ends with which a text begins, null if it begins with
    none: brackets outside strings are counted piece by piece until all are closed."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        at = acc["at"] + F.length(piece)
        return F.when(acc["end"].isNotNull(), acc).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when((depth == 0) & piece.isin("}", "]"), at).alias("end")))

    held = F.aggregate(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), zero, step)["end"]
    scalar = F.coalesce(*[F.nullif(F.length(F.regexp_extract(text, p, 0)), F.lit(0)) for p in (r'^"(?:[^"\\]|\\.)*+"', NUMBER, "^(?:true|false|null)")])
    end = F.when(text.startswith("{") | text.startswith("["), held).otherwise(scalar)
    return F.when(F.try_parse_json(F.substring(text, F.lit(1), end)).isNotNull(), end)


def trailing(text: Column, end: Column) -> Column:
    """What stands behind the first value: none, whitespace_only, second_json_value,
    trailing_prose_or_text or malformed_trailing_data; null without a first value."""
    rest = F.substring(text, end + 1, F.length(text))
    bare = F.ltrim(rest, F.lit(BLANKS))
    return (
        F.when(end.isNull(), None).when(rest == "", "none").when(bare == "", "whitespace_only").when(first_json(bare).isNotNull(), "second_json_value")
        .when(bare.rlike(r"^\p{L}"), "trailing_prose_or_text").otherwise("malformed_trailing_data")
    )
