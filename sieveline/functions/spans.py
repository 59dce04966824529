"""Places of pattern matches, overlap resolution and text rebuilding, JVM-side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: \b over ASCII word characters; Java's own \b also knows other letters.
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
#: Sums are taken in blocks of this many, so that many matches stay cheap.
BLOCK = 256


#: \b before what starts with a word character, and behind what ends with one.
_OPENING = re.compile(r"^((?:\(\?i\))?)\\b(?=\\d|\[A-Z|\[6-9|[A-Za-z]|\(\?:[a-zA-Z])")
_CLOSING = re.compile(r"((?:\\d|\[(?:A-Z|a-z|0-9)+\])(?:\{[\d,]+\})?(?:\)\??)?)\\b$")


def java(pattern: str) -> str:
    """The pattern with ASCII word boundaries; those at its ends, where one side
    is known, look at one character only."""
    pattern = _OPENING.sub(r"\1(?<![0-9A-Za-z_])", pattern)
    pattern = _CLOSING.sub(r"\1(?![0-9A-Za-z_])", pattern)
    return pattern.replace(r"\b", BOUNDARY)


def running_sums(values: Column) -> Column:
    """Sums of all values up to each, itself included."""
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
    count = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count),
        lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"))),
    )
    before = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["s"] + b["s"]).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]
    return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(b["a"], lambda v: v + o)))


def with_matches(df: DataFrame, name: str, patterns: Sequence[str], gates: Sequence[Column], text: str = "text") -> DataFrame:
    """Adds ``name``: array of (ord, value, start, end), all matches of all
    patterns; ord counts the patterns from 0.

    Each gate is a cheap predicate that holds wherever its pattern matches, so
    most texts are never searched. Places are code points; no pattern may match
    the empty string.
    """
    known = F.array(*[F.lit(p) for p in patterns])
    tried = [F.struct(F.lit(i).alias("ord"), F.when(gate, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("m")) for i, (p, gate) in enumerate(zip(patterns, gates, strict=True))]
    df = df.withColumn("_m", F.filter(F.array(*tried), lambda x: F.size(x["m"]) > 0))
    df = df.withColumn("_m", F.transform("_m", lambda x: F.struct(x["ord"].alias("ord"), x["m"].alias("m"), F.split(F.col(text), F.element_at(known, x["ord"] + 1)).alias("g"))))

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["g"], 1, F.size(x["m"])), x["m"], lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))
        return F.zip_with(x["m"], running_sums(lengths), lambda v, end: F.struct(x["ord"].alias("ord"), v.alias("value"), (end - F.length(v)).alias("start"), end.alias("end")))

    return df.withColumn(name, F.flatten(F.transform("_m", placed))).drop("_m")


def resolve_overlaps(spans: Column, kind: str) -> Column:
    """Greedy choice in the given order: a span that shares a character with an
    accepted one goes. ``kind`` is the array's type; spans have start and end."""
    empty = F.array().cast(kind)
    return F.aggregate(spans, empty, lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s))))


def rebuild(text: Column, spans: Column, replacement: Column) -> Column:
    """``text`` with disjoint, sorted spans replaced by the strings of
    ``replacement``, an array of the same length."""
    pairs = F.zip_with(spans, replacement, lambda s, r: F.struct(s["start"].alias("start"), s["end"].alias("end"), r.alias("r")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int"))
        return F.struct(F.concat(acc["out"], gap, x["r"]).alias("out"), x["end"].alias("pos"))

    done = F.aggregate(pairs, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
