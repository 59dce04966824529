"""License scans with a positional index of rare words.

Templates are notices; some of a template's words are its mandatory key phrase.
Words weigh by their inverse document frequency over the whole corpus. Of every
file those licence words are looked up that weigh most among the words of a key
phrase which the file has in full; their postings give alignments (template,
offset). Around each the template's words are looked up at their relative places
and the key phrase must stand there in full. A notice that is in a file always
has its heaviest key word looked up, so none is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, alnum_words, ascii_lower, materialize, row_key


@dataclass(frozen=True)
class Template:
    """label, words of the notice, words of its key phrase (a part of it)."""

    label: str
    words: str
    key: str
    base: bool = False


#: Phrases and labels of the base rule.
BASE = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
)
#: Notices of public licenses, without punctuation.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied", "shall be included in all copies or substantial portions of the software"),
    Template("mit", "released under the mit license", "under the mit license"),
    Template("apache", "licensed under the apache license version 2 0", "the apache license"),
    Template("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "software and accompanying documentation covered by this license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by", "licensed under cc by 4 0", "under cc by 4"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "under cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "under cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "under cc by nd"),
)
#: Share of a notice's words that must stand at their places.
LEAST_SHARE = 0.6


def _key_at(t: Template) -> int:
    words, key = t.words.split(), t.key.split()
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def licenses(docs: DataFrame, notices: Sequence[Template] = NOTICES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Licenses that every document names or quotes.

    Returns one row per row of ``docs``: doc_id, n_words, n_base (places of base
    phrases), first_word and last_word (their smallest and largest start, null
    if none), base_labels, labels (with those of notices), score. The score is
    the largest share of a notice found, one half for a base phrase alone, else
    zero. A null or empty text has no words; texts of any length are read whole;
    repeated rows each get a row; an empty table gives an empty result. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    templates = [*BASE, *notices]
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    known = F.array(*map(F.lit, vocabulary))
    # A key phrase can only stand where its least common letters do: one long
    # word of each guards the positional scan, and no match lacks it.
    guards = sorted({max(t.key.split(), key=len) for t in templates})
    rows = docs.select("doc_id", *row_key(docs), "text", alnum_words(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    rows = rows.withColumn("known", F.array_intersect(F.transform("w", lambda x: F.lower(x)), known))
    rows = rows.withColumn("guarded", F.arrays_overlap("known", F.array(*map(F.lit, guards)))).drop("w")
    rows = rows.withColumn("low", F.when(F.col("guarded"), alnum_words(ascii_lower(F.col("text"))))).drop("text")
    placed = F.filter(F.transform("low", lambda x, i: F.struct(x.alias("word"), i.alias("pos"))), lambda s: F.array_contains(known, s["word"]))
    scanned = materialize(rows.select("doc_id", *ROW_KEY, "n_words", "known", placed.alias("placed")), "scan")

    # One count per word of the vocabulary comes to the driver.
    frequency = dict(scanned.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())
    index, lookups = [], []
    for number, t in enumerate(templates):
        words, key, at = t.words.split(), t.key.split(), _key_at(t)
        rare = min(range(at, at + len(key)), key=lambda i, words=words: (frequency.get(words[i], 0), i))
        has_key = F.size(F.array_except(F.array(*map(F.lit, sorted(set(key)))), "known")) == 0
        lookups.append(F.when(has_key, F.struct(F.lit(words[rare]).alias("word"), F.lit(number).alias("template"), F.lit(rare).alias("place"))))
        index += [(number, i, w, int(at <= i < at + len(key))) for i, w in enumerate(words)]
    index = spark.createDataFrame(index, "template int, place int, word string, mandatory int")
    about = spark.createDataFrame([(i, t.label, t.base, len(t.words.split()), len(t.key.split())) for i, t in enumerate(templates)], "template int, label string, base boolean, size int, key_size int")

    guarded = scanned.where("placed is not null")
    words = materialize(guarded.select(*ROW_KEY, F.explode("placed").alias("s")).select(*ROW_KEY, "s.*").distinct(), "words")
    asked = guarded.select(*ROW_KEY, F.explode(F.array_compact(F.array(*lookups))).alias("t")).select(*ROW_KEY, "t.*").distinct()
    aligned = words.join(asked, [*ROW_KEY, "word"]).select(*ROW_KEY, "template", (F.col("pos") - F.col("place")).alias("offset")).distinct()
    expected = aligned.join(index, "template").withColumn("pos", F.col("offset") + F.col("place"))
    matched = expected.join(words.withColumn("hit", F.lit(1)), [*ROW_KEY, "pos", "word"], "left")
    scored = matched.groupBy(*ROW_KEY, "template", "offset").agg(F.count("hit").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("mandatory")).otherwise(0)).alias("m")).join(about, "template")
    good = scored.where((F.col("m") == F.col("key_size")) & (F.col("n") >= least_share * F.col("size")))
    base = F.when(F.col("base"), F.col("offset"))
    found = good.groupBy(*ROW_KEY).agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(F.col("base"), 0.5).otherwise(F.round(F.col("n") / F.col("size"), 4))).alias("score"),
    )
    found = materialize(found, "found")
    return scanned.select("doc_id", *ROW_KEY, "n_words").join(found, ROW_KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
