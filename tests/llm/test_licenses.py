import random
import re

from sieveline.llm import licenses

DOCS = "doc_id bigint, text string, labels string"
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_base(text):
    w = words_of(text)
    places = [(i, label) for label, p in BASE.items() for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def plain_labels(text, least=licenses.LEAST_SHARE):
    w, found = words_of(text), set()
    for t in (*licenses.BASE, *licenses.NOTICES):
        tw, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(tw)) if tw[i : i + len(key)] == key)
        for offset in range(-len(tw), len(w)):
            if offset + at >= 0 and w[offset + at : offset + at + len(key)] == key:
                n = sum(0 <= offset + j < len(w) and w[offset + j] == x for j, x in enumerate(tw))
                if n >= least * len(tw):
                    found.add(t.label)
    return ",".join(sorted(found))


def check(spark, rows):
    found = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, _ in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text), text
        assert r.labels == plain_labels(text), text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    return found


def test_notices_and_phrases(spark):
    texts = [
        None, "", "MIT License", "the Mit-LICENSE and the MIT/license.", "Apache\nLicense and General  Public license", "general license public license",
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "GNU Lesser General Public License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and its documentation files",
        "Redistribution and use in source and binary forms are not discussed here at all", "license", "ömit license mit licenseé", "mit license " * 50,
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ]
    found = check(spark, [(i, t, "x") for i, t in enumerate(texts)])
    assert found[6].labels == "cc-by-nc" and found[7].labels == "apache" and found[9].labels == "mit" and found[10].labels == ""


def test_random_word_salad(spark):
    r = random.Random(7)
    pool = sorted({w for t in (*licenses.BASE, *licenses.NOTICES) for w in t.words.split()})
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 4)):
            notice = r.choice(licenses.NOTICES + licenses.BASE).words.split()
            for _ in range(r.randint(0, 5)):
                notice[r.randrange(len(notice))] = r.choice(pool)
            parts += [*r.choices(pool + ["x", "É"], k=r.randint(0, 9)), *notice[: r.randint(1, len(notice))]]
        rows.append((i, r.choice([" ", ", ", "\n"]).join(parts), ""))
    check(spark, rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "mit license", ""), (None, "mit license", ""), (None, None, "")]
    found = licenses.licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.n_base for r in found) == [0, 1, 1]
    assert licenses.licenses(spark.createDataFrame([], DOCS)).count() == 0
