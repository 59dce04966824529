"""Operators on one very long text among short ones."""

import hashlib

import pytest

from sieveline.llm import decontaminate, langid, licenses, mixing, pii, suffix, tokens

DOCS = "doc_id bigint, text string, lang string, source string"
PASSAGE = "this passage of a good many words stands in two documents and is long enough"
LONG = ("a word or two more of text here " * 20_000) + "write to ada@long.example now. released under the mit license. " + PASSAGE


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"first comes {PASSAGE} and then no more of it", "en", "s"), (2, LONG, "en", "s"), (3, "kurz und gut", "de", None), (4, None, None, None), (5, "", "de", "t")]
    return spark.createDataFrame(rows, DOCS).cache()


def one(rows):
    return next(r for r in rows.collect() if r.doc_id == 2)


def test_pii(docs):
    r = one(pii.pii(docs))
    at = LONG.index("ada@")
    assert (r.n_email, r.base_sha256) == (1, hashlib.sha256(f"email:{at}:{at + 16}".encode()).hexdigest())


def test_mixing(docs):
    assert one(mixing.mix(docs)).size == len(LONG.split())


def test_langid(docs):
    assert one(langid.identify(docs)).lang_pred in ("en", "de")


def test_suffix(docs):
    r = one(suffix.digest(docs))
    assert (r.n_bytes, r.n_removed, r.n_spans) == (len(LONG), len(" " + PASSAGE) if LONG[-len(PASSAGE) - 1] == " " else len(PASSAGE), 1)


def test_tokens(docs):
    rows = [r for r in tokens.token_counts(docs.where("doc_id = 2")).collect()]
    encoder = tokens.Encoder(tokens.read_ranks(tokens.VOCABULARY))
    assert sum(r.n_tokens for r in rows) == len(encoder.spans(LONG)[0])


def test_licenses(docs):
    r = one(licenses.licenses(docs))
    assert r.n_base == 1 and r.base_labels == "mit" and r.n_words == len(LONG.replace("@", " ").replace(".", " ").split())


def test_decontaminate(spark, docs):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    found = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert found == {1: (15, True), 2: (15, True), 3: (0, False), 4: (0, False), 5: (0, False)}


def test_unsorted_sections_raise(spark):
    rows = [(1, "alpha beta", [(5, 8), (0, 4)])]
    with pytest.raises(Exception, match="sorted and disjoint"):
        tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, sections array<struct<start:bigint,end:bigint>>")).collect()
