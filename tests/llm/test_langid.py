import math
import random
import zlib

import numpy as np
import pytest

from sieveline.llm import langid

DOCS = "doc_id bigint, text string, lang string, score string"
SYLLABLES = {"aa": ["ka", "to", "ri", "no"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["tion", "eau", "que", "les"], None: ["ka", "sch", "que", "zz"]}


def corpus(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["aa", "bb", "cc", None]) if i % 10 == 0 else r.choice(["aa", "bb", "cc"])
        rows.append((i, " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(r.randint(3, 40))), lang, "clash"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1)
    found = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in {"aa", "bb", "cc"}
    held = [r for r in found if r.held_out and rows[r.doc_id][2]]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.98


def test_real_tables_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = corpus(2)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, e) for i, t, lang, e in rows]
    one = sorted(langid.identify(spark.createDataFrame(rows, DOCS)).collect())
    two = sorted(langid.identify(spark.createDataFrame(changed, DOCS)).collect())
    assert one == two


def test_nulls_and_empty(spark):
    rows = [*corpus(3), (None, "ka to", "aa", ""), (1001, None, "aa", ""), (1002, "", None, ""), (1003, "123 !?", "bb", ""), (1004, "é", "cc", ""), (1004, "é", "cc", "")]
    found = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and not by_id[None].held_out
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1001, 1002, 1003))
    assert by_id[1004].lang_pred != "und"
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    unlabelled = [(1, "some text", None, "")]
    assert langid.identify(spark.createDataFrame(unlabelled, DOCS)).first().lang_pred == "und"


@pytest.mark.parametrize("n", [1, 2, 4, 6, 20])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n).astype(int)
    assert code.shape[0] == n
    apart = (code.shape[1] - code @ code.T) // 2
    if n > 1:
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else code.shape[1] / 4)


def test_counts_in_chunks(monkeypatch):
    text = "äß" + "".join(random.Random(1).choices("abc d", k=500))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert (langid.counts(text) == whole).all()


def plain_model(rows):
    """Counts, classifiers and decoding in plain Python, from the definition."""

    def buckets(text):
        out, text = {}, f" {text.lower()} "
        for n in langid.GRAMS:
            for i in range(len(text) - n + 1):
                h = n
                for c in text[i : i + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                b = h >> (32 - (langid.BUCKETS.bit_length() - 1))
                out[b] = out.get(b, 0) + 1
        return out

    langs = sorted({r[2] for r in rows})
    by_lang = {x: {} for x in langs}
    for _, text, lang, *_ in rows:
        for b, n in buckets(text).items():
            by_lang[lang][b] = by_lang[lang].get(b, 0) + n
    total = {x: sum(by_lang[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    share = {x: [(by_lang[x].get(b, 0) + 0.5) / total[x] for b in range(langid.BUCKETS)] for x in langs}
    bits = [[1 if split >> i & 1 else -1 for i in range(len(langs))] for split in range(1, 2 ** (len(langs) - 1))]
    weights, reliable = [], []
    for bit in bits:
        one, zero = ([x for x, v in zip(langs, bit, strict=True) if v == sign] for sign in (1, -1))
        weights.append([math.log((sum(share[x][b] for x in one) / len(one)) / (sum(share[x][b] for x in zero) / len(zero))) for b in range(langid.BUCKETS)])
        reliable.append(max(0.01, min(v * sum(s * w for s, w in zip(share[x], weights[-1], strict=True)) for x, v in zip(langs, bit, strict=True))))

    def predict(text):
        found = buckets(text)
        margins = [min(4, max(-4, 4 * sum(n * w[b] for b, n in found.items()) / (sum(found.values()) + 8))) for w in weights]
        loss = [sum(math.exp(-m * bit[i]) * r for m, bit, r in zip(margins, bits, reliable, strict=True)) / sum(reliable) for i in range(len(langs))]
        all_ = sum(math.exp(-x) for x in loss)
        best = min(range(len(langs)), key=lambda i: (loss[i], i))
        return langs[best], math.exp(-loss[best]) / all_

    return predict


def test_every_row_against_plain_python(spark):
    rows = [*corpus(5, 60), (100, "ka schung tion 123 éà 😀", None, ""), (101, "x", None, ""), (102, "12 34", "aa", ""), (103, None, "bb", "")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    predict = plain_model([r for r in rows if r[0] not in held and r[1] is not None and r[2] is not None])
    for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        want = predict(text) if text and any(map(str.isalpha, text)) else ("und", 0.0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9


def test_more_languages_than_can_be_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, t * (3 if lang == "cc" else 1), lang, s) for i, t, lang, s in corpus(6, 120)]
    found = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r.lang_pred for r in found}) == 2 and "cc" in {r.lang_pred for r in found}
