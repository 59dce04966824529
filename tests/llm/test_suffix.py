import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import suffix

DOCS = "doc_id bigint, text string, kept string"


def plain(rows, length=50):
    """Brute force: {(doc_id, bytes, removed, spans, sha)} as a sorted list."""
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            key = float("inf") if i is None else i
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((str(i), len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digest(spark.createDataFrame(rows, DOCS)).collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts += [text(r.randint(0, 12)), r.choice([p, p[a:], p[:a]])]
        rows.append((i * 3, "".join(parts), "x"))
    rows += [(1000 + i, rows[i * 5][1], "copy") for i in range(8)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == plain(rows)


def test_split_groups_match_brute_force(spark, monkeypatch):
    """With blocks of few bytes every group is split and compared by an aggregate."""
    monkeypatch.setattr(suffix, "BLOCK", 400)
    monkeypatch.setattr(suffix, "PIECE", 64)
    rows = corpus(3)
    assert got(spark, rows) == plain(rows)


def test_nulls_repeats_runs_and_empty(spark):
    long = "a" * 400
    rows = [(None, long, ""), (None, long + "b", ""), (1, None, None), (2, "", ""), (3, "x" * 49, ""), (4, "x" * 49, ""), (5, "y" * 50, ""), (6, "y" * 50, ""), (6, "y" * 50, ""), (7, "b" + "a" * 60, ""), (9, "ab" * 90, ""), (8, "ba" * 70, "")]
    assert got(spark, rows) == plain(rows)
    assert suffix.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_array_order():
    r = np.random.default_rng(1)
    for size, letters in ((1, 2), (2, 1), (50, 1), (300, 2), (500, 3), (400, 200)):
        t = r.integers(0, letters, size).astype(np.uint8)
        b = t.tobytes()
        sa = suffix.suffix_array(t)
        assert sorted(sa) == list(range(size))
        cut = [b[i : i + 50] for i in sa]
        assert cut == sorted(cut)


def test_anchors_in_chunks(monkeypatch):
    text = "".join(random.Random(2).choices("abc", k=3000)).encode()
    whole = suffix.anchors(text)
    monkeypatch.setattr(suffix, "CHUNK", 100)
    assert (whole == suffix.anchors(text)).all()
    per_string = np.concatenate([x for _, x in suffix.least_hashes(text)])
    assert len(per_string) == len(text) - 49
    assert all(suffix.anchors(text[p : p + 50])[0] == per_string[p] for p in range(0, len(per_string), 37))


def test_ids_of_other_types(spark):
    rows = corpus(7)
    number = {r[0]: f"id-{r[0]:06d}" for r in rows if r[0] is not None}
    named = [(number.get(r[0]), *r[1:]) for r in rows]
    found = suffix.digest(spark.createDataFrame(named, DOCS.replace("doc_id bigint", "doc_id string"))).collect()
    want = suffix.digest(spark.createDataFrame(rows, DOCS)).collect()
    show = lambda rows, name: sorted(repr((name(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)
    assert show(found, lambda x: x) == show(want, lambda x: number.get(x))


def test_only_ties_are_sorted_again(monkeypatch):
    r = random.Random(5)
    ranked, ranks = [], suffix._ranks
    monkeypatch.setattr(suffix, "_ranks", lambda x: ranked.append(len(x)) or ranks(x))
    for alphabet in (b"a", b"ab", b"\x00\xff", bytes(range(256))):
        text = bytes(r.choices(alphabet, k=400))
        padded = np.frombuffer(text + bytes(80), np.uint8)
        for places in (np.arange(400), np.array([7]), np.arange(0)):
            ranked.clear()
            found = suffix._sorted(suffix._words(padded, big=True), places.copy(), 50)
            keys = [padded[i : i + 56].tobytes() for i in found]
            assert keys == sorted(keys) and sorted(found) == places.tolist()
        ranked.clear()
        suffix._sorted(suffix._words(padded, big=True), np.arange(300), 50)
        assert (sum(ranked) == 0) == (len(alphabet) == 256)


def test_anchors_travel_as_arrays(spark):
    """One row a bucket and some anchors, whatever the texts: rows of single anchors took most of the time."""
    rows = corpus(11)
    docs = suffix._ordered(spark.createDataFrame(rows, DOCS))
    dealt = suffix._anchor_rows(docs.coalesce(1), 3, 5, 50).collect()
    assert sorted(r.bucket for r in dealt) == [0, 1, 2]
    found = {(h, d) for r in dealt for h, d in zip(np.frombuffer(r.h, np.uint64).tolist(), np.frombuffer(r.d, np.int64).tolist(), strict=True)}
    assert found == {(h, i) for i, t, _ in rows for h in suffix._scattered(suffix.anchors(t.encode())).tolist()}


@pytest.mark.parametrize("seed", [12, 13])
def test_many_buckets_groups_and_common_anchors(spark, monkeypatch, seed):
    """Anchors that more than a few rows have are for every group of texts."""
    for name, value in (("BUCKET", 900), ("GROUP", 700), ("FLUSH", 300), ("FEW", 1), ("CHUNK", 256), ("PIECE", 64)):
        monkeypatch.setattr(suffix, name, value)
    rows = corpus(seed)
    assert got(spark, rows) == plain(rows)


def test_joined_texts():
    """Runs of joined texts are those of each text alone, and long texts come alone."""
    r = random.Random(4)
    texts = ["".join(r.choices("ab", k=n)).encode() for n in (0, 49, 50, 51, 300, 70, 0, 60, 200_000, 64, 140_000, 150_000, 50)]
    seen = []
    for rows, joined, offsets in suffix._joined(pa.array([b"skipped", *texts], pa.binary()).slice(1)):
        mine = texts[rows]
        assert joined == b"".join(mine) and (np.diff(offsets) == [len(t) for t in mine]).all()
        seen += mine
        alone = [(k, lo + offsets[k], hi + offsets[k], h) for k, t in enumerate(mine) for part in suffix.runs(t, np.array([0, len(t)])) for _, lo, hi, h in zip(*part, strict=True)]
        assert alone == [x for part in suffix.runs(joined, offsets) for x in zip(*part, strict=True)]
        assert len(mine) == 1 or max(map(len, mine)) <= suffix.CHUNK // 2
    assert seen == texts


def test_copies_without_id_are_cut_once(spark, monkeypatch):
    """Rows without id that are alike share a group of texts, so only one of them goes there."""
    sizes = spark.sparkContext.accumulator(0)
    cut = suffix._pieces

    def counted(length):
        run = cut(length)

        def wrapped(texts, found):
            sizes.add(texts.num_rows)
            return run(texts, found)

        return wrapped

    monkeypatch.setattr(suffix, "_pieces", counted)
    text = "".join(random.Random(8).choices("abcdef ", k=200))
    rows = [(None, text, "")] * 40 + [(None, text + "!", "")] + [(3, "x" + text[20:], ""), (3, "x" + text[20:], ""), (5, text[:90], "")]
    assert got(spark, rows) == plain(rows)
    assert sizes.value == 5
