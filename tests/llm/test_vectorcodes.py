import hashlib
import math
import random

import numpy as np
import pytest

from sieveline.llm import vectorcodes as vc

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error string"


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract in plain loops: rows of (vec_id, label, code, error, label_error) and the digest."""
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v: [v[j * len(v) // parts : (j + 1) * len(v) // parts] for j in range(parts)]
    books = [[cut(r[2])[j] for r in kept[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(p, e), i) for i, e in enumerate(books[j])) for j, p in enumerate(cut(r[2]))] for r in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                mine = [cut(r[2])[j] for r, f in zip(kept, found, strict=True) if f[j][1] == e]
                if mine:
                    books[j][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    by_label = {}
    for r, f in zip(kept, found, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[r[1]])) for r, f in zip(kept, found, strict=True)), digest


def check(spark, rows, **how):
    found = vc.encode(spark.createDataFrame(rows, VECTORS).repartition(3), **how).collect()
    want, digest = plain(rows, **how)
    assert sorted(repr((r.vec_id, r.code, r.error, r.label_error)) for r in found) == want
    assert {r.codebooks_sha256 for r in found} <= {digest}


def clustered(seed, n, width, spread=0.05):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(centres)], r.choice([None, 1, 2, 3]), "", "") for i in range(n)]


def test_matches_plain_loops(spark):
    check(spark, clustered(1, 300, 32))


def test_other_shapes_and_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(vc, "CHUNK", 64 * 8)  # many chunks
    check(spark, clustered(2, 400, 8, 0.5), parts=4, entries=7, rounds=5)
    check(spark, clustered(3, 50, 10), parts=4, entries=1, rounds=2)


def test_ties_repeats_nulls_and_odd_components(spark):
    same = [(i % 5, [0.25] * 16, 1, "", "") for i in range(80)]
    check(spark, same)
    ties = [(i, [float((i * 7) % 3)] * 16, None, "", "") for i in range(90)]
    check(spark, ties)
    odd = [(None, [-0.001] * 16, None, "", ""), (None, None, 1, "", ""), (3, [1.0] * 15 + [None], 1, "", ""), (4, [float("nan")] * 16, 1, "", ""), (5, [float("inf")] + [0.0] * 15, 1, "", ""), (6, [-0.0] * 16, 2, "", ""), (7, [1000.5] * 16, 2, "", "")]
    check(spark, odd)


def test_fewer_vectors_than_entries_and_empty(spark):
    check(spark, clustered(4, 9, 16))
    assert vc.encode(spark.createDataFrame([], VECTORS)).count() == 0
    assert vc.encode(spark.createDataFrame([(1, None, 1, "", "")], VECTORS)).count() == 0
    empty = vc.encode(spark.createDataFrame([(1, [], 1, "", ""), (2, [], 1, "", "")], VECTORS)).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 16, 0)] * 2


def test_other_lengths_keep_their_row(spark):
    rows = [*clustered(5, 70, 16), (100, [1.0] * 17, 9, "", ""), (101, [], None, "", "")]
    found = {r.vec_id: r for r in vc.encode(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(found) == 72 and found[100].code is None and found[101].error is None and found[100].label_error is None
    assert found[0].label_error is not None


def test_too_many_entries(spark):
    with pytest.raises(ValueError):
        vc.encode(spark.createDataFrame([], VECTORS), entries=257)


def test_heaps_scan_less_and_lose_nothing():
    """After each round codes are those of a full scan, and few parts were scanned."""
    rows = np.array([[math.floor(256 * x) for x in r[1]] for r in clustered(6, 600, 16, 0.1)], np.int64)
    at = [0, 8, 16]
    book = vc.Codebook(rows[:12].copy(), at, np.zeros((2, 12)))
    chunk = vc.Chunk.first(rows, book)
    total, scanned = np.zeros(12 * 16 + 2 * 12, np.int64) + chunk.sums(book, None), []
    for _ in range(8):
        book = book.replaced(total[: 12 * 16].reshape(12, 16), total[12 * 16 :].reshape(2, 12))
        before = chunk.codes.copy()
        scanned.append(chunk.assign(book))
        total += chunk.sums(book, before)
        assert (chunk.codes == vc.Chunk.first(rows, book).codes).all()
        sizes = np.diff(chunk.at)
        assert sizes.sum() == chunk.codes.size
        for h in range(len(sizes)):  # each is a heap of its own entry's parts
            part, entry = divmod(h, 12)
            keys, mine = chunk.keys[chunk.at[h] : chunk.at[h + 1]], chunk.rows[chunk.at[h] : chunk.at[h + 1]]
            assert all(keys[k] >= keys[(k - 1) // 2] for k in range(1, len(keys)))
            assert (chunk.codes[mine, part] == entry).all()
    assert scanned[-1] < chunk.codes.size / 2
