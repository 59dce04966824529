import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import simhash

DOCS = "doc_id bigint, text string, extra string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Brute force over all pairs: {row number: smallest id}."""
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                label[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((str(r[0]), f"{fps[i]:016x}", str(least[find(i)])) for i, r in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = r.choices(words, k=r.randint(1, 200))
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            if r.random() < 0.7:
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy), "x"))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, DOCS))) == plain_components(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(3, None, "a"), (1, "", "b"), (2, " \t\n", "c"), (None, "one two three four", "d"), (None, "one two three four", "d"), (7, "ONE two THREE four", None), (7, "ONE two THREE four", None), (9, "Été é", "e")]
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, DOCS))) == plain_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_hash_is_sparks_own(spark):
    words = "a bb ccc"
    assert spark.range(1).select(F.xxhash64(F.lit(words))).first()[0] % 2**64 == xxhash.xxh64_intdigest(words, 42)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.simhash(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = [m % 2**64 for m in simhash.covering_masks(radius)]
    r = random.Random(radius)
    for _ in range(500):
        differing = sum(1 << i for i in r.sample(range(64), radius))
        assert any(m & differing == 0 for m in masks)
    assert all(bin(m).count("1") >= 32 for m in masks)


def test_links_keep_dense_groups_connected(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"))
    roots = simhash.components(edges).select("root").distinct().collect()
    assert len(roots) == 1


def test_links_of_tables(spark):
    """Groups of the tables, small and large: the same components as all pairs."""
    r = random.Random(9)
    fps = set()
    for size in (2, 5, 30, 90):
        base = r.getrandbits(64)
        fps |= {base} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(size)}
    fps |= {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    want = {}
    for i, x in enumerate(fps):
        want.setdefault(find(i), set()).add(x)
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    have = {}
    for node, top in simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect():
        have.setdefault(top, set()).add(node % 2**64)
    assert sorted(map(sorted, have.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_keep_one_of_near_copies(spark):
    """Every near copy goes, and no text without one does."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        base = r.choices(words, k=r.randint(120, 260))
        for c in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            if c % 2:
                copy[r.randrange(len(copy))] = r.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy), "x"))
        half = base[: len(base) // 2] + r.choices(words, k=len(base) // 2)
        group[len(rows)] = ("half", g)
        rows.append((len(rows), " ".join(half), "x"))
    alike = lambda s, t: len(s & t) >= 0.8 * len(s | t)
    sets = [shingles(t) for _, t, _ in rows]
    assert all(alike(sets[i], sets[j]) == (group[i] == group[j]) for i in range(len(rows)) for j in range(i))
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert kept == sorted(first.values())


def test_keep_one_edges(spark):
    rows = [(5, "a b c d e f", "x"), (4, "A b c d e f", "y"), (4, "A b c d e f", "y"), (8, "something else entirely here", "z"), (5, "third text of its own kind", "w"), (None, None, "n"), (9, " ", "n"), (None, "lone words", "n")]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.extra) for r in kept) == [("4", "y"), ("5", "w"), ("8", "z"), ("9", "n"), ("None", "n")]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def grouped(rows):
    """Brute force over all pairs: the smallest id of each group."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in range(len(rows))})


def test_keep_one_of_longer_and_shorter_copies(spark):
    """Passages put before, behind or taken away, at a Jaccard of 0.80 to 0.95."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(60):
        base = r.choices(words, k=r.randint(80, 400))
        k = int(len(base) * r.uniform(0.05, 0.19))
        copy = [base + r.choices(words, k=k), r.choices(words, k=k) + base, base[k:], base[: len(base) // 2] + base[len(base) // 2 + k :]][g % 4]
        rows += [(len(rows), " ".join(base), "x"), (len(rows) + 1, " ".join(copy), "x")]
    want = grouped(rows)
    assert len(want) < 70
    assert sorted(x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == want


def test_keep_one_of_stars_and_permuted_texts(spark):
    """Copies edited apart are alike only through their original, and texts of
    the same words in other order are not alike at all."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for size in (3, 40, 150):
        base = r.sample(words, k=200)
        copies = []
        for _ in range(size):
            at = r.randint(0, 180)
            copies.append(base[:at] + r.choices(words, k=16) + base[at + 16 :])
        copies.insert(r.randint(0, size), base)
        blocks = [base[i : i + 25] for i in range(0, 200, 25)]
        copies += [sum(r.sample(blocks, k=8), []) for _ in range(20)]
        rows += [(len(rows) + n, " ".join(c), "x") for n, c in enumerate(copies)]
    same = r.sample(words, k=150)
    mixed = [r.sample(same, k=150) for _ in range(30)]
    near = [m[:-5] + m[-6:-1] for m in mixed]
    rows += [(len(rows) + n, " ".join(c), "x") for n, c in enumerate(mixed + near)]
    want = grouped(rows)
    assert len(want) < len(rows) - 200
    assert sorted(x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == want
