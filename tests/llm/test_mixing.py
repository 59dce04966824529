import random

import pytest

from sieveline.llm import mixing

DOCS = "doc_id bigint, text string, source string, size string"


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """{source: target} by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        goal = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return capped | goal
        capped |= {s: most * sizes[s] for s in over}


def corpus(seed, n=400, sources=("a", "b", "Z", "ä", None)):
    r = random.Random(seed)
    pick = lambda: sources[0] if r.random() < 0.4 else r.choice(sources)
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 20, 20, 90])), pick(), "clash") for i in range(n)]


def sizes_of(rows):
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    return sizes


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_masses(spark, seed):
    rows = corpus(seed)
    found = mixing.mix(spark.createDataFrame(rows, DOCS), bucket=16).collect()
    sizes, goal = sizes_of(rows), plain_targets(sizes_of(rows))
    assert sorted(r.doc_id for r in found) == [r[0] for r in rows]
    for r in found:
        assert r.size == len((rows[r.doc_id][1] or "").split())
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        assert r.size == 0 or r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    for s in sizes:
        taken = sum(r.taken for r in found if r.source == s)
        assert abs(taken - goal[s]) <= max(r.size for r in found if r.source == s)


def test_reruns_agree_for_any_partitions(spark):
    df = spark.createDataFrame(corpus(3), DOCS)
    one = sorted(mixing.mix(df.repartition(7), bucket=16).select("doc_id", "taken").collect())
    two = sorted(mixing.mix(df.coalesce(1), bucket=16).select("doc_id", "taken").collect())
    assert one == two


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c", None, "x"), (None, "a b c", None, "x"), (1, None, "s", "x"), (2, "", "t", "x"), (3, "a " * 2000, "s", None)]
    found = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 5 and all(r.taken <= 2 * r.size for r in found)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.apply_mix(spark.createDataFrame(rows, DOCS)).where("copies < 1").count() == 0


def test_copies_are_unbiased(spark):
    """Each of many equal documents is taken about as often as its share says."""
    rows = [(i, "w " * (1 + i % 7), "s" if i % 2 else "t", "") for i in range(4000)]
    found = mixing.mix(spark.createDataFrame(rows, DOCS), bucket=64).collect()
    for source in "st":
        own = [r for r in found if r.source == source]
        for size in range(1, 8):
            same = [r for r in own if r.size == size]
            if same:
                assert sum(r.copies for r in same) / len(same) == pytest.approx(same[0].target / same[0].source_size, abs=0.09)
