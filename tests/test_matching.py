import math
import random

from pyspark.sql import functions as F

from sieveline.operators import asof, boxes, matching, quantiles


def sequential(truths, findings, fits):
    free, out = list(findings), []
    for t in truths:
        f = next((f for f in free if fits(t, f)), None)
        if f is not None:
            free.remove(f)
            out.append((t, f))
    return out


def test_greedy_is_the_sequential_walk(spark):
    r = random.Random(4)
    truths, findings, edges, want = [], [], [], []
    for group in range(25):
        nodes = {"t": {}, "f": {}}
        for side, most in (("t", 8), ("f", 8)):
            places = list(range(r.randint(0, 14)))
            for p in places:
                nodes[side].setdefault(f"{side}{r.randint(0, most // 2)}", []).append(p)
        fit = {(a, b) for a in nodes["t"] for b in nodes["f"] if r.random() < 0.5}
        truths += [(group, n, p) for n, p in nodes["t"].items()]
        findings += [(group, n, p) for n, p in nodes["f"].items()]
        edges += [(group, a, b) for a, b in fit]
        of = {side: {p: n for n, ps in nodes[side].items() for p in ps} for side in "tf"}
        want += [(group, t, f) for t, f in sequential(sorted(of["t"]), sorted(of["f"]), lambda t, f, of=of, fit=fit: (of["t"][t], of["f"][f]) in fit)]
    t = spark.createDataFrame(truths, "group bigint, t string, t_places array<bigint>")
    f = spark.createDataFrame(findings, "group bigint, f string, f_places array<bigint>")
    found = matching.greedy(t, f, spark.createDataFrame(edges, "group bigint, t string, f string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert matching.greedy(t, f, spark.createDataFrame([], "group bigint, t string, f string")).count() == 0


def test_equal_values_are_matched_in_one_round(spark):
    t = spark.createDataFrame([(1, "a", list(range(500)))], "group bigint, t string, t_places array<bigint>")
    f = spark.createDataFrame([(1, "a", list(range(300)))], "group bigint, f string, f_places array<bigint>")
    found = matching.greedy(t, f, spark.createDataFrame([(1, "a", "a")], "group bigint, t string, f string"))
    assert sorted(map(tuple, found.collect())) == [(1, k, k) for k in range(300)]


def test_containments(spark):
    r = random.Random(2)
    words = ["".join(r.choices("ab1", k=r.randint(1, 7))) for _ in range(60)]
    o = spark.createDataFrame([(i % 2, i, w) for i, w in enumerate(words[:30])], "g int, o int, o_value string")
    i = spark.createDataFrame([(i % 2, i, w) for i, w in enumerate(words[30:])], "g int, i int, i_value string")
    want = sorted((a % 2, a, b) for a, x in enumerate(words[:30]) for b, y in enumerate(words[30:]) if a % 2 == b % 2 and y in x)
    assert sorted(map(tuple, matching.containments(o, i, ["g"]).collect())) == want


def test_last_before(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randint(0, 40) * 7200, k) for k in range(120)]
    make = lambda part: spark.createDataFrame(part, "who string, s bigint, k bigint").select("who", F.timestamp_seconds("s").alias("ts"), "k")
    left, right = rows[::2], rows[1::2]
    found = {x.k: x.found and x.found.k for x in asof.last_before(make(left), make(right), ["who"], "ts", "k", 6 * 3600).collect()}
    for who, s, k in left:
        before = [(s2, k2) for w, s2, k2 in right if w == who and (s2, k2) < (s, k)]
        assert found[k] == (max(before)[1] if before else None)


def test_seeded_groups(spark):
    r = random.Random(5)
    rows = [(s, i, float(r.randint(0, 300)), float(r.randint(0, 120))) for s in range(4) for i in range(60)]
    found = {(x.scene, x.i): x.seed for x in boxes.seeded_groups(spark.createDataFrame(rows, "scene int, i int, x double, y double"), 40, 20).collect()}
    for s in range(4):
        own, seen = [x for x in rows if x[0] == s], {}
        for _, i, x, y in own:
            if i in seen:
                continue
            for _, j, u, v in own:
                if j >= i and j not in seen and abs(u - x) <= 40 and abs(v - y) <= 20:
                    seen[j] = i
        assert {i: seed for (scene, i), seed in found.items() if scene == s} == seen


def test_areas_and_stabbing(spark):
    r = random.Random(6)
    rows = [(s, k, float(r.randint(-30, 280)), float(r.randint(-30, 180)), float(r.randint(1, 90)), float(r.randint(1, 90)), r.randint(0, 3)) for s in range(3) for k in range(25)]
    b = spark.createDataFrame(rows, "scene int, b_id int, b_x double, b_y double, b_w double, b_h double, z int")
    found = {x.scene: (x.summed, x.united) for x in boxes.areas(b.select("scene", *[F.col(f"b_{c}").alias(f"r_{c}") for c in "xywh"]), 300.0, 200.0, 64).collect()}
    for s in range(3):
        own = [[(x, y) for x in range(max(0, int(u)), min(300, int(u + w))) for y in range(max(0, int(v)), min(200, int(v + h)))] for sc, _, u, v, w, h, _ in rows if sc == s]
        assert found[s] == (sum(map(len, own)), len({p for c in own for p in c}))
    points = [(s, float(r.randint(0, 300)), float(r.randint(0, 200))) for s in range(3) for _ in range(60)]
    hits = boxes.stabbed(spark.createDataFrame(points, "scene int, px double, py double"), b, 64).collect()
    assert len(hits) == len(points)
    for h in hits:
        over = [(z, k) for sc, k, u, v, w, hh, z in rows if sc == h.scene and u <= h.px < u + w and v <= h.py < v + hh]
        assert (h.top and h.top.b_id) == (max(over)[1] if over else None)


def test_quantiles(spark):
    r = random.Random(8)
    rows = [(g, float(r.choice([r.randint(0, 5), r.gauss(0, 1), 1e9])) if g < 3 else 7.0) for g in range(4) for _ in range(r.randint(1, 90))] + [(9, None)]
    ranks = {"a": quantiles.nearest(0.5), "b": quantiles.nearest(0.0), "c": quantiles.nearest(1.0), "d": quantiles.at_floor(0.9)}
    for x in quantiles.ranked(spark.createDataFrame(rows, "g int, v double"), "g", "v", ranks).collect():
        own = sorted(v for g, v in rows if g == x.g)
        n = len(own)
        assert (x.a, x.b, x.c, x.d) == (own[math.ceil(n * 0.5) - 1], own[0], own[-1], own[math.floor(n * 0.9)])
