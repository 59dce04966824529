"""Queries over boxes, tiles and score vectors, with their SQL.

Boxes are made from keys of the part table by the same whole-number rule on
both sides. A scene is a run of so many keys: tables that grow have more scenes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boxes
from ..sources.tables import table
from .registry import Registry

QUERIES = Registry()
#: Parts of a scene.
PARTS = 200


def _made(spark: SparkSession, folder: str, p: str, m: tuple[int, int, int, int]) -> DataFrame:
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("bigint").alias("key"), "p_name")
    box = {"x": (F.col("key") * m[0]) % 1200, "y": (F.col("key") * m[1]) % 800, "w": 20 + (F.col("key") * m[2]) % 180, "h": 10 + (F.col("key") * m[3]) % 90}
    return parts.select(F.floor(F.col("key") / PARTS).alias("scene"), F.col("key").alias(f"{p}_id"), *[v.cast("double").alias(f"{p}_{k}") for k, v in box.items()], (((F.col("key") * 97) % 1000) / 1000.0).alias("score"), "p_name")


def _made_sql(p: str, m: tuple[int, int, int, int]) -> str:
    return (
        f"SELECT CAST(p_partkey AS BIGINT) // {PARTS} AS scene, CAST(p_partkey AS BIGINT) AS {p}_id, CAST((p_partkey * {m[0]}) % 1200 AS DOUBLE) AS {p}_x, CAST((p_partkey * {m[1]}) % 800 AS DOUBLE) AS {p}_y,"
        f" CAST(20 + (p_partkey * {m[2]}) % 180 AS DOUBLE) AS {p}_w, CAST(10 + (p_partkey * {m[3]}) % 90 AS DOUBLE) AS {p}_h, ((p_partkey * 97) % 1000) / 1000.0 AS score, p_name FROM part"
    )


REGION, NODE = (37, 53, 7, 11), (41, 59, 13, 17)
_IOU = """CASE WHEN least({a}_x + {a}_w, {b}_x + {b}_w) > greatest({a}_x, {b}_x) AND least({a}_y + {a}_h, {b}_y + {b}_h) > greatest({a}_y, {b}_y) THEN
 (least({a}_x + {a}_w, {b}_x + {b}_w) - greatest({a}_x, {b}_x)) * (least({a}_y + {a}_h, {b}_y + {b}_h) - greatest({a}_y, {b}_y)) /
 ({a}_w * {a}_h + {b}_w * {b}_h - (least({a}_x + {a}_w, {b}_x + {b}_w) - greatest({a}_x, {b}_x)) * (least({a}_y + {a}_h, {b}_y + {b}_h) - greatest({a}_y, {b}_y))) ELSE 0 END"""
_PAIRS = f"""WITH r AS ({_made_sql('r', REGION)}), n AS ({_made_sql('n', NODE)}),
pairs AS (SELECT r.scene, r_id, n_id, {_IOU.format(a='r', b='n')} AS iou FROM r JOIN n ON r.scene = n.scene),
near AS (SELECT * FROM pairs WHERE iou > 0.1),
top AS (SELECT *, row_number() OVER (PARTITION BY scene, r_id ORDER BY iou DESC, n_id) AS rank FROM near)"""


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    return _made(spark, folder, "r", REGION).drop("score", "p_name")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _made(spark, folder, "n", NODE).drop("score", "p_name")


@QUERIES.add(f"{_PAIRS} SELECT scene, r_id, n_id, round(iou, 6) AS iou, rank FROM top WHERE rank <= 5")
def iou_top5(spark: SparkSession, folder: str) -> DataFrame:
    pairs = boxes.overlapping(_regions(spark, folder), _nodes(spark, folder), 0.1)
    return boxes.best_overlaps(pairs, 5).select("scene", "r_id", "n_id", F.round("iou", 6).alias("iou"), F.col("rank").cast("long"))


_RELATION = "CASE WHEN iou IS NULL THEN 'visual-only' WHEN iou > 0.8 THEN 'exact' WHEN iou > 0.5 THEN 'contains' ELSE 'nearby' END"


@QUERIES.add(f"{_PAIRS} SELECT r.scene, r.r_id, n_id, {_RELATION} AS relation FROM r LEFT JOIN (SELECT * FROM top WHERE rank = 1) t ON r.r_id = t.r_id")
def reconcile_best_match(spark: SparkSession, folder: str) -> DataFrame:
    regions = _regions(spark, folder)
    best = boxes.best_overlaps(boxes.overlapping(regions, _nodes(spark, folder), 0.1), 1).select("r_id", "n_id", "iou")
    relation = F.when(F.col("iou").isNull(), "visual-only").when(F.col("iou") > 0.8, "exact").when(F.col("iou") > 0.5, "contains").otherwise("nearby")
    return regions.join(best, "r_id", "left").select("scene", "r_id", "n_id", relation.alias("relation"))


@QUERIES.add(f"{_PAIRS} SELECT scene, r_id FROM r WHERE r_id NOT IN (SELECT r_id FROM near)")
def visual_only_anti(spark: SparkSession, folder: str) -> DataFrame:
    regions = _regions(spark, folder)
    return regions.join(boxes.overlapping(regions, _nodes(spark, folder), 0.1), "r_id", "left_anti").select("scene", "r_id")


@QUERIES.add(f"{_PAIRS} SELECT r.r_id, r.scene FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.scene = r.scene AND abs(n_x - r_x) <= 5 AND abs(n_y - r_y) <= 5)")
def proximity_anti(spark: SparkSession, folder: str) -> DataFrame:
    # A band of five in both directions: neighbours share a cell of six once one side is in three by three.
    # Both sides grow with the table, so neither is broadcast, however small its columns look.
    at = lambda i, j: F.struct((F.floor(F.col("n_x") / 6) + i).alias("x"), (F.floor(F.col("n_y") / 6) + j).alias("y"))
    n = _nodes(spark, folder).select(F.col("scene").alias("s"), "n_x", "n_y", F.explode(F.array(*[at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c"))
    r = _regions(spark, folder).withColumn("at", F.struct(F.floor(F.col("r_x") / 6).alias("x"), F.floor(F.col("r_y") / 6).alias("y")))
    close = (r["scene"] == n["s"]) & (r["at"] == n["c"]) & (F.abs(F.col("n_x") - F.col("r_x")) <= 5) & (F.abs(F.col("n_y") - F.col("r_y")) <= 5)
    return r.join(n.hint("merge"), close, "left_anti").select("r_id", "scene")


_NMS = f"""WITH b AS ({_made_sql('b', REGION)}),
l AS (SELECT scene, list({{'id': b_id, 'b_x': b_x, 'b_y': b_y, 'b_w': b_w, 'b_h': b_h}} ORDER BY score DESC, b_id) AS l FROM b GROUP BY scene),
k AS (SELECT scene, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda p:
  greatest(0, least(p.b_x + p.b_w, x[1].b_x + x[1].b_w) - greatest(p.b_x, x[1].b_x)) * greatest(0, least(p.b_y + p.b_h, x[1].b_y + x[1].b_h) - greatest(p.b_y, x[1].b_y)) /
  (p.b_w * p.b_h + x[1].b_w * x[1].b_h - greatest(0, least(p.b_x + p.b_w, x[1].b_x + x[1].b_w) - greatest(p.b_x, x[1].b_x)) * greatest(0, least(p.b_y + p.b_h, x[1].b_y + x[1].b_h) - greatest(p.b_y, x[1].b_y))) > 0.3)) > 0
  THEN acc ELSE list_concat(acc, x) END) AS kept FROM l)
SELECT scene, kept[i].id AS b_id, i - 1 AS rank FROM (SELECT scene, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)"""


@QUERIES.add(_NMS)
def nms_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return boxes.suppress(_made(spark, folder, "b", REGION), 0.3).select("scene", "b_id", F.col("rank").cast("long"))


@QUERIES.add(f"{_PAIRS} SELECT count(*) AS n, sum(r_w * r_h) AS area, least(sum(r_w * r_h) / (count(DISTINCT scene) * 1200.0 * 800.0), 1.0) AS coverage FROM r")
def roi_metrics(spark: SparkSession, folder: str) -> DataFrame:
    area = F.sum(F.col("r_w") * F.col("r_h"))
    return _regions(spark, folder).agg(F.count(F.lit(1)).alias("n"), area.alias("area"), F.least(area / (F.count_distinct("scene") * 1200.0 * 800.0), F.lit(1.0)).alias("coverage"))


_MASK = f"""{_PAIRS}, rc AS (SELECT DISTINCT scene, cx, cy FROM (SELECT scene, unnest(range(CAST(floor(r_x / 20) AS BIGINT), CAST(floor((r_x + r_w) / 20) AS BIGINT) + 1)) AS cx, r_y, r_h FROM r), LATERAL (SELECT unnest(range(CAST(floor(r_y / 20) AS BIGINT), CAST(floor((r_y + r_h) / 20) AS BIGINT) + 1)) AS cy)),
nc AS (SELECT DISTINCT scene, cx, cy FROM (SELECT scene, unnest(range(CAST(floor(n_x / 20) AS BIGINT), CAST(floor((n_x + n_w) / 20) AS BIGINT) + 1)) AS cx, n_y, n_h FROM n), LATERAL (SELECT unnest(range(CAST(floor(n_y / 20) AS BIGINT), CAST(floor((n_y + n_h) / 20) AS BIGINT) + 1)) AS cy))
SELECT coalesce(rc.scene, nc.scene) AS scene, count(rc.scene) AS n_planned, count(nc.scene) AS n_truth, sum(CASE WHEN rc.scene IS NOT NULL AND nc.scene IS NOT NULL THEN 1 ELSE 0 END) AS n_both,
  round(sum(CASE WHEN rc.scene IS NOT NULL AND nc.scene IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS mask_iou
FROM rc FULL JOIN nc ON rc.scene = nc.scene AND rc.cx = nc.cx AND rc.cy = nc.cy GROUP BY 1"""


@QUERIES.add(_MASK)
def mask_iou(spark: SparkSession, folder: str) -> DataFrame:
    cells = lambda df, p: df.select("scene", boxes.cells(p, 20).alias("c")).distinct()
    a, b = cells(_regions(spark, folder), "r").withColumn("a", F.lit(1)), cells(_nodes(spark, folder), "n").withColumn("b", F.lit(1))
    both = a.join(b, ["scene", "c"], "full").groupBy("scene").agg(F.count("a").alias("n_planned"), F.count("b").alias("n_truth"), F.count(F.expr("a + b")).alias("n_both"), F.count(F.lit(1)).alias("n"))
    return both.select("scene", "n_planned", "n_truth", "n_both", F.round(F.col("n_both") / F.col("n"), 6).alias("mask_iou"))


@QUERIES.add("""WITH a AS (SELECT 8 AS stride, slot, (gx + 0.5) / 16 AS cx, (gy + 0.5) / 16 AS cy, (gy * 16 + gx) * 2 + slot AS k FROM (SELECT unnest(range(0, 16)) AS gx), (SELECT unnest(range(0, 16)) AS gy), (SELECT unnest(range(0, 2)) AS slot)
UNION ALL SELECT 16, slot, (gx + 0.5) / 8, (gy + 0.5) / 8, 512 + (gy * 8 + gx) * 6 + slot FROM (SELECT unnest(range(0, 8)) AS gx), (SELECT unnest(range(0, 8)) AS gy), (SELECT unnest(range(0, 6)) AS slot))
SELECT CAST(p_partkey AS BIGINT) AS key, stride, CAST(slot AS BIGINT) AS slot, cx, cy FROM part JOIN a ON p_partkey % 896 = k""")
def anchor_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The anchor that a part stands for: its number among 16 by 16 cells of two
    anchors, then 8 by 8 cells of six."""
    key = F.col("p_partkey").cast("bigint")
    k = key % 896
    small = k < 512
    cell = F.when(small, F.floor(k / 2)).otherwise(F.floor((k - 512) / 6))
    n = F.when(small, 16).otherwise(8)
    slot = F.when(small, k % 2).otherwise((k - 512) % 6)
    return table(spark, folder, "part").select(key.alias("key"), F.when(small, 8).otherwise(16).alias("stride"), slot.alias("slot"), ((cell % n + 0.5) / n).alias("cx"), ((F.floor(cell / n) + 0.5) / n).alias("cy"))


_TILES = """WITH s AS (SELECT p_partkey AS key, 600 + (p_partkey * 31) % 900 AS w, 400 + (p_partkey * 17) % 700 AS h FROM part)
SELECT key, 'tile-' || r || '-' || c AS tile_id, c * 256 AS x, r * 256 AS y, least(256, w - c * 256) AS tw, least(256, h - r * 256) AS th
FROM (SELECT key, w, h, unnest(range(0, CAST(ceil(h / 256.0) AS BIGINT))) AS r FROM s), LATERAL (SELECT unnest(range(0, CAST(ceil(w / 256.0) AS BIGINT))) AS c)"""


def _tiles(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    s = table(spark, folder, "part").select(k.alias("key"), (600 + (k * 31) % 900).alias("w"), (400 + (k * 17) % 700).alias("h"))
    axis = lambda c: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(c) / 256) - 1).cast("int")))
    t = s.withColumn("r", axis("h")).withColumn("c", axis("w"))
    at = lambda name: (F.col(name) * 256).cast("bigint")
    return t.select("key", F.concat_ws("-", F.lit("tile"), "r", "c").alias("tile_id"), at("c").alias("x"), at("r").alias("y"), F.least(F.lit(256), F.col("w") - at("c")).alias("tw"), F.least(F.lit(256), F.col("h") - at("r")).alias("th"))


@QUERIES.add(_TILES)
def tile_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _tiles(spark, folder)


_HASHES = """h AS (SELECT user_id AS tab, CAST(event_id % 4 AS BIGINT) AS tile, ts, event_id, substr(sha256(coalesce(props, '')), 1, 16) AS hash FROM events)"""


@QUERIES.add(f"WITH {_HASHES} SELECT event_id, tab, tile, hash FROM (SELECT *, lag(hash) OVER (PARTITION BY tab, tile ORDER BY ts, event_id) AS was FROM h) WHERE hash IS DISTINCT FROM was")
def changed_tiles(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "events").select("event_id", F.col("user_id").alias("tab"), (F.col("event_id") % 4).alias("tile"), "ts", F.substring(F.sha2(F.coalesce("props", F.lit("")), 256), 1, 16).alias("hash"))
    was = F.lag("hash").over(Window.partitionBy("tab", "tile").orderBy("ts", "event_id"))
    return h.withColumn("was", was).where(~F.col("hash").eqNullSafe(F.col("was"))).select("event_id", "tab", "tile", "hash")


@QUERIES.add("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best, CAST(greatest(list_max(embedding), 0) AS DOUBLE) AS score FROM embeddings")
def argmax_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    most = F.array_max("embedding")
    return table(spark, folder, "embeddings").select("vec_id", (F.array_position("embedding", most) - 1).cast("int").alias("best"), F.greatest(most, F.lit(0.0)).cast("double").alias("score"))


@QUERIES.add("""WITH t AS (SELECT vec_id, i, list_position(embedding[i * 8 + 1 : i * 8 + 8], list_max(embedding[i * 8 + 1 : i * 8 + 8])) - 1 AS s, list_max(embedding[i * 8 + 1 : i * 8 + 8]) AS p
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 8)) AS i FROM embeddings)),
 c AS (SELECT *, lag(s) OVER (PARTITION BY vec_id ORDER BY i) AS was FROM t)
 SELECT vec_id, coalesce(string_agg(CAST(s AS VARCHAR), '-' ORDER BY i), '') AS symbols, round(CAST(avg(CAST(p AS DOUBLE)) AS DOUBLE), 6) AS mean FROM c WHERE s <> 0 AND s IS DISTINCT FROM was GROUP BY vec_id""")
def ctc_decode(spark: SparkSession, folder: str) -> DataFrame:
    def step(i: Column) -> Column:
        part = F.slice("embedding", i * 8 + 1, 8)
        return F.struct((F.array_position(part, F.array_max(part)) - 1).cast("int").alias("s"), F.array_max(part).cast("double").alias("p"))

    t = table(spark, folder, "embeddings").where(F.size("embedding") >= 8).select("vec_id", F.transform(F.sequence(F.lit(0), (F.floor(F.size("embedding") / 8) - 1).cast("int")), step).alias("t"))
    before = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("double").alias("p"))), F.slice("t", 1, F.size("t") - 1))
    kept = F.filter(F.zip_with("t", before, lambda a, b: F.struct(a["s"].alias("s"), a["p"].alias("p"), b["s"].alias("was"))), lambda x: (x["s"] != 0) & ~x["s"].eqNullSafe(x["was"]))
    out = t.select("vec_id", kept.alias("k")).where(F.size("k") > 0)
    total = F.aggregate("k", F.lit(0.0), lambda acc, x: acc + x["p"])
    return out.select("vec_id", F.array_join(F.transform("k", lambda x: x["s"].cast("string")), "-").alias("symbols"), F.round(total / F.size("k"), 6).alias("mean"))
