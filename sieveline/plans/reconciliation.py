"""Queries that reconcile visual regions with nodes by place and text, with their SQL.

Regions and nodes are the boxes of the layout queries; their texts are words of the
part of their key, and every eleventh node is a canvas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boxes
from ..sources.tables import written
from .layout import _PAIRS, NODE, REGION, _made
from .registry import Registry
from .scenes import common_subsequence, similarity_sql

QUERIES = Registry()
#: Shares of place and text in a score, and bounds of agreement.
PLACE, TEXT, SAME, ALIKE = 0.6, 0.4, 0.8, 0.3


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    words = F.split("p_name", " ")
    label = F.when(F.col("r_id") % 7 != 0, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))
    regions = _made(spark, folder, "r", REGION).withColumn("label", label).drop("score", "p_name")
    name = F.when(F.col("n_id") % 5 == 0, "").otherwise(F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))))
    nodes = _made(spark, folder, "n", NODE).withColumn("name", name).withColumn("canvas", F.col("n_id") % 11 == 0).drop("score", "p_name")
    return regions, nodes


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    """scene, r_id, n_id, relation, confidence, agreement, conflicts (in order)."""
    regions, nodes = _sides(spark, folder)
    near = boxes.best_overlaps(boxes.overlapping(regions, nodes, 0.1), 5)
    alike = common_subsequence(F.lower("label"), F.lower("name"))
    scored = near.withColumn("alike", alike).withColumn("score", F.col("iou") * PLACE + F.col("alike") * TEXT)
    first = F.row_number().over(Window.partitionBy("scene", "r_id").orderBy(F.col("score").desc(), "rank"))
    best = scored.withColumn("k", first).where("k = 1").select("r_id", "n_id", "iou", "alike", "score", "name", "canvas")
    joined = regions.join(best, "r_id", "left")
    lone, both = F.col("n_id").isNull(), (F.coalesce("label", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    relation = F.when(lone, "visual-only").when(F.col("iou") > 0.8, "exact").when(F.col("iou") > 0.5, "contains").otherwise("nearby")
    agreement = F.when(lone, "not-applicable").when(F.col("alike") > SAME, "match").when(F.col("alike") > ALIKE, "partial").when(both, "contradiction").otherwise("not-applicable")
    flags = F.array_compact(F.array(F.when(lone, "dom-absent-visual-content"), F.when(F.col("agreement") == "contradiction", "aria-painted-disagreement"), F.when(F.col("canvas"), "canvas-content")))
    out = joined.withColumn("agreement", agreement)
    return out.select("scene", "r_id", "n_id", relation.alias("relation"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("confidence"), "agreement", flags.alias("conflicts"))


_MATCHED = f"""{_PAIRS},
t AS (SELECT top.scene, top.r_id, top.n_id, iou, rank, CASE WHEN top.r_id % 7 <> 0 THEN string_split(r.p_name, ' ')[1] || ' ' || string_split(r.p_name, ' ')[2] END AS label,
  CASE WHEN top.n_id % 5 = 0 THEN '' ELSE string_split(n.p_name, ' ')[2] || ' ' || string_split(n.p_name, ' ')[1] END AS name FROM top JOIN r ON top.r_id = r.r_id JOIN n ON top.n_id = n.n_id WHERE rank <= 5),
s AS (SELECT *, CAST({similarity_sql('label', 'name')} AS DOUBLE) AS alike FROM t),
b AS (SELECT * FROM (SELECT *, iou * 0.6::DOUBLE + alike * 0.4::DOUBLE AS score FROM s) QUALIFY row_number() OVER (PARTITION BY scene, r_id ORDER BY score DESC, rank) = 1),
m AS (SELECT r.scene, r.r_id, n_id, CASE WHEN n_id IS NULL THEN 'visual-only' WHEN iou > 0.8 THEN 'exact' WHEN iou > 0.5 THEN 'contains' ELSE 'nearby' END AS relation, round(coalesce(b.score, 0), 6) AS confidence,
  CASE WHEN n_id IS NULL THEN 'not-applicable' WHEN alike > 0.8 THEN 'match' WHEN alike > 0.3 THEN 'partial' WHEN coalesce(label, '') <> '' AND name <> '' THEN 'contradiction' ELSE 'not-applicable' END AS agreement FROM r LEFT JOIN b ON r.r_id = b.r_id),
c AS (SELECT *, list_filter([CASE WHEN n_id IS NULL THEN 'dom-absent-visual-content' END, CASE WHEN agreement = 'contradiction' THEN 'aria-painted-disagreement' END, CASE WHEN n_id % 11 = 0 THEN 'canvas-content' END], lambda x: x IS NOT NULL) AS conflicts FROM m)"""


@QUERIES.add(f"{_MATCHED} SELECT scene, r_id, n_id, relation, confidence, agreement, array_to_string(conflicts, ' ') AS conflicts FROM c")
def reconciled_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The best node of every region by place and text, and what disagrees."""
    return _matched(spark, folder).withColumn("conflicts", F.array_join("conflicts", " "))


@QUERIES.add(f"""{_MATCHED} SELECT n.scene, 'n' || n.n_id AS node, 'dom' AS source, coalesce(count(r_id), 0) AS regions, coalesce(array_to_string(list_sort(list_distinct(flatten(list(conflicts)))), ' '), '') AS conflicts FROM n LEFT JOIN c ON n.n_id = c.n_id GROUP BY n.scene, n.n_id
UNION ALL SELECT scene, 'v' || r_id, 'vision', 1, array_to_string(conflicts, ' ') FROM c WHERE n_id IS NULL""")
def merged_scene(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with the conflicts of all their regions, then the regions of no node."""
    found = written(_matched(spark, folder), "matched")
    flags = found.where("n_id is not null").groupBy("n_id").agg(F.count(F.lit(1)).alias("regions"))
    each = found.where("n_id is not null").select("n_id", F.explode("conflicts").alias("c")).groupBy("n_id").agg(F.array_join(F.array_sort(F.collect_set("c")), " ").alias("conflicts"))
    nodes = _sides(spark, folder)[1].join(flags, "n_id", "left").join(each, "n_id", "left")
    dom = nodes.select("scene", F.concat(F.lit("n"), F.col("n_id").cast("string")).alias("node"), F.lit("dom").alias("source"), F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("conflicts", F.lit("")).alias("conflicts"))
    lone = found.where("n_id is null").select("scene", F.concat(F.lit("v"), F.col("r_id").cast("string")).alias("node"), F.lit("vision").alias("source"), F.lit(1).cast("bigint").alias("regions"), F.array_join("conflicts", " ").alias("conflicts"))
    return dom.unionByName(lone)
