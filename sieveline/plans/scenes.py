"""Queries over element lists and checksums, with their SQL.

Nodes are made from parts: role, name and box follow from the key by the same
whole-number rule on both sides. A scene is a run of ``PARTS`` keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checksums
from ..operators import grids, scene
from ..sources.tables import table
from .layout import PARTS
from .registry import Registry

QUERIES = Registry()
ROLES = ("link", "generic", "heading", "navigation", "paragraph", "textbox", "main", "img", "button", "list")
TASK = "search for the red linen of paint"
_TERMS = ("red", "linen", "paint")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    source = F.when(k % 4 == 0, F.array(F.lit("dom"), F.lit("vision"))).when(k % 4 == 3, F.array(F.lit("vision"))).otherwise(F.array(F.lit("dom")))
    box = {"x": (k * 37) % 2400 - 300, "y": (k * 53) % 1600 - 300, "w": 20 + (k * 7) % 180, "h": 10 + (k * 11) % 90}
    return table(spark, folder, "part").select(
        F.floor(k / PARTS).alias("scene"), k.alias("n_id"), k.alias("ord"), F.get(F.array(*map(F.lit, ROLES)), (k % 10).cast("int")).alias("role"),
        F.when(k % 6 == 0, "").otherwise(F.element_at(F.split("p_name", " "), 1)).alias("name"), F.lit(None).cast("string").alias("value"),
        F.when(k % 13 == 0, "clickable").alias("actionability"), source.alias("source"), *[v.cast("double").alias(c) for c, v in box.items()],
    )


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BASE = f"""WITH n AS (SELECT k // {PARTS} AS scene, k AS n_id, CASE k % 10 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES))} END AS role,
  CASE WHEN k % 6 = 0 THEN '' ELSE string_split(p_name, ' ')[1] END AS name, k % 13 = 0 AS state, k % 4 <> 3 AS dom, k % 4 = 0 AS both_,
  (k * 37) % 2400 - 300 AS x, (k * 53) % 1600 - 300 AS y, 20 + (k * 7) % 180 AS w, 10 + (k * 11) % 90 AS h FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_name FROM part)),
d AS (SELECT *, name <> '' AND row_number() OVER (PARTITION BY scene, role, lower(trim(name)) ORDER BY n_id) > 1 AS dup,
  x + w > -100 AND y + h > -100 AND x < 1380 AND y < 900 AS vw, role IN {_in(scene.ACTIONABLE_ROLES)} OR state AS act,
  {' OR '.join(f"contains(lower(name || '  ' || role), '{t}')" for t in _TERMS)} AS term FROM n),
t AS (SELECT *, CASE WHEN term AND act THEN 0 WHEN act AND vw AND dom THEN 1 WHEN act AND dom THEN 2 WHEN both_ AND vw THEN 3 WHEN role IN {_in(scene.NAV_FORM_ROLES)} THEN 4 WHEN term THEN 5
  WHEN role IN {_in(scene.STRUCTURE_ROLES)} AND vw THEN 6 WHEN dom AND vw AND NOT dup THEN 7 WHEN dom AND NOT dup THEN 8 WHEN NOT dom AND vw AND NOT dup THEN 9 WHEN dup THEN 10 ELSE 11 END AS tier FROM d),
c AS (SELECT scene, n_id, tier, row_number() OVER (PARTITION BY scene ORDER BY tier, n_id) AS k FROM t)"""


@QUERIES.add(f"{_BASE} SELECT scene, n_id, tier FROM c WHERE k <= 30")
def scene_compaction(spark: SparkSession, folder: str) -> DataFrame:
    return scene.compact(_nodes(spark, folder), TASK, 30)


@QUERIES.add(f"{_BASE} SELECT tier, count(*) AS n FROM c WHERE k <= 500 GROUP BY tier")
def compaction_tier_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return scene.compact(_nodes(spark, folder), TASK, 500).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add(f"{_BASE} SELECT scene, n_id FROM d WHERE dup")
def duplicate_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder)
    name = F.lower(F.trim("name"))
    k = F.row_number().over(Window.partitionBy("scene", "role", name).orderBy("ord"))
    return nodes.withColumn("k", k).where((name != "") & (F.col("k") > 1)).select("scene", "n_id")


@QUERIES.add()
def harvest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return scene.harvest(table(spark, folder, "pages"))


@QUERIES.add("""WITH d AS (SELECT p_partkey AS key, lpad(CAST((p_partkey * 7919) % 1000000000000 AS VARCHAR), 16, '4') AS v FROM part)
 SELECT CAST(key AS BIGINT) AS key, list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(v)[i] AS INT) WHEN 2 * CAST(reverse(v)[i] AS INT) > 9 THEN 2 * CAST(reverse(v)[i] AS INT) - 9 ELSE 2 * CAST(reverse(v)[i] AS INT) END for i in range(1, 17)]) % 10 = 0 AS luhn,
 list_reduce([CAST(x AS BIGINT) for x in string_split(substr(v, 5) || substr(v, 1, 4), '')], lambda a, b: (a * 10 + b) % 97) = 1 AS mod97 FROM d""")
def card_checksums(spark: SparkSession, folder: str) -> DataFrame:
    v = F.lpad(((F.col("p_partkey") * 7919) % 1000000000000).cast("string"), 16, "4")
    return table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("key"), checksums.luhn(v).alias("luhn"), checksums.mod97(v).alias("mod97"))


@F.pandas_udf(T.DoubleType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over the longer length."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        if not x or not y:
            out.append(0.0)
            continue
        codes, row = np.frombuffer(y.encode("utf-32-le"), np.uint32), np.zeros(len(y) + 1, np.int64)
        for c in np.frombuffer(x.encode("utf-32-le"), np.uint32):
            grown = np.maximum(row[1:], row[:-1] + (codes == c))
            row[1:] = np.maximum.accumulate(grown)
        out.append(1.0 if x == y else float(row[-1]) / max(len(x), len(y)))
    return pd.Series(out)


def similarity_sql(a: str, b: str) -> str:
    """The same by a fold over the characters of ``a``: each makes a new row of
    lengths from the one before, as a running greatest value."""
    row = f"list_prepend(0, [list_max([greatest(row[k + 1], row[k] + CASE WHEN ord({b}[k]) = x[1] THEN 1 ELSE 0 END) FOR k IN range(1, j + 1)]) FOR j IN range(1, length({b}) + 1)])"
    rows = f"list_prepend([0 FOR j IN range(0, length({b}) + 1)], [[ord({a}[i])] FOR i IN range(1, length({a}) + 1)])"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0 WHEN {a} = {b} THEN 1 ELSE list_reduce({rows}, lambda row, x: {row})[length({b}) + 1] / greatest(length({a}), length({b})) END"


@QUERIES.add(f"SELECT p_partkey, round({similarity_sql('p_name', 'p_type')}, 6) AS similarity FROM part")
def lcs_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.round(common_subsequence("p_name", "p_type"), 6).alias("similarity"))


@QUERIES.add("""WITH RECURSIVE o AS (SELECT vec_id, i - 1 AS c, CAST(embedding[i] AS DOUBLE) AS p FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) // 8 * 8 + 1)) AS i) WHERE CAST(embedding[i] AS DOUBLE) > 0.1::DOUBLE),
reach(vec_id, a, b) AS (SELECT vec_id, c, c FROM o UNION SELECT r.vec_id, r.a, o.c FROM reach r JOIN o ON o.vec_id = r.vec_id AND abs(o.c - r.b) IN (1, 8)),
k AS (SELECT o.vec_id, o.c, o.p, min(a) AS component FROM o JOIN reach r ON r.vec_id = o.vec_id AND r.b = o.c GROUP BY ALL)
SELECT * FROM (SELECT vec_id, component, count(*) AS cells, min(c % 8) AS x0, min(c // 8) AS y0, max(c % 8) AS x1, max(c // 8) AS y1, round(avg(p), 6) AS mean FROM k GROUP BY vec_id, component) WHERE (x1 - x0 + 1) * (y1 - y0 + 1) >= 3 AND mean >= 0.14""")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of vectors as grids of eight columns."""
    return grids.components(table(spark, folder, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long")), "vec_id", "embedding", 8, 0.1, 3, 0.14, 6)
