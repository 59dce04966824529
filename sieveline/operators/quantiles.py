"""Exact order statistics of groups without gathering or sorting a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def ranked(rows: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``group`` and, by name, the values at ``ranks``: functions of a group's size
    that give a place from 1 on.

    A first aggregate counts values on a grid between a group's least and greatest
    one and tells in which cell a rank falls; a second one counts the values of
    these cells only. Null values are left out.
    """
    known = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    size = known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
    binned = known.join(size, "g").withColumn("cell", cell)
    cells = binned.groupBy("g", "n", "cell").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("cell")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("k")) for name, rank in ranks.items()]))
    hit = cells.withColumn("w", wanted).where("w.k <= upto and w.k > upto - c").select("g", "cell", F.col("w.name").alias("name"), (F.col("w.k") - F.col("upto") + F.col("c")).alias("k"))
    values = binned.join(hit.select("g", "cell").distinct(), ["g", "cell"], "left_semi").groupBy("g", "cell", "v").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "cell").orderBy("v")))
    found = values.join(hit, ["g", "cell"]).where("k <= upto and k > upto - c")
    return found.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


def nearest(p: float) -> Callable[[Column], Column]:
    """The nearest rank: the least place with a share of ``p`` up to it."""
    return lambda n: F.greatest(F.ceil(n * p), F.lit(1))


def at_floor(p: float) -> Callable[[Column], Column]:
    """The element at floor(n p), counted from 0."""
    return lambda n: F.floor(n * p) + 1
