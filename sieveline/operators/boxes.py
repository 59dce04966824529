"""Joins and folds over boxes x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def iou(a: str, b: str) -> Column:
    """Intersection over union of columns such as a_x, a_y, a_w, a_h."""
    side = lambda p, size: F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{p}") + F.col(f"{a}_{size}"), F.col(f"{b}_{p}") + F.col(f"{b}_{size}")) - F.greatest(F.col(f"{a}_{p}"), F.col(f"{b}_{p}")))
    both = side("x", "w") * side("y", "h")
    union = F.col(f"{a}_w") * F.col(f"{a}_h") + F.col(f"{b}_w") * F.col(f"{b}_h") - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def cells(p: str, size: int) -> Column:
    one = lambda at, length: F.sequence(F.floor(F.col(f"{p}_{at}") / size), F.floor((F.col(f"{p}_{at}") + F.col(f"{p}_{length}")) / size))
    return F.explode(F.flatten(F.transform(one("x", "w"), lambda cx: F.transform(one("y", "h"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))))


def overlapping(regions: DataFrame, nodes: DataFrame, least: float, cell: int = 256) -> DataFrame:
    """Pairs of a scene with IoU above ``least``: both sides' columns and iou.

    Boxes are dealt to the grid cells they touch, so the join is by equality; a
    pair is kept in the cell of the intersection's corner only, so that it is
    found once without a distinct. Regions have scene, r_id, r_x, r_y, r_w, r_h;
    nodes n_id, n_x and so on.
    """
    left = regions.withColumn("c", cells("r", cell))
    right = nodes.withColumnRenamed("scene", "n_scene").withColumn("d", cells("n", cell))
    met = left.join(right, (left["scene"] == right["n_scene"]) & (left["c"]["cx"] == right["d"]["cx"]) & (left["c"]["cy"] == right["d"]["cy"]))
    corner = (F.floor(F.greatest("r_x", "n_x") / cell) == F.col("c.cx")) & (F.floor(F.greatest("r_y", "n_y") / cell) == F.col("c.cy"))
    return met.where(corner).withColumn("iou", iou("r", "n")).where(F.col("iou") > least).drop("c", "d", "n_scene")


def best_overlaps(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each region, ties by node."""
    w = Window.partitionBy("scene", "r_id").orderBy(F.col("iou").desc(), "n_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suppress(boxes: DataFrame, least: float) -> DataFrame:
    """Greedy non-maximum suppression of each scene: b_id, score by rank.

    A scene's boxes are folded in order of score; one that overlaps a kept one
    by more than ``least`` goes. Scenes hold an image's boxes, a few hundred.
    """
    box = F.struct((-F.col("score")).alias("s"), F.col("b_id").alias("id"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.col("b_w").alias("w"), F.col("b_h").alias("h"))
    lists = boxes.groupBy("scene").agg(F.array_sort(F.collect_list(box)).alias("l"))

    def over(p: Column, q: Column) -> Column:
        wide = F.greatest(F.lit(0.0), F.least(p["x"] + p["w"], q["x"] + q["w"]) - F.greatest(p["x"], q["x"]))
        high = F.greatest(F.lit(0.0), F.least(p["y"] + p["h"], q["y"] + q["h"]) - F.greatest(p["y"], q["y"]))
        both = wide * high
        return both / (p["w"] * p["h"] + q["w"] * q["h"] - both) > least

    kind = boxes.select(F.array(box).alias("l")).schema["l"].dataType.simpleString()
    kept = F.aggregate("l", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: over(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select("scene", F.posexplode(kept).alias("rank", "k")).select("scene", F.col("k.id").alias("b_id"), "rank")


def stabbed(points: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """``points`` (scene, px, py and others) with top: the box (a struct) that lies
    uppermost there, by z and then the later b_id; null if there is none.

    Boxes (scene, b_id, b_x, b_y, b_w, b_h, z) are dealt to the grid cells they
    touch and a point looks into its own cell only. Sides belong to a box but for
    the far ones.
    """
    columns = points.columns
    numbered = points.withColumn("_p", F.monotonically_increasing_id())
    held = boxes.withColumn("c", cells("b", cell)).select(F.col("scene").alias("s"), "c", F.struct(*boxes.columns).alias("box"))
    at = F.struct(F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy"))
    numbered = written(numbered.withColumn("at", at), "points")
    met = numbered.join(held, (F.col("scene") == F.col("s")) & (F.col("at") == F.col("c")))
    inside = (F.col("px") >= F.col("box.b_x")) & (F.col("px") < F.col("box.b_x") + F.col("box.b_w")) & (F.col("py") >= F.col("box.b_y")) & (F.col("py") < F.col("box.b_y") + F.col("box.b_h"))
    top = met.where(inside).groupBy("_p").agg(F.max_by("box", F.struct("box.z", "box.b_id")).alias("top"))
    return numbered.join(top, "_p", "left").select(*columns, "top")


def _near(a: DataFrame, b: DataFrame, dx: int, dy: int) -> DataFrame:
    """Pairs of a scene within dx and dy: scene, i (of a), j (of b)."""
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    at = lambda d: F.struct((F.floor(F.col("x") / (dx + 1)) + d["x"]).alias("x"), (F.floor(F.col("y") / (dy + 1)) + d["y"]).alias("y"))
    left = a.select("scene", F.col("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.explode(F.transform(around, at)).alias("c"))
    right = b.select("scene", F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.struct(F.floor(F.col("x") / (dx + 1)).alias("x"), F.floor(F.col("y") / (dy + 1)).alias("y")).alias("c"))
    return left.join(right.hint("merge"), ["scene", "c"]).where((F.abs(F.col("xi") - F.col("xj")) <= dx) & (F.abs(F.col("yi") - F.col("yj")) <= dy)).select("scene", "i", "j")


def seeded_groups(blocks: DataFrame, dx: int, dy: int) -> DataFrame:
    """scene, i and seed: blocks (scene, i, x, y) as a walk in the order of i would
    group them, where a block that no seed before it reaches is a seed and takes
    whatever it reaches and is free.

    A block is a seed for certain once no undecided block before it reaches it. So
    every round takes all such blocks of all scenes at once, and what they reach
    is decided with them; no scene is folded as a whole. Pairs with a decided block
    go, so a round reads what is left. All of these grow with the tables, so they
    are joined by merging: Spark would broadcast them by their small columns. A block
    without scene or i has no group.
    """
    near = written(_near(blocks, blocks, dx, dy).where("i < j"), "near")
    open_, alive, seeds = written(blocks.select("scene", "i").dropna(), "open"), near, []
    while not open_.isEmpty():
        later = alive.select("scene", F.col("j").alias("i")).hint("merge")
        fresh = written(open_.join(later, ["scene", "i"], "left_anti"), "seeds")
        seeds.append(fresh)
        reached = alive.join(fresh.hint("merge"), ["scene", "i"], "left_semi").select("scene", F.col("j").alias("i"))
        open_ = written(open_.join(fresh.unionByName(reached).hint("merge"), ["scene", "i"], "left_anti"), "open")
        left = open_.hint("merge")
        alive = written(alive.join(left, ["scene", "i"], "left_semi").join(left.withColumnRenamed("i", "j").hint("merge"), ["scene", "j"], "left_semi"), "near")
    if not seeds:
        return blocks.select("scene", "i", F.col("i").alias("seed"))
    every = seeds[0]
    for more in seeds[1:]:
        every = every.unionByName(more)
    every = written(every, "seeds").hint("merge")
    taken = near.join(every, ["scene", "i"], "left_semi").select("scene", F.col("j").alias("i"), F.col("i").alias("seed"))
    own = every.select("scene", "i", F.col("i").alias("seed"))
    return own.unionByName(taken).groupBy("scene", "i").agg(F.min("seed").alias("seed"))


def areas(regions: DataFrame, width: float, height: float, cell: int = 128) -> DataFrame:
    """scene, summed and united: the area of a scene's regions (scene, r_x, r_y, r_w,
    r_h) within its image, overlaps counted twice and once.

    Regions are cut at the grid cells. In a cell the x of all sides make slabs; in a
    slab the y intervals are swept in order, and what lies above the greatest end so
    far counts. Cells are small, so no scene is swept in one task.
    """
    x0, y0 = F.greatest("r_x", F.lit(0.0)), F.greatest("r_y", F.lit(0.0))
    x1, y1 = F.least(F.col("r_x") + F.col("r_w"), F.lit(width)), F.least(F.col("r_y") + F.col("r_h"), F.lit(height))
    clipped = regions.select("scene", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).where("x1 > x0 and y1 > y0")
    summed = clipped.groupBy("scene").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("summed"))
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.ceil(F.col(b) / cell) - 1))
    pieces = clipped.withColumn("cx", over("x0", "x1")).withColumn("cy", over("y0", "y1"))
    low = lambda v, c: F.greatest(F.col(v), F.col(c) * float(cell)).alias(v)
    high = lambda v, c: F.least(F.col(v), (F.col(c) + 1) * float(cell)).alias(v)
    pieces = written(pieces.select("scene", "cx", "cy", low("x0", "cx"), low("y0", "cy"), high("x1", "cx"), high("y1", "cy")).distinct(), "pieces")
    where = ["scene", "cx", "cy"]
    sides = pieces.groupBy(*where).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("x0", "x1"))))).alias("xs"))
    slabs = pieces.join(sides, where).select(*where, "y0", "y1", F.explode(F.filter(F.zip_with(F.slice("xs", 1, F.size("xs") - 1), F.slice("xs", 2, F.size("xs")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: (s["a"] >= F.col("x0")) & (s["b"] <= F.col("x1")))).alias("s"))
    order = Window.partitionBy(*where, "s").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(order), F.col("y0"))))
    united = slabs.withColumn("part", (F.col("s.b") - F.col("s.a")) * fresh).groupBy("scene").agg(F.sum("part").alias("united"))
    return summed.join(united, "scene")
