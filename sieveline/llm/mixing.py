"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies.
Two documents at a time move word mass between them until one holds a whole
number; the other stays pending. Documents are dealt to buckets of bounded
size, each bucket leaves one pending document, and those meet again in buckets
of the next level: a reduction tree whose depth is a logarithm. Word mass is
kept at every step, so a source misses its target by one document at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, fresh_names, materialize, row_key, space_words, with_row_key

#: Documents that one bucket rounds. Buckets are dealt to seven eighths, so that
#: chance does not fill one further.
BUCKET = 4096


def _before(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with the sums over all rows before each in an order without ties.

    Rows are dealt by ranges and summed in each; only the ranges' totals meet,
    so no task holds all rows.
    """
    dealt = materialize(df.withColumns(sums).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    by_range, inside = Window.orderBy("range"), Window.partitionBy("range").orderBy(*order)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = totals.select("range", *[upto(f"t_{c}", by_range).alias(f"e_{c}") for c in sums])
    return dealt.join(earlier, "range").select(*df.columns, *[(F.col(f"e_{c}") + upto(c, inside)).alias(c) for c in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: n, source_size, target. ``sizes`` has source and size.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words; none gets over ``most`` times its own. Filling
    stops at the level that is the largest of (rest of the words) / (rest of the
    weights) over the sources in the order in which they fill up.
    """
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    by_name, nth = F.col("source").asc_nulls_last(), F.array(*map(F.lit, weights))
    weighed = _before(totals, [by_name], turn=F.lit(1)).withColumn("weight", F.get(nth, (F.col("turn") % len(weights)).cast("int"))).drop("turn")
    filled = materialize(_before(weighed, [(F.col("source_size") / F.col("weight")).asc(), by_name], words=F.col("source_size"), weights=F.col("weight")), "filled")
    whole = filled.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights")).crossJoin(filled.select("words", "weights"))
    level = whole.agg(F.max((F.col("all_words") * share - F.col("words") * most) / (F.col("all_weights") - F.col("weights"))).alias("level"))
    return filled.crossJoin(level).select("source", "n", "source_size", F.least(F.col("level") * F.col("weight"), F.col("source_size") * most).alias("target"))


def _pivot(table: pa.Table) -> pa.Table:
    """Round one bucket: all but one of its documents get a whole number."""
    size, f, draw = (table[c].to_numpy() for c in ("size", "f", "draw"))
    # Large documents first: the one left pending is then a small one.
    order = np.lexsort((draw, -size))
    s, x, u = size[order].astype(float).tolist(), f[order].tolist(), draw[order].tolist()
    i = 0
    for j in range(1, len(s)):
        up_room, up_have = (1 - x[i]) * s[i], x[j] * s[j]
        down_have, down_room = x[i] * s[i], (1 - x[j]) * s[j]
        up, down = min(up_room, up_have), min(down_have, down_room)
        if u[j] * (up + down) < down:
            if up_room <= up_have:
                x[i], x[j], i = 1.0, (up_have - up_room) / s[j], j
            else:
                x[j], x[i] = 0.0, x[i] + up_have / s[i]
        elif down_have <= down_room:
            x[i], x[j], i = 0.0, x[j] + down_have / s[j], j
        else:
            x[j], x[i] = 1.0, x[i] - down_room / s[i]
    pending = np.zeros(len(s), bool)
    if 1e-12 < x[i] < 1 - 1e-12:
        pending[i] = True
    else:
        x[i] = float(round(x[i]))
    back = np.empty(len(s), np.int64)
    back[order] = np.arange(len(s))
    for name, values in (("f", np.array(x)[back]), ("pending", pending[back])):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
    return table


def _draw(level: int) -> Column:
    """A number from 0 to 1 that depends on the document and the level only."""
    return F.shiftrightunsigned(F.xxhash64(*ROW_KEY, "number", F.lit(f"draw {level}")), 11) / F.lit(float(2**53))


def _numbered(sized: DataFrame) -> DataFrame:
    """Rows alike in full get numbers, so that they can be dealt apart. They are
    counted first and made again in blocks: no task holds all of them."""
    counted = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("rows"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / BUCKET)))).repartition(*ROW_KEY, "block")
    last = F.least(F.col("rows") - 1, F.col("block") * BUCKET + (BUCKET - 1))
    return blocks.withColumn("number", F.explode(F.sequence(F.col("block") * BUCKET, last))).select(*sized.columns, "number")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, bucket: int = BUCKET) -> DataFrame:
    """How many copies of every document the mix takes.

    Returns one row per row of ``docs``: doc_id, none, id and key (which name the
    row), source, size, source_size, target, copies, taken. A null or wordless
    text has size zero and is not taken; a null source is a source of its own;
    repeated rows are rounded each for itself; texts of any length count whole.
    Draws are hashes, so reruns agree, whatever the partitions. Extra columns
    are not read; an empty table gives an empty result.
    """
    sized = materialize(docs.select("doc_id", *row_key(docs), "source", F.size(space_words(F.col("text"))).cast("long").alias("size")), "sizes")
    plan = materialize(targets(sized, weights, share, most), "targets").withColumnRenamed("source", "_source")
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        _numbered(sized).join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("base", F.floor(ratio))
        .withColumn("f", ratio - F.col("base"))
        .withColumn("bucket", F.pmod(F.xxhash64(*ROW_KEY, "number", F.lit("bucket")), F.ceil(F.col("n") * 8 / (7 * bucket))))
        .withColumn("pending", F.col("f") > 0)
        .select("doc_id", *ROW_KEY, "number", "source", "size", "source_size", "target", "base", "f", "bucket", "pending")
    )
    rows = materialize(rows, "rows")
    parts = [rows.where("not pending")]
    rows, level = rows.where("pending"), 0
    while True:
        drawn = rows.withColumn("draw", _draw(level))
        rows = materialize(drawn.groupBy("source", "bucket").applyInArrow(_pivot, drawn.schema).drop("draw"), f"level{level}")
        parts.append(rows.where("not pending"))
        rows, level = rows.where("pending"), level + 1
        if not (rows.agg(F.max("bucket")).first()[0] or 0):
            break
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / bucket))
    # At the root one document of a source is pending; the nearer whole number.
    parts.append(rows.withColumn("f", F.round("f")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = (F.col("base") + F.col("f")).cast("long")
    return out.select("doc_id", *ROW_KEY, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: What a mix adds to its documents.
ADDED = ("size", "source_size", "target", "copies", "taken")


def apply_mix(docs: DataFrame, **settings: float) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies
    and taken; a column of ``docs`` that has one of these names goes before as
    ``<name>_before``. Rows alike in doc_id and text become one with all their
    copies. Nulls, texts of any length and empty tables are as in ``mix``."""
    while clash := [c for c in docs.columns if c.lower() in ADDED]:
        free = fresh_names(docs, *[f"{c}_before" for c in clash])
        docs = docs.withColumnsRenamed({c: f"{c}_before" if f"{c}_before".lower() not in map(str.lower, docs.columns) else free[f"{c}_before"] for c in clash})
    keyed, names = with_row_key(docs)
    per_row = [F.first(c).alias(c) for c in ADDED[:3]]
    found = mix(docs, **settings).groupBy(*ROW_KEY).agg(*per_row, F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    found = found.where("copies > 0").withColumnsRenamed({k: f"{v}_" for k, v in names.items()})
    mine = [F.col(names[k]) == F.col(f"{names[k]}_") for k in ROW_KEY]
    kept = keyed.dropDuplicates([names[k] for k in ROW_KEY])
    return kept.join(found, mine).select(*docs.columns, *ADDED)
