"""As-of joins: to each row the last row of another table before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, seconds: int = 86_400) -> DataFrame:
    """``left`` with column found: the last row of ``right`` (a struct) with the
    same ``by`` whose (``at``, ``tie``) is less, or null.

    Both have the columns ``by``, ``at`` (a timestamp) and ``tie``. Time is cut into
    buckets: a row finds its match in its own bucket or, failing that, takes what
    the buckets before it end with. So a key with a third of all rows is sorted by
    bucket and not as one; what is carried over is a row per key and bucket.
    """
    bucket = F.floor(F.unix_timestamp(at) / seconds)
    row = F.struct(*[F.col(c) for c in right.columns])
    told = right.select(*by, F.col(at), F.col(tie), bucket.alias("bucket"), row.alias("is"))
    both = left.withColumn("bucket", bucket).withColumn("is", F.lit(None).cast(told.schema["is"].dataType)).withColumn("side", F.lit(0))
    both = both.unionByName(told.withColumn("side", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "bucket").orderBy(at, tie, "side")
    mine = both.withColumn("found", F.last("is", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).where("side = 0").drop("is", "side")
    ends = both.groupBy(*by, "bucket").agg(F.max_by("is", F.when(F.col("side") == 1, F.struct(at, tie))).alias("end"))
    over = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(over)).where("carried is not null").drop("end")
    keys = [*by, "bucket"]
    joined = mine.join(carried, keys, "left") if by else mine
    return joined.select(*left.columns, F.coalesce("found", "carried").alias("found"))


#: How far a box may have moved.
TOLERANCE = 5
TARGETED = ("click", "focus", "type_text", "type_token", "select")


def moved(original: str, current: str) -> Column:
    """Why a target is not the one that was seen, or null if it is: structs with
    generation, frame, role, name, ancestry, x, y, w, h."""
    a, b = (lambda f: F.col(f"{original}.{f}")), (lambda f: F.col(f"{current}.{f}"))
    said = lambda text, f, quote="": F.concat(F.lit(f"{text}: expected {quote}"), a(f).cast("string"), F.lit(f"{quote}, got {quote}"), b(f).cast("string"), F.lit(quote))
    out = F.when(F.greatest(*[F.abs(a(f) - b(f)) for f in "xywh"]) > TOLERANCE, "bounding box moved materially")
    for f, text in (("ancestry", "ancestry changed"), ("name", "accessible name changed"), ("role", "role changed")):
        out = F.when(a(f) != b(f), said(text, f, '"')).otherwise(out)
    for f, text in (("frame", "frameId mismatch"), ("generation", "documentGeneration mismatch")):
        out = F.when(a(f) != b(f), said(text, f)).otherwise(out)
    return out


def staleness(seen: str = "seen", now: str = "now") -> Column:
    """The first reason why an action is stale, or null.

    Reads kind, target, plan_observation, observation, session, generation and the
    structs of the target as it was seen and as it is now.
    """
    bound = F.col("kind").isin(*TARGETED) & F.col("target").isNotNull()
    move = moved(seen, now)
    return (
        F.when(~F.col("plan_observation").eqNullSafe(F.col("observation")), F.concat(F.lit("Stale observation: plan from "), "plan_observation", F.lit(", current "), "observation"))
        .when(F.coalesce("session", F.lit("")) == "", "Missing session binding")
        .when(bound & F.col(seen).isNull(), F.concat(F.lit("Missing target fingerprint for "), "target"))
        .when(bound & (F.col(f"{seen}.generation") != F.col("generation")), "Document generation changed since observation")
        .when(bound & move.isNotNull(), F.concat(F.lit("Target stale: "), move))
    )
