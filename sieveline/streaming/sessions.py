"""Structured Streaming forms of the session operators.

Each takes a streaming DataFrame of events (event_id, user_id, ts, event_type,
value, props) and returns one; the batch queries say what they must give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    # Watermarks need a time with a zone.
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(events: DataFrame, gap: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """The last event of each burst: user_id, start, end, n, last_id."""
    bursts = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last_id")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events whose event_id was not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def changed_tiles(events: DataFrame, tiles: int = 4) -> DataFrame:
    """Events whose tile hash differs from the tile's last one: event_id, tab, tile, hash.

    State is one hash for each tab and tile.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        changed = rows["hash"].ne(rows["hash"].shift(fill_value=last if last is not None else ""))
        state.update((rows["hash"].iloc[-1],))
        yield rows[changed].assign(tab=key[0], tile=key[1])[["event_id", "tab", "tile", "hash"]]

    hashed = events.select("event_id", F.col("user_id").alias("tab"), (F.col("event_id") % tiles).alias("tile"), "ts", F.substring(F.sha2(F.coalesce("props", F.lit("")), 256), 1, 16).alias("hash"))
    return hashed.groupBy("tab", "tile").applyInPandasWithState(step, "event_id long, tab long, tile long, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def live_grants(grants: DataFrame, attempts: DataFrame, bindings: list[str], ttl: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Attempts (attempt_id, token, at, said_ and a binding) at grants (grant_id,
    created_at, the bindings) that meet a live grant with every binding right:
    attempt_id, grant_id. A grant's state goes when its time has passed."""
    g, a = grants.withWatermark("created_at", late), attempts.withWatermark("at", late)
    right = (F.col("token") == F.col("grant_id")) & (F.col("at") >= F.col("created_at")) & (F.col("at") <= F.col("created_at") + F.expr(f"INTERVAL {ttl}"))
    for b in bindings:
        right = right & F.col(f"said_{b}").eqNullSafe(F.col(b))
    return a.join(g, right).select("attempt_id", "grant_id")
