from pyspark.sql import functions as F

from sieveline.plans import layout
from sieveline.plans import sessions as batch
from sieveline.streaming import sessions

AT = "/root/testdata/sf0.001"


def drained(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_changed_tiles_as_in_the_batch(spark):
    found = drained(sessions.changed_tiles(sessions.read_events(spark, AT)), "tiles")
    want = layout.changed_tiles(spark, AT)
    assert sorted(r.event_id for r in found.collect()) == sorted(r.event_id for r in want.collect())


def test_first_seen_drops_repeats(spark):
    events = sessions.read_events(spark, AT)
    found = drained(sessions.first_seen(events.unionByName(events)), "seen")
    assert found.count() == spark.read.parquet(f"{AT}/events.parquet").select("event_id").distinct().count()


def test_live_grants_as_in_the_batch(spark, tmp_path):
    tables = {}
    for name, df, at in (("g", batch._grants(spark, AT), "created_at"), ("a", batch._attempts(spark, AT), "at")):
        df = df.withColumn(at, F.col(at).cast("timestamp"))
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    found = drained(sessions.live_grants(tables["g"], tables["a"], list(batch.BINDINGS), late="90 days"), "live")
    want = batch.grant_redeem_outcomes(spark, AT).where("outcome in ('OK', 'GRANT_ALREADY_CONSUMED')")
    assert sorted(r.attempt_id for r in found.collect()) == sorted(r.attempt_id for r in want.collect())


def test_debounced_bursts(spark, tmp_path):
    rows = [(1, 1, 0.0), (2, 1, 0.1), (3, 1, 0.5), (4, 2, 0.0), (5, 9, 9000.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double").select("event_id", "user_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    events.write.parquet(str(tmp_path / "e"))
    found = drained(sessions.debounced(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))), "bursts")
    assert sorted((r.user_id, r.n, r.last_id) for r in found.collect()) == [(1, 1, 3), (1, 2, 2), (2, 1, 4)]
