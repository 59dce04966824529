import random

from pyspark.sql import functions as F

from sieveline.plans import sessions
from sieveline.streaming import machine

AT = "/root/testdata/sf0.001"
STORE = "spark.sql.streaming.stateStore.providerClass"


def test_stream_of_shuffled_events_is_as_the_table(spark, tmp_path):
    rows = sessions.machine_events(sessions.events(spark, AT))
    want = sorted(map(tuple, machine.outcomes_of_table(rows, sessions.TWO_DAYS).collect()))
    parts = rows.withColumn("ts", F.col("ts").cast("timestamp")).toPandas().sample(frac=1, random_state=3)
    schema = rows.withColumn("ts", F.col("ts").cast("timestamp")).schema
    end = parts["ts"].max()
    last = parts.iloc[:1].assign(tab=-1, kind="pause", event_id=-1, ts=end + 12 * (end - parts["ts"].min()))
    half = len(parts) // 2
    for part in (parts[:half], parts[half:], last):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = machine.outcomes_of_stream(stream, sessions.TWO_DAYS, "60 days")
        query = found.writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(tuple(r) for r in spark.table("outcomes").collect() if r.tab != -1)
    finally:
        spark.conf.set(STORE, before)
    assert got == want and {o for _, _, o in got} >= {"paused", "timeout", "late"}


def test_machine_rules():
    m = machine.Machine(wait_ms=60_000)
    assert m.step("ask", 1, 0, 7, 0) == [(1, "rejected")] and m.step("pause", 2, 1, 0, 0) == [(2, "ignored")]
    m.step("start", 3, 2, 0, 0)
    assert m.step("ask", 4, 10, 7, 0) == [] and m.step("ask", 5, 20, 7, 0) == [(5, "duplicate")]
    assert m.step("answer", 6, 60_010, 7, 0) == [(4, "confirmed")] and m.step("answer", 7, 60_011, 7, 0) == []
    m.step("ask", 8, 70_000, 1, 0)
    assert m.step("result", 9, 130_001, 0, 1) == [(8, "timeout"), (9, "accepted")]
    m.step("ask", 10, 140_000, 1, 0)
    m.step("start", 11, 140_001, 0, 0)
    assert m.step("result", 12, 140_002, 0, 1) == [(12, "late")] and m.step("answer", 13, 140_003, 1, 0) == [(10, "stale")]
    assert m.step("pause", 14, 140_004, 0, 0) == [(14, "paused")] and m.step("result", 15, 140_005, 0, 2) == [(15, "late")] and m.step("resume", 16, 140_006, 0, 0) == [(16, "resumed")]


def test_packing_keeps_the_machine():
    r = random.Random(1)
    a = machine.Machine(50)
    for k in range(300):
        event = (r.choice(["start", "pause", "resume", "ask", "answer", "result"]), k, k * 7, r.randint(0, 4), r.randint(0, 3))
        b = machine.Machine.unpacked(50, a.packed())
        assert a.step(*event) == b.step(*event) and a.packed() == b.packed()
