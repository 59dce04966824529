import struct

from sieveline.sources import tables


def test_readers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480))
    (tmp_path / "b.png").write_bytes(b"no picture at all, but long enough")
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in tables.read_png_size(spark, str(tmp_path)).collect()}
    assert sizes == {"a.png": (640, 480), "b.png": (1920, 1080)}
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "d.txt").write_text("x\n\ny\n")
    assert [tuple(r) for r in tables.read_dictionary(spark, str(tmp_path / "words")).collect()] == [(0, "x"), (1, "y"), (2, " ")]
    (tmp_path / "truth.json").write_text('{"entities": [{"id": "p1", "value": "v"}, {"id": "p2", "value": "w"}]}')
    assert tables.read_ground_truth(spark, str(tmp_path / "truth.json"), "entities").count() == 2


def test_sinks(spark, tmp_path):
    audit = spark.createDataFrame([("0123456789abcdefghij", "email")], "seal string, category string")
    for _ in range(2):
        tables.append_audit(audit, str(tmp_path / "audit"))
    assert [r.seal for r in spark.read.parquet(str(tmp_path / "audit")).collect()] == ["0123456789abcdef"] * 2
    metrics = spark.createDataFrame([("p50", 1.5, "ms", "A")], "metric string, value double, unit string, config string")
    tables.write_metrics_csv(metrics, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().metric == "p50"
