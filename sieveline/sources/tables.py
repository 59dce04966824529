"""The Parquet tables of a folder, and the sinks of results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A scan of files for work that is heavy on processors.

    A small table may lie in fewer files than there are cores, each with one group
    of rows, and then a few tasks would do everything. Such a scan is dealt out
    once; one that has more splits than cores stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    few = len(scan.inputFiles()) < cores and scan.rdd.getNumPartitions() <= 2 * cores
    return scan.repartition(2 * cores) if few else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    A local session without the setting gets one of its own; on a cluster a
    folder of one machine would lose rows, so there it has to be given.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its plan is cut in a
    way that survives lost executors. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """A long table: metric, value, unit, config."""
    metrics.select("metric", "value", "unit", "config").write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Category-only audit rows; a seal is cut to sixteen characters."""
    rows.withColumn("seal", F.substring("seal", 1, 16)).write.mode("append").parquet(path)


def read_ground_truth(spark: SparkSession, path: str, field: str) -> DataFrame:
    """A JSON document with one nested array, as rows."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(field))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One symbol a line, empty lines dropped, a blank appended: index, symbol.

    The file is one value, so the order of its lines is kept.
    """
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda x: x != "").alias("s"))
    return lines.select(F.posexplode(F.concat("s", F.array(F.lit(" ")))).alias("index", "symbol"))


def read_png_size(spark: SparkSession, path: str) -> DataFrame:
    """Width and height from the headers of PNG files, else 1920 by 1080."""
    files = spark.read.format("binaryFile").load(path)
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.select("path", F.when(png, number(17)).otherwise(1920).alias("width"), F.when(png, number(21)).otherwise(1080).alias("height"))


def read_models(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files with their SHA-256 against a manifest (name, sha256): path, name, intact."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return files.join(manifest, "name", "left").select("path", "name", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("intact"))
