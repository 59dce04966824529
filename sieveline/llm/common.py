"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Setting by which Spark drops a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: What separates words of the rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text
#: whose A-Z are not lower-cased yet.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests) is one made and set; on a cluster
    a folder of one machine would lose rows, so there it has to be given.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not set_dir.isDefined() and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = set_dir.get() if set_dir.isDefined() else "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and lets the
    optimizer plan the next join with the real size. Spark removes the shuffle
    files behind ``df`` as soon as it is written, and the written files when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, tag: str, which: Column) -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows for which ``which`` holds, counted
    while they are written: no query of its own that the driver has to plan."""
    seen = Observation()
    found = materialize(df.observe(seen, F.count(F.when(which, F.lit(1))).alias("n")), tag)
    return found, seen.get["n"]


def fresh_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for helper columns that ``df`` does not have, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, {}
    for name in wanted:
        found[name] = f"_{name}"
        while found[name].lower() in taken:
            found[name] = "_" + found[name]
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def row_key(df: DataFrame) -> list[Column]:
    """Columns none, id and key that name a row by its doc_id, of any type and
    null too, and the hash of its text. They join by plain equality."""
    kind = df.schema["doc_id"].dataType
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"), F.xxhash64("text").alias("key")]


ROW_KEY = ["none", "id", "key"]


def with_row_key(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its row key under names that it does not have yet."""
    names = fresh_names(df, *ROW_KEY)
    return df.withColumns({names[k]: c for k, c in zip(ROW_KEY, row_key(df), strict=True)}), names


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def alnum_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text,
    before lower-casing; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NON_WORD_RUN), "")


def with_run_hashes(df: DataFrame, column: str, steps: int) -> DataFrame:
    """Turn an array of longs into the hashes of its runs of ``2 ** steps``.

    Each step pairs every hash with the one just behind its run, so the work is
    ``steps`` passes and not one slice per position. Shorter arrays give none.
    """
    for step in range(steps):
        run = 2**step
        n = F.greatest(F.size(column) - run, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(column, 1, n), F.slice(column, run + 1, n), lambda a, b: F.xxhash64(a, b)))
    return df
