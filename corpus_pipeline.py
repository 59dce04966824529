"""The corpus pipeline: documents in, a cleaned and weighted mix out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Each is written
as Parquet and read again, so a stage works on what its predecessor kept and a
lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import decontaminate, mixing, pii, quality, simhash
from sieveline.llm.common import shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their copies in the mix; those with none go."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", remove_contaminated),
    ("pii", redact),
    ("mixing", mix),
]

#: Robust estimates, bootstrapping and pivotal rounding are not SQL; tests/llm
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Nulls in any column, empty and very long texts, repeated rows and clashing
    names are treated as each stage's docstring says; an empty table passes through
    all stages. A stage's files go once the next one is written, the last one's
    when the application ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs
    top = files.Path(at)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(top)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None:
            system.delete(files.Path(before), True)
        before = f"{at}/{name}"
    return docs
