"""Runs of characters as hashes, and a filter for them, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most slots of a filter.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 23


def with_run_hashes(df: DataFrame, name: str, text: str, size: int) -> DataFrame:
    """Adds ``name``: the hashes of all runs of ``size`` characters, in order.

    ``size`` is a power of two: each step pairs every hash with the one just
    behind its run, so the work is linear in the text. Shorter texts give none.
    """
    df = df.withColumn(name, F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.xxhash64(c)))
    run = 1
    while run < size:
        n = F.greatest(F.size(name) - run, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(name, 1, n), F.slice(name, run + 1, n), lambda a, b: F.xxhash64(a, b)))
        run *= 2
    return df


class SlotFilter:
    """A byte per slot, 1 where one of some hashes falls.

    There are 64 times as many slots as hashes, or more, from ``LEAST_SLOTS`` to
    ``MOST_SLOTS``: with very many hashes more gets through, and nothing is lost. At
    most one number a slot comes to the driver. The bytes go to the tasks as the
    value of a subquery, so that no plan spells them out; they can be asked in any
    filter or projection, but not within a lambda.
    """

    def __init__(self, hashes: DataFrame, column: str) -> None:
        known = hashes.select(F.col(column).alias("h")).where("h is not null")
        self.size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (64 * known.count()).bit_length()))
        slots = bytearray(self.size)
        for (slot,) in known.select(self._slot(F.col("h"))).distinct().collect():
            slots[slot] = 1
        self._table = hashes.sparkSession.createDataFrame([(bytes(slots),)], "slots binary")

    def _slot(self, value: Column) -> Column:
        return F.pmod(value, F.lit(self.size)).cast("int")

    def may_contain(self, value: Column) -> Column:
        """Whether a hash may be one of those that made the filter."""
        return F.substring(self._table.scalar(), self._slot(value) + 1, F.lit(1)) == F.lit(b"\x01")
