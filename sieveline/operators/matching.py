"""Greedy one-to-one matching of ordered truths and findings.

Taken in order, every truth gets the first finding that fits it and is still
free. Truths (and findings) of one group that are alike in kind and value fit the
same ones, so they are one node with an ordered list of places; that way a value
that occurs a thousand times has one edge and not a million. The nodes are matched
in rounds: where two nodes are each other's first choice, all their places up to
the next choice of either are matched at once, which is what the sequential walk
does. Groups never meet, and a round is a few joins over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Characters of the pieces by which contained values meet.
PIECE = 4


def _pieces(value: str) -> Column:
    """All pieces of one to ``PIECE`` characters of a short value."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - n + 1, F.lit(1))), lambda i: F.substring(F.col(value), i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*map(at, range(1, PIECE + 1)))))


def containments(outer: DataFrame, inner: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of ``outer`` (columns ``by``, o, o_value) and ``inner`` (``by``, i,
    i_value) where the outer value holds the inner one: ``by``, o, i.

    An inner value meets outer ones by its first piece, which the outer one must
    have too; so only values that share a piece are compared.
    """
    held = outer.withColumn("piece", F.explode(_pieces("o_value")))
    begun = inner.withColumn("piece", F.substring("i_value", 1, PIECE))
    return held.join(begun, [*by, "piece"]).where(F.contains("o_value", F.col("i_value"))).select(*by, "o", "i").distinct()


def _choices(edges: DataFrame, mine: str, other: str) -> DataFrame:
    """Adds the rank of an edge among those of its node ``mine`` by the other
    side's first place, and the first place of the choice after the first."""
    w = Window.partitionBy("group", mine).orderBy(f"{other}_places")
    return edges.withColumns({f"{mine}_rank": F.row_number().over(w), f"{mine}_next": F.lead(F.get(f"{other}_places", F.lit(0))).over(w)})


def greedy(truths: DataFrame, findings: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of places: group, t_place, f_place.

    ``truths`` has group, t and t_places, ``findings`` group, f and f_places: nodes
    and their places, ascending; no place is in two nodes of a side. ``edges``
    (group, t, f) says which fit. A node without edges stays unmatched.
    """
    pairs, spark = [], edges.sparkSession
    edges = written(edges, "edges")
    while True:
        # A node's places are one array, so arrays compare by their first places.
        met = edges.join(truths, ["group", "t"]).join(findings, ["group", "f"]).where((F.size("t_places") > 0) & (F.size("f_places") > 0))
        best = _choices(_choices(met, "t", "f"), "f", "t").where("t_rank = 1 and f_rank = 1")
        upto = lambda places, bound: F.when(F.col(bound).isNull(), F.size(places)).otherwise(F.size(F.filter(places, lambda p: p < F.col(bound))))
        run = F.least(upto("t_places", "f_next"), upto("f_places", "t_next"))
        fresh = written(best.select("group", "t", "f", run.alias("n"), F.slice("t_places", 1, run).alias("t_run"), F.slice("f_places", 1, run).alias("f_run")), "matched")
        if fresh.isEmpty():
            break
        pairs.append(fresh.select("group", F.explode(F.arrays_zip("t_run", "f_run")).alias("p")).select("group", F.col("p.t_run").alias("t_place"), F.col("p.f_run").alias("f_place")))
        rest = lambda nodes, k: written(
            nodes.join(fresh.select("group", k, "n"), ["group", k], "left").select("group", k, F.slice(f"{k}_places", F.coalesce("n", F.lit(0)) + 1, F.size(f"{k}_places")).alias(f"{k}_places")).where(F.size(f"{k}_places") > 0), f"left-{k}"
        )
        truths, findings = rest(truths, "t"), rest(findings, "f")
        edges = written(edges.join(truths, ["group", "t"], "left_semi").join(findings, ["group", "f"], "left_semi"), "edges")
    if not pairs:
        return spark.createDataFrame([], f"group {edges.schema['group'].dataType.simpleString()}, t_place bigint, f_place bigint")
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out
