"""Queries that hold detections against ground truth, with their SQL.

Truth is what plain forms find in a document, apart from the detectors' own
patterns. A truth and a detection fit if their kinds do (card and account numbers
count as one kind) and one value, without case, blanks and dashes, holds the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, matching
from ..sources.tables import dealt, table, written
from . import twins
from .registry import Registry

QUERIES = Registry()
#: Plain forms by category, in the order in which they are taken.
TRUTH = {"email": "[a-z0-9.]+@[a-z0-9.]+", "phone": "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "credit-card": "[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{16}"}
_KIND = "CASE WHEN category IN ('account-number', 'credit-card') THEN 'number' ELSE category END"
_VALUE = r"regexp_replace(lower({}), '[\s-]', '', 'g')"
_TRUE = " UNION ALL ".join(f"SELECT key, {c} AS c, '{k}' AS category, unnest(regexp_extract_all(text, '{v}')) AS v, unnest(range(len(regexp_extract_all(text, '{v}')))) AS i FROM base" for c, (k, v) in enumerate(TRUTH.items()))
#: Truths tr (key, g, category, kind, v), findings fo (key, d, category, kind, v)
#: and pairs pa (key, g, d) by a fold of the ordered edges of a document.
_MATCHED = (
    twins.detections_sql(twins.DOCUMENTS)
    + f""", tr AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY c, i) - 1 AS g, category, {_KIND} AS kind, {_VALUE.format('v')} AS v FROM ({_TRUE})),
fo AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_off) - 1 AS d, category, {_KIND} AS kind, {_VALUE.format('matched')} AS v, start_off FROM det),
ed AS (SELECT tr.key, g, d FROM tr JOIN fo ON tr.key = fo.key AND tr.kind = fo.kind AND (contains(tr.v, fo.v) OR contains(fo.v, tr.v))),
fd AS (SELECT key, list({{'g': g, 'd': d}} ORDER BY g, d) AS l FROM ed GROUP BY key),
pa AS (SELECT key, p.g AS g, p.d AS d FROM (SELECT key, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda q: q.g = x[1].g OR q.d = x[1].d)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS p FROM fd))"""
)
_COUNTS = f"""{_MATCHED}, t AS (SELECT category, count(*) AS n_true, count(pa.g) AS tp FROM tr LEFT JOIN pa USING (key, g) GROUP BY category),
f AS (SELECT category, count(*) AS n_found, count(*) - count(pa.d) AS fp FROM fo LEFT JOIN pa USING (key, d) GROUP BY category)"""


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Truths (key, place, category, kind, value) and findings (the same, start)."""
    docs = dealt(table(spark, folder, "documents")).select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    value = lambda c: F.regexp_replace(F.lower(c), r"[\s-]", "")
    kind = F.when(F.col("category").isin("account-number", "credit-card"), "number").otherwise(F.col("category"))
    named = lambda k: lambda m: F.struct(F.lit(k).alias("category"), m.alias("value"))
    each = [F.transform(F.regexp_extract_all("text", F.lit(v), F.lit(0)), named(k)) for k, v in TRUTH.items()]
    truths = docs.select("key", F.posexplode(F.flatten(F.array(*each))).alias("place", "m")).select("key", F.col("place").cast("bigint"), "m.category", value("m.value").alias("value"))
    numbered = lambda d, i: F.struct(i.cast("bigint").alias("place"), d["category"].alias("category"), d["matched"].alias("value"), d["start"].alias("start"))
    found = detectors.with_detections(docs).select("key", F.explode(F.transform("detections", numbered)).alias("m"))
    findings = found.select("key", "m.place", "m.category", value("m.value").alias("value"), "m.start")
    return tuple(written(df.withColumn("kind", kind), "entities") for df in (truths, findings))


def _matched(truths: DataFrame, findings: DataFrame) -> DataFrame:
    """group (the document), t_place, f_place."""
    node = lambda df, k: df.groupBy(F.col("key").alias("group"), "kind", "value").agg(F.sort_array(F.collect_list("place")).alias(f"{k}_places")).withColumn(k, F.struct("kind", "value"))
    t, f = written(node(truths, "t"), "truths"), written(node(findings, "f"), "findings")
    left = t.select("group", "kind", F.col("t").alias("o"), F.col("value").alias("o_value"))
    right = f.select("group", "kind", F.col("f").alias("i"), F.col("value").alias("i_value"))
    swap = lambda df, a, b: df.select("group", "kind", F.col(a).alias(b), F.col(f"{a}_value").alias(f"{b}_value"))
    held = matching.containments(left, right, ["group", "kind"]).select("group", F.col("o").alias("t"), F.col("i").alias("f"))
    holds = matching.containments(swap(right, "i", "o"), swap(left, "o", "i"), ["group", "kind"]).select("group", F.col("i").alias("t"), F.col("o").alias("f"))
    return matching.greedy(t.select("group", "t", "t_places"), f.select("group", "f", "f_places"), held.unionByName(holds).distinct())


@QUERIES.add(f"{_MATCHED} SELECT pa.key, tr.category AS category, fo.category AS found_as, tr.v AS value, start_off FROM pa JOIN tr USING (key, g) JOIN fo USING (key, d)")
def matched_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every truth that got a detection, and where it was found."""
    truths, findings = _sides(spark, folder)
    pairs = _matched(truths, findings)
    t = truths.select(F.col("key").alias("group"), F.col("place").alias("t_place"), "category", "value")
    f = findings.select(F.col("key").alias("group"), F.col("place").alias("f_place"), F.col("category").alias("found_as"), F.col("start").alias("start_off"))
    return pairs.join(t, ["group", "t_place"]).join(f, ["group", "f_place"]).select(F.col("group").alias("key"), "category", "found_as", "value", "start_off")


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    """category, n_true, n_found, tp, fp, fn; a pair counts for the truth's category."""
    truths, findings = _sides(spark, folder)
    pairs = written(_matched(truths, findings), "pairs")
    marked = lambda df, k: df.join(pairs.select(F.col("group").alias("key"), F.col(f"{k}_place").alias("place"), F.lit(1).alias("hit")), ["key", "place"], "left")
    t = marked(truths, "t").groupBy("category").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("tp"))
    f = marked(findings, "f").groupBy("category").agg(F.count(F.lit(1)).alias("n_found"), (F.count(F.lit(1)) - F.count("hit")).alias("fp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(f, "category", "full").select("category", *map(zero, ("n_true", "n_found", "tp", "fp")), (F.coalesce("n_true", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fn"))


@QUERIES.add(f"""{_COUNTS} SELECT coalesce(t.category, f.category) AS category, coalesce(n_true, 0) AS n_true, coalesce(n_found, 0) AS n_found, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
 coalesce(n_true, 0) - coalesce(tp, 0) AS fn FROM t FULL JOIN f ON t.category = f.category""")
def gt_vs_detected_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


@QUERIES.add(f"""{_COUNTS}, s AS (SELECT CAST(coalesce((SELECT sum(tp) FROM t), 0) AS BIGINT) AS tp, CAST(coalesce((SELECT sum(fp) FROM f), 0) AS BIGINT) AS fp, CAST(coalesce((SELECT sum(n_true - tp) FROM t), 0) AS BIGINT) AS fn)
 SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s""")
def entity_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    c = _counts(spark, folder).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("tp", "fp", "fn")])
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
