"""Queries over events as sessions, grants and observations, with their SQL.

Events play the roles of grants, attempts, navigations and confirmations. Every
event makes a grant that lives five minutes and is bound in eight ways, and
tries one: that of half its number, with one binding wrong in eight cases of
eleven, some minutes after the grant was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quantiles
from ..sources.tables import table
from ..streaming import machine
from .registry import Registry

QUERIES = Registry()
#: Bindings of a grant in the order in which they are compared, and the errors.
BINDINGS = {"session": "SESSION_MISMATCH", "tab": "TAB_MISMATCH", "frame": "FRAME_MISMATCH", "origin": "ORIGIN_MISMATCH", "generation": "DOCUMENT_GENERATION_MISMATCH", "target": "TARGET_MISMATCH", "operation": "OPERATION_MISMATCH", "nonce": "NONCE_MISMATCH"}
_GRANTS = "g AS (SELECT event_id AS grant_id, user_id AS session, user_id % 4 AS tab, user_id % 2 AS frame, 'https://' || user_id AS origin, event_id // 64 AS generation, props AS target, event_type AS operation, event_id * 7 AS nonce, ts AS created_at, ts + INTERVAL 5 MINUTE AS expires_at FROM events)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def _grants(spark: SparkSession, folder: str) -> DataFrame:
    k, user = F.col("event_id"), F.col("user_id")
    return events(spark, folder).select(
        k.alias("grant_id"), user.alias("session"), (user % 4).alias("tab"), (user % 2).alias("frame"), F.concat(F.lit("https://"), user.cast("string")).alias("origin"), F.floor(k / 64).alias("generation"),
        F.col("props").alias("target"), F.col("event_type").alias("operation"), (k * 7).alias("nonce"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("expires_at"),
    )


_CASES = " ".join(f"WHEN wrong = {i} THEN '{error}'" for i, error in enumerate(BINDINGS.values(), 1))
_OUTCOME = f"""WITH {_GRANTS}, a AS (SELECT event_id AS attempt_id, event_id // 2 AS token, event_id % 11 AS wrong, event_id % 7 AS minutes FROM events),
e AS (SELECT attempt_id, grant_id, created_at + minutes * INTERVAL 1 MINUTE AS happened, CASE WHEN grant_id IS NULL THEN 'GRANT_NOT_FOUND' {_CASES} WHEN minutes > 5 THEN 'GRANT_EXPIRED' END AS error
  FROM a LEFT JOIN g ON token = grant_id)
SELECT attempt_id, coalesce(error, CASE WHEN row_number() OVER (PARTITION BY grant_id, error ORDER BY happened, attempt_id) = 1 THEN 'OK' ELSE 'GRANT_ALREADY_CONSUMED' END) AS outcome FROM e"""


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts with the bindings that they state: those of the grant, but one."""
    k = F.col("event_id")
    tries = events(spark, folder).select(k.alias("attempt_id"), F.floor(k / 2).alias("token"), (k % 11).alias("wrong"), (k % 7).alias("minutes"))
    stated = _grants(spark, folder).select(F.col("grant_id").alias("token"), *[F.col(c).alias(f"said_{c}") for c in BINDINGS], F.col("created_at").alias("said_at"))
    joined = tries.join(stated, "token", "left")
    off = {f"said_{c}": F.when(F.col("wrong") == i, F.concat(F.col(f"said_{c}").cast("string"), F.lit("9")).cast(joined.schema[f"said_{c}"].dataType)).otherwise(F.col(f"said_{c}")) for i, c in enumerate(BINDINGS, 1)}
    return joined.withColumns(off).withColumn("at", F.col("said_at") + F.make_dt_interval(mins=F.col("minutes").cast("int")))


@QUERIES.add(_OUTCOME)
def grant_redeem_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Of a grant's valid attempts the earliest succeeds; the others are told why."""
    joined = _attempts(spark, folder).join(_grants(spark, folder), F.col("token") == F.col("grant_id"), "left")
    error = F.when(F.col("grant_id").isNull(), "GRANT_NOT_FOUND")
    for c, text in BINDINGS.items():
        error = error.when(~F.col(c).eqNullSafe(F.col(f"said_{c}")), text)
    judged = joined.withColumn("error", error.when(F.col("expires_at") < F.col("at"), "GRANT_EXPIRED"))
    first = judged.where("error is null").groupBy("grant_id").agg(F.min(F.struct("at", "attempt_id")).alias("first")).withColumnRenamed("grant_id", "g")
    won = F.when(F.col("first.attempt_id") == F.col("attempt_id"), "OK").otherwise("GRANT_ALREADY_CONSUMED")
    return judged.join(first, F.col("grant_id") == F.col("g"), "left").select("attempt_id", F.coalesce("error", won).alias("outcome"))


@QUERIES.add(f"WITH {_GRANTS} SELECT session, count(*) AS total, count(CASE WHEN expires_at < TIMESTAMP '2024-01-02 00:00:00' THEN 1 END) AS expired FROM g GROUP BY session")
def grant_expiry_sweep(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return _grants(spark, folder).groupBy("session").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("expires_at") < now, 1)).alias("expired"))


@QUERIES.add(f"SELECT outcome, count(*) AS n FROM ({_OUTCOME}) GROUP BY outcome")
def vault_stats(spark: SparkSession, folder: str) -> DataFrame:
    return grant_redeem_outcomes(spark, folder).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND was <> event_type")
def navigation_lag(spark: SparkSession, folder: str) -> DataFrame:
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, folder).withColumn("was", was).where("was <> event_type").select("event_id", "user_id")


@QUERIES.add("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS steps, bool_or(event_type = 'purchase') AS confirmed FROM events GROUP BY user_id")
def session_state(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("steps"), F.bool_or(F.col("event_type") == "purchase").alias("confirmed"))


@QUERIES.add("SELECT event_type, min(event_id) AS first_id, count(*) AS seen FROM events GROUP BY event_type, user_id")
def observation_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("seen")).drop("user_id")


_NEXT = "SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts <= INTERVAL 60 SECOND AS ok FROM events"


@QUERIES.add(f"SELECT event_id, coalesce(ok, false) AS confirmed FROM ({_NEXT})")
def confirmation_timeout(spark: SparkSession, folder: str) -> DataFrame:
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, folder).select("event_id", F.coalesce(after <= F.col("ts") + F.expr("INTERVAL 60 SECONDS"), F.lit(False)).alias("confirmed"))


@QUERIES.add("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 10")
def continuation_cap(spark: SparkSession, folder: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, folder).withColumn("k", k).where("k <= 10").select("event_id")


@QUERIES.add("SELECT event_type AS stage, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles_ceil(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).withColumnRenamed("event_type", "stage")
    mean = rows.groupBy("stage").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return quantiles.ranked(rows, "stage", "value", {"p50": quantiles.nearest(0.5), "p95": quantiles.nearest(0.95)}).join(mean, "stage").select("stage", "p50", "p95", "mean", "n")


@QUERIES.add("SELECT stage, max(CASE WHEN k = CAST(floor(n * 0.5) AS BIGINT) + 1 THEN value END) AS p50, max(CASE WHEN k = CAST(floor(n * 0.95) AS BIGINT) + 1 THEN value END) AS p95 FROM (SELECT event_type AS stage, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY stage")
def latency_percentiles_floor(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).withColumnRenamed("event_type", "stage")
    return quantiles.ranked(rows, "stage", "value", {"p50": quantiles.at_floor(0.5), "p95": quantiles.at_floor(0.95)})


@QUERIES.add("""WITH p AS (SELECT d.doc_id, l.quality, (length(text) >= 400 AND NOT regexp_matches(text, '[#*$%&|<>]')) AS flagged FROM documents d JOIN labels l USING (doc_id)),
 c AS (SELECT count(CASE WHEN flagged AND quality = 1 THEN 1 END) AS tp, count(CASE WHEN flagged AND quality = 0 THEN 1 END) AS fp, count(CASE WHEN NOT flagged AND quality = 1 THEN 1 END) AS fn FROM p)
 SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def precision_recall_labels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", ((F.length("text") >= 400) & ~F.col("text").rlike("[#*$%&|<>]")).alias("flagged"))
    p = docs.join(table(spark, folder, "labels"), "doc_id")
    n = lambda flag, good: F.count(F.when((F.col("flagged") == flag) & (F.col("quality") == good), 1))
    c = p.agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@QUERIES.add("""WITH m AS (SELECT event_type AS model, CASE WHEN event_id % 3 = 0 THEN 'wasm' ELSE 'webgpu' END AS backend, event_id, ts, value, event_id % 50 = 0 AS cold FROM events)
 SELECT model, backend, count(*) AS n, sum(event_id % 1000) AS pixels, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean, min_by(value, (ts, event_id)) FILTER (WHERE cold) AS first_cold, round(avg(CASE WHEN NOT cold THEN value END), 6) AS warm_mean, max(value) AS peak FROM m GROUP BY model, backend""")
def model_metrics_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    m = events(spark, folder).select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 3 == 0, "wasm").otherwise("webgpu").alias("backend"), "event_id", "ts", "value", (F.col("event_id") % 50 == 0).alias("cold"))
    return m.groupBy("model", "backend").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 1000).alias("pixels"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("mean"),
        F.min(F.when(F.col("cold"), F.struct("ts", "event_id", "value")))["value"].alias("first_cold"), F.round(F.avg(F.when(~F.col("cold"), F.col("value"))), 6).alias("warm_mean"), F.max("value").alias("peak"),
    )


#: What an event's type makes of it; a confirmation is waited for two days here.
_KINDS = {"signup": "start", "error": "pause", "view": "resume", "purchase": "ask"}
TWO_DAYS = 172_800_000


def machine_events(rows: DataFrame) -> DataFrame:
    """Events as the session machine reads them."""
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "result").otherwise("answer")
    for name, what in _KINDS.items():
        kind = F.when(F.col("event_type") == name, what).otherwise(kind)
    return rows.select(F.col("user_id").alias("tab"), kind.alias("kind"), k.alias("event_id"), "ts", (k % 5).alias("action"), (k % 4).alias("session"))


@QUERIES.add(f"""WITH RECURSIVE e AS (SELECT user_id AS tab, event_id AS k, epoch_ms(ts) AS t, event_id % 5 AS a, event_id % 4 AS s, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items())} ELSE CASE WHEN event_id % 3 = 0 THEN 'result' ELSE 'answer' END END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
m(tab, n, ses, st, w, o) AS (
  SELECT DISTINCT tab, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'none', [{{'k': NULL::BIGINT, 's': NULL::BIGINT, 'd': NULL::BIGINT}} FOR i IN range(5)], [{{'k': NULL::BIGINT, 'o': NULL::VARCHAR}}] FROM e
  UNION ALL
  SELECT x.tab, x.n, CASE WHEN kind = 'start' THEN ses + 1 ELSE ses END, CASE WHEN kind = 'start' THEN 'active' WHEN kind = 'pause' AND st = 'active' THEN 'paused' WHEN kind = 'resume' AND st = 'paused' THEN 'active' ELSE st END,
    [CASE WHEN i <> a THEN l[i + 1] WHEN kind = 'ask' AND st <> 'none' AND l[i + 1].k IS NULL THEN {{'k': k, 's': ses, 'd': t + {TWO_DAYS}}} WHEN kind = 'answer' THEN {{'k': NULL::BIGINT, 's': NULL::BIGINT, 'd': NULL::BIGINT}} ELSE l[i + 1] END FOR i IN range(5)],
    list_concat([{{'k': v.k, 'o': 'timeout'}} FOR v IN w IF v.d < t], [CASE WHEN kind = 'pause' THEN {{'k': k, 'o': CASE WHEN st = 'active' THEN 'paused' ELSE 'ignored' END}} WHEN kind = 'resume' THEN {{'k': k, 'o': CASE WHEN st = 'paused' THEN 'resumed' ELSE 'ignored' END}}
      WHEN kind = 'result' THEN {{'k': k, 'o': CASE WHEN st = 'active' AND ses = s THEN 'accepted' ELSE 'late' END}} WHEN kind = 'ask' AND st = 'none' THEN {{'k': k, 'o': 'rejected'}} WHEN kind = 'ask' AND l[a + 1].k IS NOT NULL THEN {{'k': k, 'o': 'duplicate'}}
      WHEN kind = 'answer' AND l[a + 1].k IS NOT NULL THEN {{'k': l[a + 1].k, 'o': CASE WHEN l[a + 1].s = ses THEN 'confirmed' ELSE 'stale' END}} END])
  FROM (SELECT e.*, ses, st, w, [CASE WHEN v.d < t THEN {{'k': NULL::BIGINT, 's': NULL::BIGINT, 'd': NULL::BIGINT}} ELSE v END FOR v IN w] AS l FROM m JOIN e ON m.tab = e.tab AND e.n = m.n + 1) x)
SELECT o.k AS event_id, tab, o.o AS outcome FROM (SELECT tab, unnest(o) AS o FROM m UNION ALL SELECT tab, unnest([{{'k': v.k, 'o': 'timeout'}} FOR v IN w]) FROM (SELECT * FROM m QUALIFY n = max(n) OVER (PARTITION BY tab))) WHERE o.k IS NOT NULL""")
def session_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of pauses, results and confirmations; the stream gives the same."""
    return machine.outcomes_of_table(machine_events(events(spark, folder)), TWO_DAYS)
