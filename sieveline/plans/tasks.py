"""Queries over tasks, pages and actions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import planning
from ..sources.tables import table
from .privacy import chosen, chosen_sql
from .registry import Registry

QUERIES = Registry()
_HTML = r"trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>', ' ', 'gi'), '<style[\s\S]*?</style>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


@QUERIES.add(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", planning.html_text(F.col("html")).alias("text"))


@QUERIES.add("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


_TAGS = {"a": "link", "h1": "heading", "nav": "navigation", "li": "listitem", "ul": "list", "article": "article", "footer": "contentinfo", "p": "paragraph", "main": "main", "header": "banner"}
_ROLE = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAGS.items()) + " ELSE 'generic' END"


@QUERIES.add(f"SELECT page_id, {_ROLE} AS role, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, role")
def role_inference(spark: SparkSession, folder: str) -> DataFrame:
    tags = pages(spark, folder).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    roles = F.create_map(*[F.lit(x) for item in _TAGS.items() for x in item])
    return tags.groupBy("page_id", F.coalesce(F.try_element_at(roles, F.col("tag")), F.lit("generic")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


_IS_SEARCH = " OR ".join(rf"regexp_matches(text, '(?i)\b{p}\b')" for p in planning.SEARCH)
_QUERY = "coalesce(" + ", ".join(rf"CASE WHEN regexp_extract(text, '(?i)\b{p}\s+(.+)', 1) <> '' THEN trim(regexp_extract(text, '(?i)\b{p}\s+(.+)', 1)) END" for p in planning.SEARCH) + ")"
_TASKS = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'please Search for ' || text WHEN turn % 3 = 1 THEN 'look  up ' || text ELSE text END AS text FROM conversations"


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    turn, text = F.col("turn") % 3, F.col("text")
    made = F.when(turn == 0, F.concat(F.lit("please Search for "), text)).when(turn == 1, F.concat(F.lit("look  up "), text)).otherwise(text)
    return table(spark, folder, "conversations").select("conv_id", "turn", made.alias("text"))


@QUERIES.add(f"SELECT conv_id, turn, ({_IS_SEARCH}) AS is_search, {_QUERY} AS query FROM ({_TASKS})")
def search_query_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).select("conv_id", "turn", planning.is_search(F.col("text")).alias("is_search"), planning.search_query(F.col("text")).alias("query"))


_GOAL = rf"""WITH p AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS title, lower(url) AS url, lower(regexp_extract(html, '<a href="/([^"]*)"', 1)) AS q FROM pages)
SELECT page_id, CASE WHEN q = '' THEN 'no-query-extracted' WHEN contains(url, q) THEN 'query-found-in-url' WHEN contains(trim(regexp_replace(title, '\s+', ' ', 'g')), q) THEN 'query-found-in-title' ELSE 'query-not-found' END AS reason FROM p"""


@QUERIES.add(_GOAL)
def goal_verification(spark: SparkSession, folder: str) -> DataFrame:
    p = pages(spark, folder).select("page_id", F.lower("url").alias("url"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.lower(F.regexp_extract("html", '<a href="/([^"]*)"', 1)).alias("q"))
    reason = F.when(F.col("q") == "", "no-query-extracted").when(F.contains("url", F.col("q")), "query-found-in-url").when(F.contains(planning.squeezed(F.col("title")), F.col("q")), "query-found-in-title").otherwise("query-not-found")
    return p.select("page_id", reason.alias("reason"))


_FLAGS = ("goal", "navigated", "confirmed", "attempted", "entered")
_FINISH = {"intent": ["search", "generic"], **{f: [True, False] for f in _FLAGS}}


@QUERIES.add(f"""SELECT *, CASE WHEN intent = 'generic' THEN 'allow' WHEN goal THEN 'allow' WHEN navigated OR confirmed THEN 'goal-not-satisfied' WHEN attempted OR entered THEN 'completion-not-established' ELSE 'allow no-text-entered' END AS verdict
 FROM (SELECT *, count(*) AS n FROM ({chosen_sql('events', 'event_id', _FINISH)}) GROUP BY ALL)""")
def finish_gate_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on finishing in every case that the events stand for."""
    out = chosen(table(spark, folder, "events"), "event_id", _FINISH).groupBy(*_FINISH).agg(F.count(F.lit(1)).alias("n"))
    verdict = (
        F.when(F.col("intent") == "generic", "allow").when(F.col("goal"), "allow").when(F.col("navigated") | F.col("confirmed"), "goal-not-satisfied")
        .when(F.col("attempted") | F.col("entered"), "completion-not-established").otherwise("allow no-text-entered")
    )
    return out.withColumn("verdict", verdict)


_BACKENDS = {"forced": ["auto", "wasm", "webgpu"], "browser": ["firefox", "chrome"], "gpu": [True, False], "wasm": [True, False]}


@QUERIES.add(f"""SELECT *, CASE WHEN forced = 'wasm' THEN 'wasm' WHEN forced = 'webgpu' THEN CASE WHEN gpu THEN 'webgpu' ELSE 'wasm' END
 WHEN browser = 'firefox' THEN CASE WHEN wasm THEN 'wasm' WHEN gpu THEN 'webgpu' ELSE 'cpu' END ELSE CASE WHEN gpu THEN 'webgpu' WHEN wasm THEN 'wasm' ELSE 'cpu' END END AS backend
 FROM (SELECT *, count(*) AS n FROM ({chosen_sql('events', 'event_id', _BACKENDS)}) GROUP BY ALL)""")
def backend_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The backend of every case that the events stand for."""
    out = chosen(table(spark, folder, "events"), "event_id", _BACKENDS).groupBy(*_BACKENDS).agg(F.count(F.lit(1)).alias("n"))
    gpu, wasm = F.col("gpu"), F.col("wasm")
    auto = F.when(F.col("browser") == "firefox", F.when(wasm, "wasm").when(gpu, "webgpu").otherwise("cpu")).otherwise(F.when(gpu, "webgpu").when(wasm, "wasm").otherwise("cpu"))
    return out.withColumn("backend", F.when(F.col("forced") == "wasm", "wasm").when(F.col("forced") == "webgpu", F.when(gpu, "webgpu").otherwise("wasm")).otherwise(auto))


def _keyword_sql(name: str) -> str:
    tests = [
        f"(t = '{k}' OR starts_with(t, '{k} ') OR starts_with(t, '{k}' || chr(9)) OR (strpos(t, '{k}') > 0 AND (strpos(t, '{k}') = 1 OR regexp_matches(substr(t, strpos(t, '{k}') - 1, 1), '\\s'))"
        f" AND (strpos(t, '{k}') + {len(k)} > length(t) OR regexp_matches(substr(t, strpos(t, '{k}') + {len(k)}, 1), '\\s'))))"
        for k in planning.KEYWORDS[name]
    ]
    return "(" + " OR ".join(tests) + f") AS {name}"


@QUERIES.add("SELECT event_id, " + ", ".join(_keyword_sql(k) for k in planning.KEYWORDS) + " FROM (SELECT event_id, lower(trim(event_type || CASE event_id % 5 WHEN 0 THEN ' now' WHEN 1 THEN ' and buy' WHEN 2 THEN 's resend' WHEN 3 THEN ' delete' ELSE ' send message' END)) AS t FROM events)")
def target_risk_flags(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (" now", " and buy", "s resend", " delete", " send message"))), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.lower(F.trim(F.concat("event_type", tail)))
    return table(spark, folder, "events").select("event_id", *[planning.names_keyword(text, words).alias(name) for name, words in planning.KEYWORDS.items()])


@QUERIES.add("SELECT kind, CASE WHEN kind IN ('scroll','focus','wait','request_observation','finish') THEN 'low' WHEN kind IN ('click','type_text','select') THEN 'medium' WHEN kind = 'type_token' THEN 'high' ELSE 'critical' END AS risk, count(*) AS n FROM (SELECT CASE event_id % 11 WHEN 0 THEN 'scroll' WHEN 1 THEN 'focus' WHEN 2 THEN 'wait' WHEN 3 THEN 'request_observation' WHEN 4 THEN 'finish' WHEN 5 THEN 'click' WHEN 6 THEN 'type_text' WHEN 7 THEN 'select' WHEN 8 THEN 'type_token' ELSE event_type END AS kind FROM events) GROUP BY 1, 2")
def action_risk(spark: SparkSession, folder: str) -> DataFrame:
    order = ("scroll", "focus", "wait", "request_observation", "finish", "click", "type_text", "select", "type_token")
    kinds = F.array(*map(F.lit, order))
    kind = F.coalesce(F.get(kinds, (F.col("event_id") % 11).cast("int")), F.col("event_type"))
    return table(spark, folder, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select("kind", planning.action_risk(F.col("kind")).alias("risk"), "n")


@QUERIES.add("SELECT page_id, (" + " OR ".join(f"regexp_matches(html, '{p}')" for p in planning.CODE) + ") AS code FROM pages")
def code_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", planning.has_code(F.col("html")).alias("code"))


@QUERIES.add("SELECT event_id, step, array_to_string(last5, ',') AS last5 FROM (SELECT event_id, row_number() OVER w AS step, list(event_type) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def last5_actions(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("event_id", F.row_number().over(w).cast("long").alias("step"), F.array_join(F.collect_list("event_type").over(w.rowsBetween(-4, 0)), ",").alias("last5"))


_READ = ["mail a.b@x.org", "call 555-123-4567", "4111 1111 1111 1111", "account: 123456", " Pay now ", "Sign in", "id 1234 5678 9012", "ABCDE1234F", "plain words"]
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {{'class': '{c}', 'label': {'trim(t)' if label is None else chr(39) + label + chr(39)}, 'confidence': {n}::DOUBLE}}" for p, c, label, n in planning.TEXT_KINDS) + " ELSE {'class': 'text', 'label': trim(left(t, 50)), 'confidence': 0.5::DOUBLE} END"
_CLASSES = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{c}'" for c, words in planning.REGION_CLASSES) + " ELSE 'unknown' END"
_NAMED = ["FaceBox", "barcode", "id card", "signature", "pay button", "payment", "label", "photo", "other"]


@QUERIES.add(f"""SELECT event_id, k.class AS class, k.label AS label, k.confidence AS confidence, {_CLASSES} AS region FROM (SELECT event_id, {_KINDS} AS k, low FROM (
 SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE {_READ}[event_id % 9 + 1] || ' ' || event_type END AS t, lower({_NAMED}[event_id % 9 + 1] || ' ' || event_type) AS low FROM events))""")
def text_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What read text is, and the class of a named region."""
    k = F.col("event_id")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % 9).cast("int"))
    e = table(spark, folder, "events").select("event_id", F.when(k % 4 == 0, F.col("event_type")).otherwise(F.concat_ws(" ", pick(_READ), "event_type")).alias("t"), F.concat_ws(" ", pick(_NAMED), "event_type").alias("named"))
    return e.withColumn("k", planning.text_kind(F.col("t"))).select("event_id", "k.class", "k.label", "k.confidence", planning.region_class(F.col("named")).alias("region"))
