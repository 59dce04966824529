"""Queries over points, blocks and areas of scenes, with their SQL.

Boxes are made from keys of the part table as in the layout queries; every box of a
hundredth key lies over the whole scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, boxes
from ..sources.tables import table
from .layout import NODE, PARTS, REGION, _made, _made_sql
from .registry import Registry

QUERIES = Registry()
WIDTH, HEIGHT = 1200, 800
#: Shares of a box at which it is hit: its centre and the middles of its quarters.
POINTS = ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75))
ROLES = ("button", "link", "textbox", "img", "generic")


def _stacked(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes with height, opacity and role; every hundredth one is an overlay."""
    k, wide = F.col("b_id"), F.col("b_id") % 100 == 50
    made = _made(spark, folder, "b", NODE)
    return made.select(
        "scene", "b_id", F.when(wide, 0.0).otherwise(F.col("b_x")).alias("b_x"), F.when(wide, 0.0).otherwise(F.col("b_y")).alias("b_y"),
        F.when(wide, float(WIDTH)).otherwise(F.col("b_w")).alias("b_w"), F.when(wide, float(HEIGHT)).otherwise(F.col("b_h")).alias("b_h"),
        F.when(wide, 90 + k % 200).otherwise((k * 29) % 100).alias("z"), F.when(wide, 0.05).otherwise(1.0).alias("opacity"), F.get(F.array(*map(F.lit, ROLES)), (k % 5).cast("int")).alias("role"),
    )


_OVERLAY = f"(b_w >= {WIDTH} * 0.8 AND b_h >= {HEIGHT} * 0.8 AND opacity < 0.1 AND z > 100)"
_HITS = f"""WITH m AS ({_made_sql('b', NODE)}),
b AS (SELECT scene, b_id, CASE WHEN b_id % 100 = 50 THEN 0 ELSE b_x END AS b_x, CASE WHEN b_id % 100 = 50 THEN 0 ELSE b_y END AS b_y, CASE WHEN b_id % 100 = 50 THEN {WIDTH} ELSE b_w END AS b_w, CASE WHEN b_id % 100 = 50 THEN {HEIGHT} ELSE b_h END AS b_h,
  CASE WHEN b_id % 100 = 50 THEN 90 + b_id % 200 ELSE (b_id * 29) % 100 END AS z, CASE WHEN b_id % 100 = 50 THEN 0.05 ELSE 1 END AS opacity, {list(ROLES)}[b_id % 5 + 1] AS role FROM m),
p AS (SELECT scene, b_id AS node, n, b_x + b_w * fx AS px, b_y + b_h * fy AS py, b_x AS x, b_y AS y, b_w AS w, b_h AS h FROM b, (VALUES {', '.join(f'({n}, {x}, {y})' for n, (x, y) in enumerate(POINTS))}) s(n, fx, fy)),
h AS (SELECT p.*, b.b_id, b.role, b_x, b_y, b_w, b_h, {_OVERLAY} AS overlay, row_number() OVER (PARTITION BY node, n ORDER BY z DESC NULLS LAST, b.b_id DESC) AS r
  FROM p LEFT JOIN b ON p.scene = b.scene AND px >= b_x AND px < b_x + b_w AND py >= b_y AND py < b_y + b_h AND px < {WIDTH} AND py < {HEIGHT}),
t AS (SELECT *, abs(b_x - x) < 5 AND abs(b_y - y) < 5 AND abs(b_w - w) < 5 AND abs(b_h - h) < 5 AS same FROM h WHERE r = 1)"""


@QUERIES.add(f"""{_HITS} SELECT scene, node, max(CASE WHEN n = 0 THEN b_id END) AS hit, coalesce(bool_or(n = 0 AND same), false) AS topmost,
 max(CASE WHEN n = 0 THEN CASE WHEN b_id IS NULL THEN 'No element at target point' WHEN same THEN NULL WHEN overlay THEN 'Transparent overlay intercepting target' ELSE 'Different element at point: ' || role END END) AS issue,
 coalesce(string_agg(DISTINCT role, ' ' ORDER BY role), '') AS hit_roles, coalesce(bool_or(overlay), false) AS overlay FROM t GROUP BY scene, node""")
def hit_tests(spark: SparkSession, folder: str) -> DataFrame:
    """What lies uppermost at the centre of every box and at four points more."""
    b = _stacked(spark, folder)
    share = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("fx"), F.lit(y).alias("fy")) for n, (x, y) in enumerate(POINTS)])
    points = b.withColumn("s", F.explode(share)).select(
        "scene", F.col("b_id").alias("node"), F.col("s.n").alias("n"), (F.col("b_x") + F.col("b_w") * F.col("s.fx")).alias("px"), (F.col("b_y") + F.col("b_h") * F.col("s.fy")).alias("py"),
        F.struct("b_x", "b_y", "b_w", "b_h").alias("own"),
    )
    hit = boxes.stabbed(points, b.where(f"b_x < {WIDTH} and b_y < {HEIGHT}"))
    hit = hit.withColumn("top", F.when((F.col("px") < WIDTH) & (F.col("py") < HEIGHT), F.col("top")))
    overlay = (F.col("top.b_w") >= WIDTH * 0.8) & (F.col("top.b_h") >= HEIGHT * 0.8) & (F.col("top.opacity") < 0.1) & (F.col("top.z") > 100)
    same = F.greatest(*[F.abs(F.col(f"top.b_{c}") - F.col(f"own.b_{c}")) for c in "xywh"]) < 5
    centre = F.col("n") == 0
    issue = F.when(F.col("top").isNull(), "No element at target point").when(same, None).when(overlay, "Transparent overlay intercepting target").otherwise(F.concat(F.lit("Different element at point: "), "top.role"))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return hit.groupBy("scene", "node").agg(
        F.max(F.when(centre, F.col("top.b_id"))).alias("hit"), yes(centre & same).alias("topmost"), F.max(F.when(centre, issue)).alias("issue"),
        F.array_join(F.array_sort(F.collect_set("top.role")), " ").alias("hit_roles"), yes(overlay).alias("overlay"),
    )


BLOCK, MERGE_X, MERGE_Y = 40, 120, 60
_SEEDS = f"""WITH b AS ({_made_sql('b', REGION)}),
l AS (SELECT scene, list({{'i': b_id, 'x': b_x, 'y': b_y}} ORDER BY b_id) AS l FROM b GROUP BY scene),
s AS (SELECT scene, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda p: abs(p.x - x[1].x) <= {MERGE_X} AND abs(p.y - x[1].y) <= {MERGE_Y})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS s FROM l),
g AS (SELECT b.scene, b.b_id, b_x, b_y, score, min(s.i) AS seed FROM b JOIN s ON b.scene = s.scene AND s.i <= b.b_id AND abs(s.x - b_x) <= {MERGE_X} AND abs(s.y - b_y) <= {MERGE_Y} GROUP BY ALL)"""


@QUERIES.add(f"""{_SEEDS} SELECT * FROM (SELECT scene, seed, min(b_x) AS x, min(b_y) AS y, least(max(b_x) + {BLOCK} - min(b_x), {WIDTH} - min(b_x)) AS w, least(max(b_y) + {BLOCK} - min(b_y), {HEIGHT} - min(b_y)) AS h, count(*) AS n, round(avg(score), 6) AS score
 FROM g GROUP BY scene, seed) WHERE w >= 20 AND h >= 8""")
def merged_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Union boxes of blocks that a seed reaches."""
    b = _made(spark, folder, "b", REGION).select("scene", F.col("b_id").alias("i"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), "score")
    groups = b.join(boxes.seeded_groups(b, MERGE_X, MERGE_Y).hint("merge"), ["scene", "i"]).groupBy("scene", "seed")
    x, y = F.min("x"), F.min("y")
    out = groups.agg(
        x.alias("x"), y.alias("y"), F.least(F.max("x") + BLOCK - x, WIDTH - x).alias("w"), F.least(F.max("y") + BLOCK - y, HEIGHT - y).alias("h"), F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score")
    )
    return out.where("w >= 20 and h >= 8")


@QUERIES.add(f"""WITH r AS ({_made_sql('r', REGION)}), c AS (SELECT scene, greatest(r_x, 0) AS x0, greatest(r_y, 0) AS y0, least(r_x + r_w, {WIDTH}) AS x1, least(r_y + r_h, {HEIGHT}) AS y1 FROM r),
 px AS (SELECT DISTINCT scene, x, y FROM (SELECT scene, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS x, y0, y1 FROM c), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y)),
 u AS (SELECT scene, CAST(count(*) AS DOUBLE) AS united FROM px GROUP BY scene), s AS (SELECT scene, sum((x1 - x0) * (y1 - y0)) AS summed FROM c WHERE x1 > x0 AND y1 > y0 GROUP BY scene)
 SELECT scene, summed, united, round(summed / {WIDTH * HEIGHT} * 100, 6) AS covered_percent, round(united / {WIDTH * HEIGHT} * 100, 6) AS masked_percent FROM s JOIN u USING (scene)""")
def redacted_area(spark: SparkSession, folder: str) -> DataFrame:
    """Area of a scene's regions, overlaps counted twice and once."""
    a = boxes.areas(_made(spark, folder, "r", REGION).select("scene", "r_x", "r_y", "r_w", "r_h"), WIDTH, HEIGHT)
    share = lambda c: F.round(F.col(c) / (WIDTH * HEIGHT) * 100, 6)
    return a.select("scene", "summed", "united", share("summed").alias("covered_percent"), share("united").alias("masked_percent"))


_PX = "SELECT DISTINCT scene, x, y FROM (SELECT scene, unnest(range(CAST(greatest({p}_x, 0) AS BIGINT), CAST(least({p}_x + {p}_w, 1200) AS BIGINT))) AS x, greatest({p}_y, 0) AS y0, least({p}_y + {p}_h, 800) AS y1 FROM {p}), LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y)"


@QUERIES.add(f"""WITH r AS ({_made_sql('r', REGION)}), n AS ({_made_sql('n', NODE)}), a AS ({_PX.format(p='r')}), b AS ({_PX.format(p='n')}),
c AS (SELECT coalesce(a.scene, b.scene) AS scene, count(a.x) AS planned, count(b.x) AS truth, count(CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN 1 END) AS both_ FROM a FULL JOIN b ON a.scene = b.scene AND a.x = b.x AND a.y = b.y GROUP BY 1)
SELECT scene, round(both_ / (planned + truth - both_), 6) AS iou, round((planned - both_) / {WIDTH * HEIGHT}, 6) AS over, round((truth - both_) / {WIDTH * HEIGHT}, 6) AS under_, round(({WIDTH * HEIGHT} - truth - (planned - both_)) / greatest(1, {WIDTH * HEIGHT} - truth), 6) AS utility FROM c""")
def mask_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Planned masks against true ones: shares of pixels by the areas of both and of
    their union."""
    side = lambda p, m: _made(spark, folder, p, m).select("scene", *[F.col(f"{p}_{c}").alias(f"r_{c}") for c in "xywh"])
    planned, truth = side("r", REGION), side("n", NODE)
    area = lambda df, name: boxes.areas(df, WIDTH, HEIGHT).select("scene", F.col("united").alias(name))
    a = area(planned, "p").join(area(truth, "t"), "scene", "full").join(area(planned.unionByName(truth), "u"), "scene")
    p, t = F.coalesce("p", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    both, whole = p + t - F.col("u"), float(WIDTH * HEIGHT)
    return a.select("scene", F.round(both / F.col("u"), 6).alias("iou"), F.round((p - both) / whole, 6).alias("over"), F.round((t - both) / whole, 6).alias("under_"), F.round((whole - t - (p - both)) / F.greatest(F.lit(1.0), whole - t), 6).alias("utility"))


@QUERIES.add(f"""WITH r AS ({_made_sql('r', REGION)}) SELECT scene, r_id, CASE r_id % 3 WHEN 0 THEN 'FACE_' WHEN 1 THEN 'PII_' ELSE 'QR_' END || lpad(CAST(row_number() OVER (PARTITION BY scene, r_id % 3 ORDER BY r_id) AS VARCHAR), CAST(greatest(2, length(CAST(row_number() OVER (PARTITION BY scene, r_id % 3 ORDER BY r_id) AS VARCHAR))) AS INTEGER), '0') AS token,
 CASE r_id % 3 WHEN 0 THEN 'biometric' WHEN 1 THEN 'text-pii' ELSE 'credential' END AS category FROM r""")
def redaction_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Faces, texts and codes of a scene numbered by kind."""
    r = _made(spark, folder, "r", REGION).select("scene", "r_id")
    kind = (F.col("r_id") % 3).cast("int")
    k = F.row_number().over(Window.partitionBy("scene", kind).orderBy("r_id")).cast("string")
    name = lambda values: F.get(F.array(*map(F.lit, values)), kind)
    return r.select("scene", "r_id", F.concat(name(("FACE_", "PII_", "QR_")), F.when(F.length(k) < 2, F.lpad(k, 2, "0")).otherwise(k)).alias("token"), name(("biometric", "text-pii", "credential")).alias("category"))


#: Events are observations of a target (every third) or actions on one.
_FRESH = """WITH e AS (SELECT event_id AS k, user_id, ts, 'n' || (event_id % 12) AS target, event_id % 3 = 0 AS seen, ['click','focus','scroll','type_text','wait'][event_id % 5 + 1] AS kind, event_type FROM events),
a AS (SELECT k, user_id, ts, target, kind, CASE WHEN k % 19 = 1 THEN 'o0' ELSE 'o1' END AS plan, CASE WHEN k % 23 = 1 THEN '' ELSE 's' || user_id END AS session, 'g' || (k // 5000) AS gen, event_type AS name, CASE WHEN k % 29 = 1 THEN 2 ELSE 1 END AS frame, k % 9 AS x FROM e WHERE NOT seen),
o AS (SELECT k AS ok, user_id, ts, target, 'g' || (k // 5000) AS gen, CASE WHEN k % 2 = 0 THEN event_type ELSE 'click' END AS name, k % 9 AS x FROM e WHERE seen),
f AS (SELECT a.*, o.ok, o.gen AS ogen, o.name AS oname, o.x AS ox, row_number() OVER (PARTITION BY a.k ORDER BY o.ts DESC, o.ok DESC) AS r FROM a LEFT JOIN o ON a.user_id = o.user_id AND a.target = o.target AND (o.ts < a.ts OR (o.ts = a.ts AND o.ok < a.k)))
SELECT k AS action_id, ok AS seen_in, CASE WHEN plan = 'o0' THEN 'Stale observation: plan from o0, current o1' WHEN session = '' THEN 'Missing session binding' WHEN kind IN ('click', 'focus', 'type_text') THEN CASE
  WHEN ok IS NULL THEN 'Missing target fingerprint for ' || target WHEN ogen <> gen THEN 'Document generation changed since observation' WHEN frame = 2 THEN 'Target stale: frameId mismatch: expected 1, got 2'
  WHEN oname <> name THEN 'Target stale: accessible name changed: expected "' || oname || '", got "' || name || '"' WHEN abs(ox - x) > 5 THEN 'Target stale: bounding box moved materially' END END AS error FROM f WHERE r = 1"""


@QUERIES.add(_FRESH)
def stale_actions(spark: SparkSession, folder: str) -> DataFrame:
    """The first binding that fails for every action, against the last observation
    of its target before it."""
    k = F.col("event_id")
    e = table(spark, folder, "events").withColumn("target", F.concat(F.lit("n"), (k % 12).cast("string")))
    kinds = F.array(*map(F.lit, ("click", "focus", "scroll", "type_text", "wait")))
    generation = F.concat(F.lit("g"), F.floor(k / 5000).cast("string"))
    state = lambda name, frame: F.struct(generation.alias("generation"), frame.alias("frame"), F.lit("button").alias("role"), name.alias("name"), F.lit("html>body").alias("ancestry"), (k % 9).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"))
    actions = e.where(k % 3 != 0).select(
        "user_id", "target", "ts", k.alias("k"), F.get(kinds, (k % 5).cast("int")).alias("kind"), F.when(k % 19 == 1, "o0").otherwise("o1").alias("plan_observation"), F.lit("o1").alias("observation"),
        F.when(k % 23 == 1, "").otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session"), generation.alias("generation"), state(F.col("event_type"), F.when(k % 29 == 1, 2).otherwise(1)).alias("now"),
    )
    name = F.when(k % 2 == 0, F.col("event_type")).otherwise("click")
    observed = e.where(k % 3 == 0).select("user_id", "target", "ts", k.alias("k"), state(name, F.lit(1)).alias("state"))
    found = asof.last_before(actions, observed, ["user_id", "target"], "ts", "k").withColumn("seen", F.col("found.state"))
    return found.select(F.col("k").alias("action_id"), F.col("found.k").alias("seen_in"), asof.staleness().alias("error"))
