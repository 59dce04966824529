"""Queries over answers of a planner and over tensors, with their SQL.

Turns of conversations are wrapped as answers in several shapes, with something
behind the JSON or not, by the same rule on both sides; vectors are tensors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, responses, tensors
from ..sources.tables import table
from .registry import Registry

QUERIES = Registry()


def _quoted(c):  # noqa: ANN001, ANN202
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


_BODY = """c AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS m, (conv_id * 3 + turn) % 9 AS f, coalesce(text, '') AS text, '{"actions":[{"kind":"click","reason":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}],"note":"a}b\\""}' AS body FROM conversations),
w AS (SELECT *, CASE m WHEN 0 THEN body WHEN 1 THEN body || '  ' || chr(10) WHEN 2 THEN body || ' {"second":[1]}' WHEN 3 THEN body || chr(10) || 'Thanks.' WHEN 4 THEN body || ' ]}' WHEN 5 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE text END AS raw FROM c)"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    t = table(spark, folder, "conversations").select("conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 7).alias("m"), ((F.col("conv_id") * 3 + F.col("turn")) % 9).alias("f"), text.alias("text"))
    body = F.concat(F.lit('{"actions":[{"kind":"click","reason":'), _quoted(F.col("text")), F.lit('}],"note":"a}b\\""}'))
    m, add = F.col("m"), lambda tail: F.concat("body", F.lit(tail))
    raw = F.when(m == 0, F.col("body")).when(m == 1, add("  \n")).when(m == 2, add(' {"second":[1]}')).when(m == 3, add("\nThanks.")).when(m == 4, add(" ]}")).when(m == 5, F.concat(F.lit("```json\n"), "body", F.lit("\n```"))).otherwise(F.col("text"))
    return t.withColumn("body", body).withColumn("raw", raw)


_END = "list_filter([p FOR p IN range(1, length({0}) + 1) IF {0}[p] IN ('}}', ']')], lambda p: json_valid(left({0}, p)))[1]"
_CASES = """CASE WHEN e IS NULL THEN NULL WHEN rest = '' THEN 'none' WHEN bare = '' THEN 'whitespace_only' WHEN starts_with(bare, '{') AND len(list_filter([p FOR p IN range(1, length(bare) + 1) IF bare[p] = '}'], lambda p: json_valid(left(bare, p)))) > 0 THEN 'second_json_value'
 WHEN regexp_matches(bare, '^\\pL') THEN 'trailing_prose_or_text' ELSE 'malformed_trailing_data' END"""


@QUERIES.add(f"""WITH {_BODY}, x AS (SELECT *, CASE WHEN starts_with(raw, '{{') THEN {_END.format('raw')} END AS e FROM w), y AS (SELECT *, substr(raw, e + 1) AS rest, ltrim(substr(raw, e + 1), E' \\t\\n\\r') AS bare FROM x)
SELECT conv_id, turn, CAST(e AS INTEGER) AS first_end, {_CASES} AS category, sha256(CASE m WHEN 5 THEN body ELSE trim(raw, E' \\t\\n\\r\\f\\x0b') END) AS normal_sha256 FROM y""")
def trailing_json(spark: SparkSession, folder: str) -> DataFrame:
    """Where an answer's JSON ends, what follows it, and its text without fences."""
    a = _answers(spark, folder).withColumn("e", responses.first_json(F.col("raw")))
    return a.select("conv_id", "turn", F.col("e").alias("first_end"), responses.trailing(F.col("raw"), F.col("e")).alias("category"), F.sha2(responses.unfenced(F.col("raw")), 256).alias("normal_sha256"))


@QUERIES.add(f"""WITH {_BODY} SELECT conv_id, turn, CASE f WHEN 0 THEN 'string' WHEN 1 THEN 'text_parts[]' WHEN 2 THEN 'string_parts[]' WHEN 3 THEN 'mixed_parts[]' END AS shape,
 CASE WHEN f IN (0, 1, 3) THEN sha256(raw) WHEN f = 2 THEN sha256(raw || '!') END AS text_sha256,
 CASE f WHEN 4 THEN 'message content is null' WHEN 5 THEN 'message content is empty array' WHEN 6 THEN 'content array contains no text-bearing elements' WHEN 7 THEN 'no choices in provider response' WHEN 8 THEN 'unsupported content type' END AS error, CASE WHEN f > 3 THEN 502 END AS status FROM w""")
def response_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Shape and text of an answer's content, or why there is none."""
    a, q = _answers(spark, folder).withColumn("q", _quoted(F.col("raw"))), F.col("q")
    image = '{"type":"image_url","image_url":"x"}'
    forms = [q, F.concat(F.lit('[{"type":"text","text":'), q, F.lit("}," + image + "]")), F.concat(F.lit("["), q, F.lit(',"!"]')), F.concat(F.lit("[" + image + ","), q, F.lit("]")), F.lit("null"), F.lit("[]"), F.lit("[" + image + "]"), None, F.lit("7")]
    content = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        if form is not None:
            content = F.when(F.col("f") == i, F.concat(F.lit('{"choices":[{"message":{"content":'), form, F.lit("}}]}"))).otherwise(content)
    v = F.parse_json(F.coalesce(content, F.lit('{"choices":[]}')))
    shape, text, error = responses.contents(F.col("v"))
    failed = F.lit(responses.STATUS["content_extraction_failed"])
    return a.withColumn("v", v).select("conv_id", "turn", shape.alias("shape"), F.sha2(text, 256).alias("text_sha256"), error.alias("error"), F.when(error.isNotNull(), failed).alias("status"))


_YOLO = """WITH e AS (SELECT vec_id, i, [CAST(embedding[CASE WHEN vec_id % 2 = 1 THEN j * 8 + i ELSE i * 8 + j END + 1] AS DOUBLE) FOR j IN range(0, 8)] AS v FROM embeddings, (SELECT unnest(range(0, 8)) AS i) WHERE embedding IS NOT NULL),
d AS (SELECT vec_id, CAST(i AS INTEGER) AS i, list_position(v[5:8], list_max(v[5:8])) - 1 AS class, list_max(v[5:8]) AS score, (v[1] - v[3] / 2) * 640 AS x, (v[2] - v[4] / 2) * 480 AS y, v[3] * 640 AS w, v[4] * 480 AS h FROM e WHERE list_max(v[5:8]) >= 0.05)"""


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").where("embedding is not null")
    found = tensors.decoded(F.col("embedding"), 8, 8, F.col("vec_id") % 2 == 1, 640.0, 480.0, 0.05)
    return e.select("vec_id", F.explode(found).alias("b")).select("vec_id", "b.*")


@QUERIES.add(f"{_YOLO} SELECT vec_id, i, class, round(score, 6) AS score, round(x, 3) AS x, round(y, 3) AS y, round(w, 3) AS w, round(h, 3) AS h FROM d")
def decoded_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of detector outputs in both layouts."""
    return _decoded(spark, folder).select("vec_id", "i", "class", F.round("score", 6).alias("score"), *[F.round(c, 3).alias(c) for c in "xywh"])


_OVER = "greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y))"


@QUERIES.add(f"""{_YOLO}, k AS (SELECT * FROM d WHERE w > 0 AND h > 0), l AS (SELECT vec_id, list({{'i': i, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY score DESC, i) AS l FROM k GROUP BY vec_id),
r AS (SELECT vec_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, z: CASE WHEN len(list_filter(acc, lambda p: {_OVER.replace('q.', 'z[1].')} / (p.w * p.h + z[1].w * z[1].h - {_OVER.replace('q.', 'z[1].')}) > 0.45)) > 0 THEN acc ELSE list_concat(acc, z) END) AS kept FROM l)
SELECT vec_id, kept[n].i AS i, n - 1 AS rank FROM r, LATERAL (SELECT unnest(range(1, len(kept) + 1)) AS n)""")
def kept_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded boxes with an area after suppression across classes."""
    d = _decoded(spark, folder).where("w > 0 and h > 0").select(F.col("vec_id").alias("scene"), F.col("i").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in "xywh"], "score")
    return boxes.suppress(d, 0.45).select(F.col("scene").alias("vec_id"), F.col("b_id").alias("i"), F.col("rank").cast("long"))


@QUERIES.add("""WITH e AS (SELECT vec_id, i, 1 / (1 + exp(-10 * CAST(embedding[i + 1] AS DOUBLE))) AS score, [CAST(embedding[i * 16 + j] AS DOUBLE) * 100 / 128 FOR j IN range(1, 5)] AS r, ((vec_id * 4 + i) % 16 + 0.5) / 16 AS ax, ((vec_id + i) % 16 + 0.5) / 16 AS ay FROM embeddings, (SELECT unnest(range(0, 4)) AS i) WHERE embedding IS NOT NULL)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(score, 6) AS score, round((r[2] + ax - r[4] / 2) * 640, 3) AS x, round((r[1] + ay - r[3] / 2) * 480, 3) AS y, round(r[4] * 640, 3) AS w, round(r[3] * 480, 3) AS h FROM e WHERE score >= 0.5""")
def decoded_faces(spark: SparkSession, folder: str) -> DataFrame:
    """Faces by their distance from anchors, four a vector."""
    k = F.col("vec_id")
    anchors = F.array(*[F.struct((((k * 4 + i) % 16 + 0.5) / 16).alias("x"), (((k + i) % 16 + 0.5) / 16).alias("y")) for i in range(4)])
    scores = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 10)
    faces = tensors.anchored(scores, F.transform("embedding", lambda v: v.cast("double") * 100), anchors, 640.0, 480.0, 0.5)
    return table(spark, folder, "embeddings").where("embedding is not null").select("vec_id", F.explode(faces).alias("b")).select("vec_id", "b.i", F.round("b.score", 6).alias("score"), *[F.round(f"b.{c}", 3).alias(c) for c in "xywh"])


@QUERIES.add("""SELECT vec_id, string_agg(CAST(CAST(round(CAST(v AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY k) AS cells FROM (
 SELECT vec_id, k, embedding[least(CAST(floor((k // 12) * 8 / 5.0) AS BIGINT), 7) * 8 + least(CAST(floor((k % 12) * 8 / 12.0) AS BIGINT), 7) + 1] AS v FROM embeddings, (SELECT unnest(range(0, 60)) AS k) WHERE embedding IS NOT NULL) GROUP BY vec_id""")
def resized_grids(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as grids of eight by eight, at twelve by five."""
    cells = F.transform(tensors.resized(F.col("embedding"), (8, 8), (12, 5)), lambda v: F.round(v.cast("double") * 10000).cast("bigint").cast("string"))
    return table(spark, folder, "embeddings").where("embedding is not null").select("vec_id", F.array_join(cells, " ").alias("cells"))
