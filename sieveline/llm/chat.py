"""Chat formatting: tool calls linked to results, ordered, checked, serialised.

Calls and results meet in a hash join by conversation and identifier. Places
follow from edges (call before result, call before calls that name it as a
condition): chains are contracted by pointer doubling, what has several
conditions is placed once all of them are, and what never is lies in or behind a
cycle. A call's arguments are exploded level by level and joined to the fields
of its tool's schema. Messages become JSON with sorted keys and no white space.
Rows stay messages: no conversation is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tools as rows: a field is a path (``a.b`` in objects, ``a[]`` for the items of
#: an array), choices are the only values it may have (null: any).
SCHEMAS = [
    ("search", "query", "string", True, None),
    ("search", "limit", "integer", False, None),
    ("search", "filters", "object", False, None),
    ("search", "filters.language", "string", True, None),
    ("search", "filters.sites", "array", False, None),
    ("search", "filters.sites[]", "string", False, None),
    ("calculator", "expression", "string", True, None),
    ("weather", "city", "string", True, None),
    ("weather", "days", "integer", False, None),
    ("weather", "unit", "string", False, ["celsius", "fahrenheit"]),
]
SCHEMA_OF_SCHEMAS = "tool string, field string, type string, required boolean, choices array<string>"
CALL = "struct<id:string,name:string,arguments:variant,after:array<string>>"


def _json_type(variant: Column | str) -> Column:
    of = F.schema_of_variant(variant)
    return (
        F.when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of == "BIGINT", "integer").when(of.startswith("OBJECT"), "object")
        .when(of.startswith("ARRAY"), "array").when(of == "VOID", "null").otherwise("number")
    )


def _call(c: Column) -> Column:
    """A call of either shape: its fields beside its id, or in ``function``.
    Arguments that are a string of JSON are that JSON."""
    get = lambda path, kind: F.coalesce(F.try_variant_get(c, f"$.{path}", kind), F.try_variant_get(c, f"$.function.{path}", kind))
    given = get("arguments", "variant")
    inner = F.try_parse_json(F.when(_json_type(given) == "string", F.try_variant_get(given, "$", "string")))
    after = F.try_variant_get(c, "$.after", "array<string>")
    return F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), get("name", "string").alias("name"), F.coalesce(inner, given).alias("arguments"), after.alias("after"))


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds conv (the conversation as a string, so that null ids meet), row
    (which names a message), calls and result_id.

    An assistant's text that is an object with ``tool_calls``, an array of
    objects, holds calls; a tool's text that is an object with ``tool_call_id``
    is a result.
    """
    v = F.try_parse_json(F.when(F.ltrim("text").startswith("{"), F.col("text")))
    rows = messages.select("conv_id", "turn", "role", "text", F.to_json(F.struct("conv_id")).alias("conv"), F.xxhash64("conv_id", "turn", "role", "text").alias("row"), v.alias("v"))
    given = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    calls = F.when(F.forall(given, lambda c: _json_type(c) == "object"), F.transform(given, _call))
    return rows.withColumns({
        "calls": F.coalesce(calls, F.array().cast(f"array<{CALL}>")),
        "result_id": F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")),
        "result": F.when(F.col("role") == "tool", F.try_variant_get("v", "$.content", "variant")),
    })


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Problems of calls (row, at, name, arguments): row, at, problem.

    A call is at fault if its tool is unknown, its arguments are no object, a
    required field is missing or null, a field is not in the schema, or a value
    has another type (an integer is also a number) or is none of the choices.
    Objects and arrays are followed as far as the schema has fields for them.
    """
    spark = calls.sparkSession
    tools = schemas.select("tool").distinct()
    unknown = calls.join(tools, calls["name"] == tools["tool"], "left_anti").select("row", "at", F.lit("unknown tool").alias("problem"))
    named = calls.join(tools, calls["name"] == tools["tool"], "left_semi").withColumn("kind", _json_type("arguments"))
    problems = unknown.unionByName(named.where(~F.coalesce(F.col("kind") == "object", F.lit(False))).select("row", "at", F.lit("arguments are no object").alias("problem")))
    parent = F.when(F.col("field").endswith("[]"), F.expr("left(field, length(field) - 2)")).when(F.contains("field", F.lit(".")), F.regexp_extract("field", r"^(.*)\.[^.]*$", 1)).otherwise("")
    fields = schemas.select("tool", "field", "type", "required", "choices", parent.alias("parent"))
    depth = schemas.agg(F.max(F.size(F.split("field", r"\.|(?=\[)")))).first()[0] or 0
    level = named.where("kind = 'object'").select("row", "at", "name", F.lit("").alias("path"), F.lit("").alias("place"), "kind", F.col("arguments").alias("value"))
    for _ in range(depth):
        opened = level.join(fields.select("tool", F.col("parent").alias("path")).distinct().withColumnRenamed("tool", "name"), ["name", "path"], "left_semi").where("kind in ('object', 'array')")
        step = F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        place = F.concat_ws("/", "place", F.coalesce("key", F.col("pos").cast("string")))
        inner = opened.withColumnRenamed("value", "whole").lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        given = inner.select("row", "at", "name", step.alias("path"), "place", place.alias("inner"), _json_type("value").alias("kind"), "value")
        typed = given.join(fields, (given["name"] == fields["tool"]) & (given["path"] == fields["field"]), "left")
        fits = (F.col("kind") == F.col("type")) | ((F.col("type") == "number") & (F.col("kind") == "integer")) | ((F.col("kind") == "null") & ~F.col("required"))
        chosen = F.col("choices").isNull() | (F.col("kind") == "null") | F.array_contains("choices", F.try_variant_get("value", "$", "string"))
        tell = lambda df, what, c: df.select("row", "at", F.concat_ws(" ", F.lit(what), c).alias("problem"))
        needed = opened.where("kind = 'object'").select("row", "at", "name", "path", "place").join(fields.where("required"), (F.col("name") == F.col("tool")) & (F.col("path") == F.col("parent"))).select("row", "at", "place", F.col("field").alias("path"))
        problems = (
            problems.unionByName(tell(typed.where(F.col("field").isNotNull() & ~fits), "wrong type of", "path"))
            .unionByName(tell(typed.where(F.col("field").isNotNull() & fits & ~F.coalesce(chosen, F.lit(False))), "no such choice for", "path"))
            .unionByName(tell(typed.where("field is null"), "no such field", "path"))
            .unionByName(tell(needed.join(given.select("row", "at", "place", "path"), ["row", "at", "place", "path"], "left_anti"), "missing", "path"))
        )
        level = given.select("row", "at", "name", "path", F.col("inner").alias("place"), "kind", "value")
    return problems


def _later(place: str, by: Column | str) -> Column:
    return F.struct(F.col(f"{place}.turn").alias("turn"), (F.col(f"{place}.step") + (F.col(by) if isinstance(by, str) else by)).alias("step"))


def _chains(nodes: DataFrame, single: DataFrame) -> DataFrame:
    """Contract the nodes with at most one condition: row, end, low, far.

    ``nodes`` has row and place, ``single`` row and end (the condition). A node
    lies ``far`` steps behind the node ``end`` (null: none), which has several
    conditions, and not before ``low``. Each round doubles the steps that it
    looks back, so there is a logarithm of them; nodes whose end still is a
    node with one condition then are in or behind a cycle.
    """
    state = materialize(nodes.join(single, "row", "left").select("row", "end", F.col("place").alias("low"), F.when(F.col("end").isNull(), 0).otherwise(1).cast("bigint").alias("far")), "chains")
    for _ in range(max(1, state.count()).bit_length() + 1):
        before = state.select(F.col("row").alias("end"), F.col("end").alias("end2"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        if state.join(before, "end", "left_semi").isEmpty():
            break
        met = state.join(before, "end", "left")
        more = F.col("far2").isNotNull()
        state = materialize(met.select(
            "row", F.when(more, F.col("end2")).otherwise(F.col("end")).alias("end"),
            F.when(more, F.greatest("low", _later("low2", "far"))).otherwise(F.col("low")).alias("low"),
            F.when(more, F.col("far") + F.col("far2")).otherwise(F.col("far")).alias("far"),
        ), "chains")
    return state


def places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """row and place of ``nodes`` (row, turn): the first place after all of a
    node's conditions, edges a before b; place is null in or behind a cycle.

    A place is a turn and a step: a node stays in its turn unless a condition is
    in a later one, and then comes some steps behind it.
    """
    start = nodes.select("row", F.struct("turn", F.lit(0).cast("bigint").alias("step")).alias("place"))
    if edges.isEmpty():
        return start
    conditions = edges.groupBy(F.col("b").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("end"))
    many = materialize(start.join(conditions.where("n > 1"), "row", "left_semi"), "many")
    chains = _chains(start.join(many, "row", "left_anti"), conditions.where("n = 1").select("row", "end"))
    looped = chains.join(chains.select(F.col("row").alias("end")), "end", "left_semi").select("row")
    # What stands before a node of many conditions: itself such a node, or a chain.
    into = edges.join(many.select(F.col("row").alias("b")), "b", "left_semi")
    ends = into.join(chains.withColumnRenamed("row", "a"), "a", "left")
    direct = F.col("far").isNull()
    known = materialize(ends.where(~direct).groupBy(F.col("b").alias("row")).agg(F.max(_later("low", F.lit(1))).alias("low")), "known")
    open_ = materialize(ends.where(direct | F.col("end").isNotNull()).select(F.col("b").alias("row"), F.when(direct, F.col("a")).otherwise(F.col("end")).alias("end"), F.when(direct, 1).otherwise(F.col("far") + 1).cast("bigint").alias("far")).distinct(), "open")
    waiting = materialize(many.join(known, "row", "left").select("row", F.greatest("place", "low").alias("low")), "waiting")
    settled = waiting.join(open_, "row", "left_anti").select("row", F.col("low").alias("place"))
    while True:
        settled = materialize(settled, "settled")
        met = open_.join(settled.select(F.col("row").alias("end"), "place"), "end", "left")
        ready = met.groupBy("row").agg(F.bool_and(F.col("place").isNotNull()).alias("all"), F.max(_later("place", "far")).alias("least")).where("all")
        fresh = materialize(waiting.join(ready, "row").join(settled, "row", "left_anti").select("row", F.greatest("low", "least").alias("place")), "fresh")
        if fresh.isEmpty():
            break
        settled = settled.unionByName(fresh)
    behind = chains.join(looped, "row", "left_anti").join(settled.withColumnRenamed("row", "end"), "end", "left")
    behind = behind.select("row", F.when(F.col("end").isNull(), F.col("low")).when(F.col("place").isNotNull(), F.greatest("low", _later("place", "far"))).alias("place"))
    return nodes.select("row").join(behind.unionByName(settled), "row", "left")


def format_chat(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Every message with its links, its place and its canonical JSON.

    Returns one row per row of ``messages``: conv_id, turn, place_turn,
    place_step (sort by these within a conversation), role, n_calls, n_invalid
    (calls at fault), n_answered, status, json. Of calls with one identifier in
    a conversation the earliest counts, of results the earliest. A message of
    calls or a result is ``unordered`` (in or behind a cycle of conditions, it
    keeps its turn), ``repeated`` (its identifier came earlier), ``orphan`` (a
    result without a call), ``unnamed`` (a call without identifier),
    ``unanswered`` (a call without result) or ``linked``, by the first of these
    that holds; all others are ``plain``. Rows with a null conv_id are one
    conversation; a null text is a null content; texts of any length are read
    whole, rows of one conversation and turn keep both, rows alike in full have
    equal results. The JSON of a message has its content, role, calls (id, name,
    arguments) or tool_call_id; other fields of a message or call, such as ``type``
    and ``after``, are not part of the canonical form. An empty table gives an empty result. Extra columns are not
    read.
    """
    spark = messages.sparkSession
    schemas = spark.createDataFrame(SCHEMAS, SCHEMA_OF_SCHEMAS) if schemas is None else schemas
    rows = _parsed(messages)
    calls = rows.select("conv", "turn", "row", F.posexplode("calls").alias("at", "c")).select("conv", "turn", "row", "at", "c.*")
    calls = materialize(calls.dropDuplicates(["row", "at"]), "calls")
    results = materialize(rows.where("result_id is not null").select("conv", "turn", "row", F.col("result_id").alias("id")).dropDuplicates(["row"]), "results")

    first = lambda df, name: df.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "row")).alias(name))
    pairs = materialize(first(calls, "call").join(first(results, "answer"), ["conv", "id"], "full"), "pairs")
    linked = pairs.where("call is not null and answer is not null")
    waits = calls.select("conv", F.explode("after").alias("id"), F.col("row").alias("b")).join(pairs.where("call is not null"), ["conv", "id"]).select(F.col("call.row").alias("a"), "b")
    edges = materialize(linked.select(F.col("call.row").alias("a"), F.col("answer.row").alias("b")).unionByName(waits).where("a <> b").distinct(), "edges")
    nodes = materialize(calls.select("row", "turn").unionByName(results.select("row", "turn")).distinct(), "nodes")
    placed = materialize(places(nodes, edges), "places")

    faults = check_arguments(calls, schemas).select("row", "at").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_invalid"))
    answered = linked.select(F.col("call.row").alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n_answered"))
    told = lambda df, rank, why: df.select("row", F.struct(F.lit(rank).alias("rank"), F.lit(why).alias("why")).alias("why"))
    mine = lambda df, side: df.join(pairs.select("conv", "id", F.col(f"{side}.row").alias("f")), ["conv", "id"]).where("row <> f")
    why = (
        told(placed.where("place is null"), 0, "unordered").unionByName(told(mine(calls, "call"), 1, "repeated")).unionByName(told(mine(results, "answer"), 1, "repeated"))
        .unionByName(told(pairs.where("call is null").select(F.col("answer.row").alias("row")), 2, "orphan")).unionByName(told(calls.where("id is null"), 3, "unnamed"))
        .unionByName(told(pairs.where("answer is null").select(F.col("call.row").alias("row")), 4, "unanswered"))
    ).groupBy("row").agg(F.min("why")["why"].alias("why"))
    notes = placed.join(faults, "row", "left").join(answered, "row", "left").join(why, "row", "left")
    notes = materialize(notes, "notes")

    call_json = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    with_calls = F.to_json(F.struct(F.try_variant_get("v", "$.content", "string").alias("content"), "role", call_json.alias("tool_calls")), {"ignoreNullFields": "false"})
    as_result = F.to_json(F.struct(F.col("result").alias("content"), "role", F.col("result_id").alias("tool_call_id")), {"ignoreNullFields": "false"})
    json = F.when(F.size("calls") > 0, with_calls).when(F.col("result_id").isNotNull(), as_result).otherwise(plain)
    special = (F.size("calls") > 0) | F.col("result_id").isNotNull()
    return rows.join(notes, "row", "left").select(
        "conv_id", "turn",
        F.coalesce("place.turn", "turn").alias("place_turn"), F.coalesce(F.col("place.step").cast("int"), F.lit(0)).alias("place_step"), "role",
        F.size("calls").alias("n_calls"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"), F.coalesce("n_answered", F.lit(0)).alias("n_answered"),
        F.when(special, F.coalesce("why", F.lit("linked"))).otherwise("plain").alias("status"), json.alias("json"),
    )


#: The given tables hold no calls, so there SQL can say the whole result.
ORACLE = """
SELECT conv_id, turn, turn AS place_turn, 0 AS place_step, role, 0 AS n_calls, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_answered,
       'plain' AS status, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json
FROM conversations
"""
