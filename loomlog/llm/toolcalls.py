"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results are joined by their identifier. A call may wait for one other call; its level
is the number of calls it waits for in turn, found by pointer doubling, so a chain of n calls
takes log n joins. Arguments are checked against the tool's schema, and each call becomes one
JSON text with sorted keys and no blanks.

Defined cases: of several calls, or results, with one identifier the first by position counts.
A null identifier links nothing and is left out. A call whose parent is not there starts a
chain. Calls in a cycle, or behind one, have no level. Arguments that are no JSON object, null
included, are invalid and are left out of the text. Results without a call are returned as
orphans. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.session import shared_folder

# the query's tools: (field, type, required, least length of a text)
SCHEMAS = {
    "configure": (("turn", "integer", True, 0), ("text", "string", True, 20)),
    "reply": (("turn", "integer", True, 0), ("text", "string", True, 20)),
}
# fixed values: the types of JSON, by the pattern of the type names that Spark gives them
_TYPES = {
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<.*$",
    "array": "^ARRAY<.*$",
}


def transcript_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of transcripts that spell them as JSON.

    An assistant's text is ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``, a tool's
    ``{"tool_call_id", "content"}``; other messages are passed over.
    """
    call = "struct<id:string,name:string,arguments:string,after:string>"
    place = F.col("turn").cast("long").alias("position")
    calls = (
        messages.filter("role = 'assistant'")
        .select(
            "conv_id",
            place,
            F.explode(F.from_json("text", f"tool_calls array<{call}>")["tool_calls"]).alias("c"),
        )
        .select(
            "conv_id", F.col("c.id").alias("call_id"), "position", F.col("c.name").alias("name"),
            F.col("c.arguments").alias("arguments"), F.col("c.after").alias("parent_id"),
        )
    )
    found = F.from_json("text", "tool_call_id string, content string")
    results = (
        messages.filter("role = 'tool'")
        .select("conv_id", place, found.alias("r"))
        .select(
            "conv_id", F.col("r.tool_call_id").alias("call_id"), "position",
            F.col("r.content").alias("content"),
        )
    )
    return calls, results


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls: a request asks for the assistant's next turn, after the
    request before it."""

    def name(back: int) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))

    turn = F.col("turn").cast("long").alias("position")
    asked = F.when(F.col("role") == "system", "configure").otherwise("reply")
    arguments = F.to_json(F.struct("turn", "text"))
    calls = messages.filter("role <> 'assistant'").select(
        "conv_id", name(0).alias("call_id"), turn, asked.alias("name"),
        arguments.alias("arguments"), name(2).alias("parent_id"),
    )
    results = messages.filter("role = 'assistant'").select(
        "conv_id", name(1).alias("call_id"), turn, F.col("text").alias("content")
    )
    return calls, results


def _first(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per identifier, the first by position; ties by the other fields' values."""
    least = F.min(F.struct("position", *fields)).alias("least")
    one = rows.filter("conv_id is not null and call_id is not null")
    return one.groupBy("conv_id", "call_id").agg(least).select("conv_id", "call_id", "least.*")


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)``: how many calls each one waits for; null in cycles."""
    spark = calls.sparkSession
    folder = shared_folder(spark)
    keys = ["conv_id", "call_id"]

    def written(df: DataFrame, turn: int) -> DataFrame:
        df.write.parquet(f"{folder}/levels{turn}")
        return spark.read.parquet(f"{folder}/levels{turn}")

    def ahead(rows: DataFrame, *fields: Column) -> DataFrame:
        return rows.select("conv_id", F.col("call_id").alias("jump"), *fields)

    parents = ahead(calls, F.lit(1).cast("long").alias("step"))
    # a parent counts only if it is there
    now = written(
        calls.select(*keys, F.col("parent_id").alias("jump"))
        .join(parents, ["conv_id", "jump"], "left")
        .select(
            *keys,
            F.coalesce("step", F.lit(0)).alias("level"),
            F.when(F.col("step").isNotNull(), F.col("jump")).alias("jump"),
        ),
        0,
    )
    total, reach, turn = now.count(), 1, 0
    while reach <= total and not now.filter("jump is not null").isEmpty():
        turn, reach = turn + 1, 2 * reach
        further = ahead(now, F.col("level").alias("more"), F.col("jump").alias("next"))
        moving = now.filter("jump is not null").join(further, ["conv_id", "jump"])
        now = written(
            moving.select(*keys, (F.col("level") + F.col("more")).alias("level"), F.col("next").alias("jump"))
            .unionByName(now.filter("jump is null")),
            turn,
        )
    return now.select(*keys, F.when(F.col("jump").isNull(), F.col("level")).alias("level"))


def problems(schemas=None) -> Column:
    """What is wrong with ``arguments`` (a variant) for the tool ``name``, in the schema's order."""
    schemas = SCHEMAS if schemas is None else schemas
    given = F.col("arguments")
    # null for anything but an object
    fields = F.json_object_keys(F.to_json(given))
    found = F.array(F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit(""))))
    for tool, schema in schemas.items():
        checks = []
        for field, kind, required, least in schema:
            value = F.try_variant_get(given, f"$['{field}']", "variant")
            there = F.array_contains(fields, field)
            fault = F.when(
                ~F.schema_of_variant(value).rlike(_TYPES[kind]), F.lit(f"{field}: not {kind}")
            )
            if least:
                text = F.try_variant_get(given, f"$['{field}']", "string")
                fault = fault.when(F.length(text) < least, F.lit(f"{field}: too short"))
            fault = F.when(there, fault)
            checks.append(fault.otherwise(F.lit(f"{field}: missing")) if required else fault)
        known = F.array(*(F.lit(f[0]) for f in schema))
        more = F.transform(
            F.array_sort(F.array_except(fields, known)), lambda k: F.concat(k, F.lit(": unknown"))
        )
        found = F.when(
            F.col("name") == tool, F.concat(F.array_compact(F.array(*checks)), more)
        ).otherwise(found)
    return F.when(fields.isNull(), F.array(F.lit("arguments: not an object"))).otherwise(found)


def link(calls: DataFrame, results: DataFrame, schemas=None) -> DataFrame:
    """``(conv_id, call_id, name, level, status, errors, record)``, one row for each identifier.

    ``calls`` has conv_id, call_id, position, name, arguments (JSON text) and parent_id,
    ``results`` conv_id, call_id, position and content. Calls in the order of conversation,
    level and position can be run one after the other.
    """
    spark = calls.sparkSession
    path = f"{shared_folder(spark)}/calls"
    _first(calls, ["name", "arguments", "parent_id"]).write.parquet(path)
    own = spark.read.parquet(path)
    keys = ["conv_id", "call_id"]
    replies = _first(results, ["content"]).select(*keys, "content", F.lit(True).alias("replied"))
    parsed = F.try_parse_json("arguments")
    status = (
        F.when(F.col("position").isNull(), "orphan")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("replied"), "linked")
        .otherwise("no result")
    )
    object_only = F.when(F.col("errors") != "arguments: not an object", F.col("arguments"))
    record = F.struct(  # names in sorted order
        F.coalesce(object_only, F.when(F.col("errors").isNull(), F.col("arguments"))).alias("arguments"),
        F.col("call_id").alias("id"),
        "level",
        "name",
        F.col("content").alias("result"),
        "status",
    )
    return (
        own.join(levels(own), keys)
        .join(replies, keys, "full")
        .withColumn("arguments", parsed)
        .withColumn("status", status)
        .withColumn(
            "errors", F.when(F.col("status") != "orphan", F.array_join(problems(schemas), "; "))
        )
        .withColumn("record", F.to_json(record))
        .select(*keys, "name", "position", "level", "status", "errors", "record")
    )
