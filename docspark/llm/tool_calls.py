"""Linking tool calls with their results, in an order in which every call follows those it needs.

Calls and results are hash-joined by conversation and identifier. Levels come
from peeling: in each round the calls that wait for nothing get the next level
and stop blocking others, so the number of rounds is the length of the longest
chain. Arguments are parsed once as variant values, checked against the schema of
their tool and printed in a canonical form: sorted keys, no blanks.

Positions are counted in blocks of a conversation, so one with a third of all
calls is numbered by many tasks; joins get unique keys on one side, and hot keys
on the other are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm import common

BLOCK = 4096

# Pattern of the variant's schema text for each type of a parameter.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
}

# Tool: parameter: (type, whether it is required).
Schemas = dict[str, dict[str, tuple[str, bool]]]


def _node(conversation: str, call: str) -> Column:
    return F.struct(F.col(conversation).alias("conv"), F.col(call).cast("string").alias("call"))


def _first_calls(calls: DataFrame) -> DataFrame:
    """One row per conversation and call id, the first by turn; `n_calls` counts its rows."""
    rows = calls.select(
        _node("conv_id", "call_id").alias("_node"),
        F.struct(
            F.col("turn").isNull().alias("u"),
            F.col("turn").alias("turn"),
            F.col("name").alias("name"),
            F.col("arguments").alias("arguments"),
            F.coalesce("after", F.array().cast("array<string>")).alias("after"),
        ).alias("_call"),
    )
    return rows.groupBy("_node").agg(F.min("_call").alias("_call"), F.count("*").alias("n_calls"))


def _first_results(results: DataFrame) -> DataFrame:
    rows = results.select(
        _node("conv_id", "call_id").alias("_node"),
        F.struct(
            F.col("turn").isNull().alias("u"), F.col("turn").alias("turn"), F.col("content").alias("content")
        ).alias("_result"),
    )
    return rows.groupBy("_node").agg(F.min("_result").alias("_result"), F.count("*").alias("n_results"))


def levels(calls: DataFrame) -> DataFrame:
    """`_node` and `level` of all calls that are in no circle and wait for none in one.

    `calls` has a row per `_node` and the ids `_call.after` it waits for. Ids that
    no call of the conversation has are waited for by nobody.
    """
    nodes = calls.select("_node")
    waits = calls.select(
        "_node",
        F.explode(
            F.transform(
                F.array_distinct("_call.after"),
                lambda c: F.struct(F.col("_node.conv").alias("conv"), c.alias("call")),
            )
        ).alias("_for"),
    )
    waits = common.stored(waits.join(nodes.select(F.col("_node").alias("_for")), "_for", "left_semi"))
    left, placed, level = common.stored(nodes), None, 0
    while True:
        blocked = waits.select("_node").distinct()
        ready = common.stored(left.join(blocked, "_node", "left_anti").withColumn("level", F.lit(level)))
        placed = ready if placed is None else placed.unionByName(ready)
        if ready.isEmpty():
            return placed
        left = common.stored(left.join(blocked, "_node", "left_semi"))
        if left.isEmpty():
            return placed
        waits = common.stored(waits.join(ready.select(F.col("_node").alias("_for")), "_for", "left_anti"))
        level += 1


def with_positions(rows: DataFrame) -> DataFrame:
    """Adds `position`: the place of a call in its conversation by level, turn and id, from 0."""
    conv = F.col("_node.conv")
    block = F.coalesce(F.floor(F.col("_call.turn") / BLOCK), F.lit(1 << 62))
    keyed = rows.withColumn("_conv", F.struct(conv.alias("conv"))).withColumn("_block", block)
    counts = keyed.groupBy("_conv", "level", "_block").agg(F.count("*").alias("_count"))
    by_block = Window.partitionBy("_conv").orderBy("level", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_count").over(by_block), F.lit(0))).drop("_count")
    within = Window.partitionBy("_conv", "level", "_block").orderBy(
        F.col("_call.turn").asc_nulls_last(), F.col("_node.call")
    )
    numbered = keyed.withColumn("_row", F.row_number().over(within).cast("long") - 1)
    return numbered.join(before, ["_conv", "level", "_block"]).withColumn("position", F.col("_before") + F.col("_row"))


def argument_errors(name: Column, arguments: Column, value: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments, in the order of the checks; empty if nothing is."""
    checks = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        found = []
        for parameter, (kind, required) in parameters.items():
            part = F.try_variant_get(value, f"$['{parameter}']", "variant")
            shape = F.schema_of_variant(part)
            if required:
                found.append(F.when(part.isNull(), F.lit(f"missing {parameter}")))
            found.append(F.when(part.isNotNull() & ~shape.rlike(TYPES[kind]), F.lit(f"{parameter} is no {kind}")))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.sort_array(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]).cast("array<string>")))
        unknown = F.transform(extra, lambda k: F.concat(F.lit("unknown "), k))
        checks = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), unknown)).otherwise(checks)
    shaped = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(value.isNull(), F.array(F.lit("no JSON"))).when(~shaped, F.array(F.lit("no object"))).otherwise(checks)


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and per result without a call.

    `calls` has conv_id, turn, call_id, name, arguments (JSON text) and after (ids
    of calls it waits for); `results` has conv_id, turn, call_id and content.
    `status` is linked, unanswered, circular (in a circle, or waiting for one;
    level and position are null) or orphan (a result without a call). `errors`
    says what is wrong with the arguments, and `message` is the canonical JSON of
    the call and its result.

    Of rows that repeat a call or result id in a conversation the first by turn
    counts, then the least; `n_calls` and `n_results` count them. Null ids are ids
    of their own, null arguments are no JSON, a null content is null in the
    message. Other columns are not read and may have any name. Empty tables give
    no rows.
    """
    first = common.stored(_first_calls(calls))
    placed = with_positions(first.join(levels(first), "_node")).select("_node", "level", "position")
    ordered = first.join(placed, "_node", "left")
    rows = ordered.join(_first_results(results), "_node", "full_outer")
    parsed = rows.withColumn("_value", F.try_parse_json("_call.arguments"))
    errors = argument_errors(F.col("_call.name"), F.col("_call.arguments"), F.col("_value"), schemas)
    status = (
        F.when(F.col("_call").isNull(), "orphan")
        .when(F.col("level").isNull(), "circular")
        .when(F.col("_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    message = F.struct(
        F.col("_value").alias("arguments"),
        F.col("_node.call").alias("call_id"),
        F.col("_result.content").alias("content"),
        F.col("_call.name").alias("name"),
    )
    return parsed.select(
        F.col("_node.conv").alias("conv_id"),
        F.col("_node.call").alias("call_id"),
        F.col("_call.name").alias("name"),
        status.alias("status"),
        "level",
        "position",
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.when(F.col("_call").isNotNull(), F.concat_ws("; ", errors)).alias("errors"),
        F.to_json(message, {"ignoreNullFields": "false"}).alias("message"),
    )
