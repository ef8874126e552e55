"""Chat formatting: tool calls linked with their results.

Calls and results meet in a hash join by conversation and identifier. Calls
that name other calls of their conversation come after those: levels are found
in rounds, each a join of the calls still open with the levels so far, so a
conversation is never gathered anywhere. Arguments are validated against
schemas and everything is serialised as canonical JSON: keys by code point, no
blanks, non-ASCII as it is.

Of several results with one identifier the earliest turn counts, then the
smallest text; calls that repeat an identifier share it and keep their rows. A
call without a result is ``pending``; dependencies that no call of the
conversation has are ignored; calls on a cycle, or after one, have no level.
Arguments that are null, not JSON (numbers beyond doubles and lone surrogates
count as such) or not an object, and tools without a schema,
are invalid. Rows whose conversation or identifier is null take no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlattice.session import checkpoint

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a value has against a schema: type, enum, minimum, maximum, maxLength, required, properties, additionalProperties, items."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) != (kind == "boolean") and kind in ("integer", "number")):
        return [f"{at}: not of type {kind}"]
    out = [f"{at}: not among the allowed values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        out.append(f"{at}: longer than {schema['maxLength']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def checked(arguments: str | None, schema: dict | None) -> tuple[object, list[str]]:
    if schema is None:
        return None, ["$: no such tool"]
    try:
        value = json.loads(arguments or "null", parse_constant=lambda x: 1 / 0)
        canonical(value).encode()  # numbers beyond doubles and lone surrogates can't be written again
    except (ValueError, ZeroDivisionError, RecursionError):
        return None, ["$: not JSON"]
    return value, problems(value, {"type": "object"} | schema)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from (conv_id, call_id, after array<string>); without those on or behind a cycle."""
    nodes = checkpoint(calls.select("conv_id", "call_id").distinct())
    needs = calls.select("conv_id", "call_id", F.explode("after").alias("needs")).distinct()
    needs = checkpoint(needs.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi"))
    done = checkpoint(nodes.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    while True:
        still = needs.join(done, ["conv_id", "call_id"], "left_anti").join(done.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("below")), ["conv_id", "needs"], "left")
        ready = still.groupBy("conv_id", "call_id").agg(F.count(F.when(F.col("below").isNull(), 1)).alias("open"), F.max("below").alias("below")).filter("open = 0")
        ready = checkpoint(ready.select("conv_id", "call_id", (F.col("below") + 1).alias("level")))
        if ready.isEmpty():
            return done
        done = checkpoint(done.unionByName(ready))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON text), after (array of call ids); results: conv_id, turn, call_id, text.

    A row for each call: conv_id, turn, call_id, name, level, status, result_turn, valid, problems, message (canonical JSON).
    """
    calls = calls.filter("conv_id is not null and call_id is not null").select("conv_id", "turn", "call_id", "name", "arguments", "after")
    first = results.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"))).alias("result"))
    rows = calls.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(levels(calls), ["conv_id", "call_id"], "left")
    rows = rows.select("conv_id", "turn", "call_id", "name", "arguments", "after", "level", F.col("result").isNotNull().alias("linked"), F.col("result.turn").alias("result_turn"), F.col("result.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                value, found = checked(r["arguments"], schemas.get(r["name"]))
                message = {"call": {"id": r["call_id"], "name": r["name"], "arguments": value if not found else r["arguments"]}, "after": sorted(x for x in r["after"] or () if x is not None)}
                if r["linked"]:
                    message["result"] = r["text"]
                out.append((r["conv_id"], r["turn"], r["call_id"], r["name"], r["level"], "linked" if r["linked"] else "pending", r["result_turn"], not found, found, canonical(message)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 10, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string()), strict=True)], names=["conv_id", "turn", "call_id", "name", "level", "status", "result_turn", "valid", "problems", "message"])

    return rows.mapInArrow(run, "conv_id long, turn long, call_id string, name string, level int, status string, result_turn long, valid boolean, problems array<string>, message string")


#: The tools that from_turns() lets assistants call.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string", "maxLength": 4000}, "limit": {"type": "integer", "minimum": 1, "maximum": 6}}, "required": ["query", "limit"], "additionalProperties": False},
    "summarise": {"properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 5}}, "required": ["text", "words"], "additionalProperties": False},
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: every assistant turn calls a tool, after the call of the turn half as far in; the turn that follows is its result."""
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    said, turn = F.coalesce("text", F.lit("")), F.col("turn")
    mine = turns.filter("role = 'assistant' and conv_id is not null and turn is not null")
    search = F.length(said) % 2 == 0
    arguments = F.when(search, F.to_json(F.struct(said.alias("query"), (turn + 1).alias("limit")))).otherwise(F.to_json(F.struct(F.size(F.split(said, " ")).alias("words"), said.alias("text"))))
    calls = mine.select("conv_id", "turn", call_id(turn).alias("call_id"), F.when(search, "search").otherwise("summarise").alias("name"), arguments.alias("arguments"), F.when(turn > 1, F.array(call_id(F.floor(turn / 2)))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = turns.filter("role <> 'assistant' and turn > 0").select("conv_id", "turn", call_id(turn - 1).alias("call_id"), "text")
    return calls, results
