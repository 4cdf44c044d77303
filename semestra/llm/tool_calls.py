"""Tool calls linked to their results, in dependency order, as canonical JSON.

Calls and results meet in a hash join on (conversation, call id). A call may
name calls whose results it uses; its level is the length of the longest chain
of known calls behind it, so (level, turn, call_id) is a topological order of a
conversation's calls. Calls that name one other call point at it, and pointers
are doubled until they reach a call that names none or several, so a chain takes
rounds by the logarithm of its length; what names several is settled in rounds
once all it names are (Kahn's order). Every round is a join, so a conversation
is never gathered. Arguments are
checked against the tool's schema (a subset of JSON Schema: type, required,
properties, enum, minimum, maximum, minLength, additionalProperties).

Defined results: repeated calls or results of one identifier collapse to the
least (turn, content), with the number of rows kept in ``copies``; a call
without result is 'pending', a result without call 'orphan'; a call in a cycle
or behind one has a null level and an error, one that names an unknown call an
error. Null
identifiers link with nothing and repeat nothing: each such row is returned as an
error. Arguments that are null or no JSON object are invalid, and so are those
nested deeper than the parser goes ('too deep'), numbers that are not finite
(NaN, Infinity, 1e400: 'not finite') and texts with half a surrogate pair
('lone surrogate'); their record has null arguments. 1.0 is an integer. Very long
arguments are parsed whole. Other columns are ignored.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.session import drop_written, materialize

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise OverflowError(text)
    return value


def _no_constant(text: str) -> float:
    raise OverflowError(text)


def parse_arguments(text: str | None) -> tuple[dict | None, list[str]]:
    """The JSON object of a text, or None and what is wrong with it."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
        canonical(value).encode()
    except OverflowError:
        return None, ["$: not finite"]
    except RecursionError:
        return None, ["$: too deep"]
    except UnicodeEncodeError:
        return None, ["$: lone surrogate"]
    except (TypeError, ValueError):
        value = None
    return (value, []) if isinstance(value, dict) else (None, ["$: type object"])


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def schema_errors(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``, as 'path: rule' in a fixed order."""
    out = []
    kind = schema.get("type")
    if kind and not _is(value, kind):
        return [f"{at}: type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: minimum"] * (value < schema.get("minimum", value)) + [f"{at}: maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: minLength")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    return out


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null if unsettled) and unknown (whether the
    call names an unknown one) of every call."""
    spark = calls.sparkSession
    written: list[str] = []
    key = ["conv_id", "call_id"]
    deps = calls.select(*key, F.explode(F.array_distinct("after")).alias("dep"))
    there = calls.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("is_known"))
    deps = materialize(deps.join(there, ["conv_id", "dep"], "left"), "deps", written)
    unknown = deps.where("is_known IS NULL").select(*key, F.lit(True).alias("unknown")).distinct()
    named = deps.where("is_known").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
    named = materialize(named, "named", written)
    roots = calls.select(*key).join(named, key, "left_anti").withColumn("level", F.lit(0))
    # A call that names one other points ``dist`` calls back, at ``to``.
    hop = named.where("n = 1").select(*key, F.col("dep").alias("to"), F.lit(1).alias("dist"))
    most = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < most and not hop.isEmpty():  # a pointer that reaches further goes round in a cycle
        after = hop.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        hop = materialize(hop.join(after, ["conv_id", "to"], "left")
                          .select(*key, F.coalesce("next", "to").alias("to"), F.col("dist"), "more"), "hop", written)
        moved = hop.where("more IS NOT NULL").isEmpty()
        hop = hop.select(*key, "to", (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
        if moved:
            break
        reach *= 2
    several = deps.where("is_known").join(named.where("n > 1").select(*key), key, "left_semi")
    back = hop.select("conv_id", F.col("call_id").alias("dep"), "to", "dist")
    open_ = materialize(several.join(back, ["conv_id", "dep"], "left").select(
        *key, F.coalesce("to", "dep").alias("to"), F.coalesce("dist", F.lit(0)).alias("dist"),
        F.lit(None).cast("int").alias("level")), "open", written)
    settled = new = materialize(roots, "roots", written)
    while not open_.isEmpty():
        came = new.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("came"))
        open_ = materialize(open_.join(came, ["conv_id", "to"], "left").select(
            *key, "to", "dist", F.coalesce("level", F.col("came") + F.col("dist")).alias("level")), "open", written)
        new = materialize(open_.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("have"),
                                                  (F.max("level") + 1).alias("level"))
                          .where("n = have").select(*key, "level"), "settled", written)
        if new.isEmpty():
            break
        settled = settled.union(new)
        open_ = open_.join(new.select(*key), key, "left_anti")
    ends = settled.select("conv_id", F.col("call_id").alias("to"), "level")
    chained = hop.join(ends, ["conv_id", "to"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    out = calls.select(*key).join(unknown, key, "left").join(settled.union(chained), key, "left")
    out = materialize(out.select(*key, F.coalesce("unknown", F.lit(False)).alias("unknown"), "level"), "levels")
    drop_written(spark, written)
    return out


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and per orphan result: conv_id, call_id, turn, name,
    level, status (linked, pending, orphan), valid, errors, copies, record.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after
    (array of call ids); ``results``: conv_id, turn, call_id, content. Order a
    conversation by (level, turn, call_id)."""
    key = ["conv_id", "call_id"]
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call = calls.where(whole).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"),
                                                F.count(F.lit(1)).alias("copies")).select(*key, "c.*", "copies")
    call = materialize(call.withColumn("after", F.coalesce("after", F.array().cast("array<string>"))), "calls")
    result = results.where(whole).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n")) \
        .select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n")
    # Without an identifier no row is a copy of another: each is returned.
    one = F.lit(1).cast("long")
    nameless = calls.where(~whole).select(*key, "turn", "name", "arguments", one.alias("copies"))
    stray = results.where(~whole).select(*key, F.col("turn").alias("result_turn"), "content", one.alias("n"))
    linked = (call.join(_levels(call), key, "left").join(result, key, "full_outer")
              .unionByName(nameless, allowMissingColumns=True).unionByName(stray, allowMissingColumns=True)
              .withColumn("status", F.when(F.col("copies").isNull(), "orphan").when(F.col("n").isNull(), "pending").otherwise("linked"))
              .withColumn("copies", F.coalesce("copies", "n")))

    @F.pandas_udf("struct<valid:boolean,errors:array<string>,record:string>")
    def finish(conv_id: pd.Series, call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series,
               status: pd.Series, level: pd.Series, unknown: pd.Series) -> pd.DataFrame:
        out = []
        for conv, cid, tool, text, said, state, lv, lost in zip(conv_id, call_id, name, arguments, content, status, level, unknown):
            has = lambda x: x is not None and x == x  # noqa: E731  neither null nor NaN
            conv, cid, tool, said = (x if has(x) else None for x in (conv, cid, tool, said))
            record: dict[str, Any] = {"id": cid, "result": said}
            errors = [] if has(conv) and cid is not None else ["$: no identifier"]
            if state != "orphan":
                args, wrong = parse_arguments(text)
                if tool not in schemas:
                    errors.append("$: unknown tool")
                errors += wrong
                if args is not None and tool in schemas:
                    errors += schema_errors(args, schemas[tool])
                if not has(lv) and cid is not None and has(conv):
                    errors.append("$: unsettled dependency")
                if lost:
                    errors.append("$: unknown dependency")
                record |= {"arguments": args, "name": tool}
            out.append((not errors and state != "orphan", errors, canonical(record)))
        return pd.DataFrame(out, columns=["valid", "errors", "record"])

    done = linked.withColumn("f", finish(F.col("conv_id").cast("string"), "call_id", "name", "arguments", "content",
                                         "status", F.col("level").cast("double"), F.coalesce("unknown", F.lit(False))))
    return done.select(*key, F.coalesce("turn", "result_turn").alias("turn"), "name", "level", "status",
                       "f.valid", "f.errors", "copies", "f.record")


#: The tools that ``calls_of_conversations`` names.
SCHEMAS = {
    "answer": {"type": "object", "required": ["after", "chars", "text"], "additionalProperties": False, "properties": {
        "after": {"type": "string"}, "chars": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 1}}},
    "greet": {"type": "object", "required": ["chars", "text"], "additionalProperties": False, "properties": {
        "chars": {"type": "integer", "minimum": 0, "maximum": 1500}, "text": {"type": "string", "minLength": 1}}},
}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: an assistant turn is a call
    that uses the call two turns earlier (turn 3 or later) and whose result is
    the user turn that follows it."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cid = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    late = F.col("turn") >= 3
    args = F.to_json(F.struct(F.col("text"), F.length("text").alias("chars"), F.when(late, cid(F.col("turn") - 2)).alias("after")))
    calls = said.where("role = 'assistant'").select(
        "conv_id", "turn", cid(F.col("turn")).alias("call_id"), F.when(late, "answer").otherwise("greet").alias("name"),
        args.alias("arguments"), F.when(late, F.array(cid(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = said.where("role = 'user' AND turn > 0").select(
        "conv_id", "turn", cid(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
