"""Chat turns as canonical JSON messages, with tool calls linked to their results. DataFrame functions only.

A call is written in a turn as `<tool_call>{"id": ..., "name": ..., "arguments": {...}, "depends_on": [...]}</tool_call>`, where depends_on, if present, names
the calls whose results it uses; a result is a turn of the role `tool` whose text is `{"tool_call_id": ..., "content": ...}`. Calls, results and
dependences meet in hash joins on conversation and identifier. A turn stands behind what it depends on: its place is its own turn, or behind the
last of these, found round by round along the chains. Arguments are validated against the tools' JSON schemas.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import set_apart, written

OPEN, CLOSE = "<tool_call>", "</tool_call>"
_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"


@dataclass(frozen=True)
class Tool:
    """schema: of the arguments, a JSON schema as a dictionary. The keywords type, enum, const, required, properties, additionalProperties, items, minItems,
    maxItems, minimum, maximum, minLength, maxLength and pattern count, at any depth; others are ignored."""

    name: str
    schema: dict


#: Tools that the queries know.
TOOLS = (
    Tool("search", {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}, "kinds": {"type": "array", "items": {"enum": ["page", "image", "table"]}}}}),
    Tool("calculate", {"type": "object", "required": ["expression"], "additionalProperties": False, "properties": {"expression": {"type": "string"}, "digits": {"type": "number"}}}),
    Tool("look_up", {"type": "object", "required": ["key"], "additionalProperties": False, "properties": {
        "key": {"type": "string"}, "fields": {"type": "array", "items": {"type": "string"}},
        "options": {"type": "object", "properties": {"depth": {"type": "integer", "minimum": 0}}, "additionalProperties": {"type": ["string", "boolean"]}}}}),
)


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null if it isn't JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def _kind(value: Column) -> Column:
    """The value's type in the terms of JSON schemas; of whole numbers, however written, integer."""
    sql = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    names = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), sql)
    number = F.try_variant_get(value, "$", "double")
    return F.when((kind == "number") & (number == F.floor(number)), "integer").otherwise(kind)


def _none() -> Column:
    return F.array().cast("array<string>")


def _said(wrong: Column, words: Column) -> Column:
    """An array with words if it is wrong, else empty."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(words)).otherwise(_none())


def violations(value: Column, schema: dict | bool, path: Column) -> Column:
    """Where and how a variant violates a schema: an array of words, empty if it doesn't. One expression, however deep the schema; arrays and objects of any
    size are looked through with higher-order functions."""
    if schema is True:
        return _none()
    if schema is False:
        return F.array(F.concat(path, F.lit(" is unexpected")))
    kind, out = _kind(value), []
    of = lambda name, found: F.when(kind.isin("integer", "number") if name == "number" else kind == name, found).otherwise(_none())
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = kind.isin(*wanted, *(["integer"] if "number" in wanted else []))
        out.append(_said(~fits, F.concat(path, F.lit(f" is not {' or '.join(wanted)}"))))
    for listed in [schema["enum"]] if "enum" in schema else [[schema["const"]]] if "const" in schema else []:
        out.append(_said(~F.to_json(value).isin(*(canonical_of(x) for x in listed)), F.concat(path, F.lit(" is not listed"))))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    for name, found in (("minimum", lambda x: number < x), ("maximum", lambda x: number > x)):
        if name in schema:
            out.append(of("number", _said(found(schema[name]), F.concat(path, F.lit(f" breaks {name}")))))
    for name, found in (("minLength", lambda x: F.char_length(text) < x), ("maxLength", lambda x: F.char_length(text) > x), ("pattern", lambda x: ~F.regexp_like(text, F.lit(x)))):
        if name in schema:
            out.append(of("string", _said(found(schema[name]), F.concat(path, F.lit(f" breaks {name}")))))
    members = F.try_variant_get(value, "$", "array<variant>")
    for name, found in (("minItems", lambda x: F.size(members) < x), ("maxItems", lambda x: F.size(members) > x)):
        if name in schema:
            out.append(of("array", _said(found(schema[name]), F.concat(path, F.lit(f" breaks {name}")))))
    if "items" in schema:
        at = lambda x, k: violations(x, schema["items"], F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))
        out.append(of("array", F.flatten(F.transform(members, at))))
    if {"required", "properties", "additionalProperties"} & set(schema):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        keys, known = F.map_keys(fields), schema.get("properties", {})
        step = lambda key: F.concat(path, F.lit("."), key)
        for key in schema.get("required", []):
            out.append(of("object", _said(~F.array_contains(keys, key), F.concat(step(F.lit(key)), F.lit(" is missing")))))
        for key, own in known.items():
            out.append(of("object", F.when(F.array_contains(keys, key), violations(F.try_element_at(fields, F.lit(key)), own, step(F.lit(key)))).otherwise(_none())))
        if (other := schema.get("additionalProperties", True)) is not True:
            rest = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)) if known else _none()))
            out.append(of("object", F.flatten(F.transform(rest, lambda key: violations(F.try_element_at(fields, key), other, step(key))))))
    return F.concat(*out) if out else _none()


def canonical_of(value) -> str:
    """A Python value as canonical() writes it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _errors(name: Column, given: Column, tools: tuple[Tool, ...]) -> Column:
    """What is wrong with a call's arguments (a variant): an array of words, empty if nothing."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool in reversed(tools):
        out = F.when(name == tool.name, violations(given, tool.schema, F.lit("arguments"))).otherwise(out)
    return F.when(F.coalesce(_kind(given) != "object", F.lit(True)), F.array(F.lit("arguments are no object"))).otherwise(out)


def _base(turns: DataFrame, *names: str) -> DataFrame:
    base, _ = set_apart(turns, names, turns.columns)
    return base.toDF("conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("bigint"))


def parsed(turns: DataFrame, tools: tuple[Tool, ...] = TOOLS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without calls, if all could be read), calls (id, name, arguments as canonical JSON, depends_on, errors), n_malformed and, of
    results, result_of and result."""
    base = _base(turns, conv_col, turn_col, role_col, text_col)
    blocks = F.when(F.contains("text", F.lit(OPEN)), F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(1))).otherwise(_none())
    raw = base.withColumn("blocks", F.coalesce(blocks, _none()))
    read = F.filter(F.transform("blocks", F.try_parse_json), lambda v: F.try_variant_get(v, "$.name", "string").isNotNull())

    def call(v: Column) -> Column:
        name, given = F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.arguments", "variant")
        given = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get(v, "$.arguments", "string"))).otherwise(given)
        after = F.coalesce(F.try_variant_get(v, "$.depends_on", "array<string>"), _none())
        return F.struct(F.try_variant_get(v, "$.id", "string").alias("id"), name.alias("name"), F.to_json(given).alias("arguments"), after.alias("depends_on"), _errors(name, given, tools).alias("errors"))

    out = raw.withColumn("calls", F.transform(read, call)).withColumn("n_malformed", (F.size("blocks") - F.size("calls")).cast("bigint"))
    out = out.withColumn("body", F.when((F.size("blocks") > 0) & (F.col("n_malformed") == 0), F.trim(F.regexp_replace("text", _BLOCK, ""))).otherwise(F.col("text")))
    answer = F.when(F.col("role") == "tool", F.try_parse_json("text"))
    given = F.try_variant_get(answer, "$.content", "variant")
    result = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(answer, "$.content", "string")).otherwise(F.to_json(given))
    out = out.withColumns({"result_of": F.try_variant_get(answer, "$.tool_call_id", "string"), "result": result})
    return out.select("conv_id", "turn", "role", F.col("body").alias("text"), "calls", "n_malformed", "result_of", "result")


def _called(read: DataFrame) -> DataFrame:
    """(of_conv, call_id, call_turn): the first turn in which an identifier is called. Combined before the shuffle, so repeats are no hot key."""
    each = read.where(F.size("calls") > 0).select(F.col("conv_id").alias("of_conv"), "turn", F.explode("calls.id").alias("call_id"))
    return each.where("call_id is not null").groupBy("of_conv", "call_id").agg(F.min("turn").alias("call_turn"))


def _answered(read: DataFrame) -> DataFrame:
    """(of_conv, call_id, result_turn, result): the first result with an identifier."""
    first = read.where("result_of is not null").groupBy(F.col("conv_id").alias("of_conv"), F.col("result_of").alias("call_id")).agg(F.min(F.struct("turn", "result")).alias("r"))
    return first.select("of_conv", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.result").alias("result"))


def _on(rows: DataFrame, other: DataFrame, column: str) -> Column:
    return rows["conv_id"].eqNullSafe(other["of_conv"]) & (rows[column] == other["call_id"])


def links(turns: DataFrame, tools: tuple[Tool, ...] = TOOLS) -> DataFrame:
    """One row for each call: conv_id, turn, call_id, name, arguments, errors, and result_turn and result of the first result with its identifier (null
    without one). A call without an identifier has no result; an empty table gives an empty result."""
    read = parsed(turns, tools)
    calls = read.where(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("own_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.errors").alias("errors"))
    results = _answered(read)
    joined = calls.join(results, _on(calls, results, "own_id"), "left")
    return joined.select("conv_id", "turn", F.col("own_id").alias("call_id"), "name", "arguments", "errors", "result_turn", "result")


def _dependences(read: DataFrame) -> DataFrame:
    """(conv, src, dst): the turn dst needs the turn src before it, as it is the result of a call there or calls with that result."""
    called, answered = _called(read), _answered(read).drop("result")
    results = read.where("result_of is not null").select("conv_id", "turn", "result_of")
    needs = read.where(F.size("calls") > 0).select("conv_id", "turn", F.explode(F.flatten("calls.depends_on")).alias("needed"))
    after_call = results.join(called, _on(results, called, "result_of")).select(F.col("conv_id").alias("conv"), F.col("call_turn").alias("src"), F.col("turn").alias("dst"))
    found = needs.join(called, _on(needs, called, "needed")).select("conv_id", "turn", "needed", "call_turn")
    after_result = found.join(answered, _on(found, answered, "needed"), "left").select(F.col("conv_id").alias("conv"), F.coalesce("result_turn", "call_turn").alias("src"), F.col("turn").alias("dst"))
    return after_call.union(after_result).where("src <> dst").distinct()


def _places(edges: DataFrame) -> DataFrame:
    """(of_conv, of_turn, anchor_turn, step) of the turns that need others: the greater of their own (turn, 0) and one step behind the last they need.

    Each round places the turns all of whose needs are placed, so there are as many rounds as the longest chain is long, each over the rest only and
    written. Turns on a circle, and behind one, are placed at themselves.
    """
    key = [F.col("conv").eqNullSafe(F.col("of_conv")), F.col("src") == F.col("of_turn")]
    need = edges.select(F.col("conv").alias("c"), F.col("dst").alias("d")).distinct()
    place = "of_conv {0}, of_turn bigint, anchor_turn bigint, step bigint".format(edges.schema["conv"].dataType.simpleString())
    placed = edges.sparkSession.createDataFrame([], place)
    pending = edges
    sources = edges.join(need, edges["conv"].eqNullSafe(need["c"]) & (edges["src"] == need["d"]), "left_anti").select(F.col("conv").alias("of_conv"), F.col("src").alias("of_turn"), F.col("src").alias("anchor_turn"), F.lit(0).cast("bigint").alias("step")).distinct()
    known = written(sources)
    while True:
        reached = pending.join(known, key, "left").select("conv", "dst", "of_turn", F.struct("anchor_turn", (F.col("step") + 1).alias("step")).alias("behind"))
        ready = reached.groupBy("conv", "dst").agg(F.count("*").alias("n"), F.count("of_turn").alias("m"), F.max(F.when(F.col("of_turn").isNotNull(), F.col("behind"))).alias("behind")).where("n = m")
        at = F.greatest(F.struct(F.col("dst").alias("anchor_turn"), F.lit(0).cast("bigint").alias("step")), F.col("behind"))
        now = written(ready.select(F.col("conv").alias("of_conv"), F.col("dst").alias("of_turn"), at.alias("at")).select("of_conv", "of_turn", "at.anchor_turn", "at.step"))
        if now.isEmpty():
            return placed
        placed, known = placed.union(now), known.union(now)
        pending = written(pending.join(now.select(F.col("of_conv").alias("c"), F.col("of_turn").alias("d")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("dst") == F.col("d")), "left_anti"))


def messages(turns: DataFrame, tools: tuple[Tool, ...] = TOOLS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv_id, turn, role, anchor_turn and step (the order within a conversation: by anchor_turn, step, turn), n_calls, n_invalid
    (calls with errors), n_malformed (calls that can't be read), linked (of results: whether the call was found; else null) and message (canonical JSON).

    A result stands behind its call, and a turn with calls behind the results that they depend on; turns that depend on each other in a circle stay at their
    own places. Of an identifier that is called, or answered, more than once the first turn counts. Rows come sorted by conversation and order,
    range-partitioned, so a conversation of any length is never gathered in one task or row. Texts of any length are read whole. Null texts give messages without content, null turns come
    first, null conversations are one; rows that repeat give equal messages; an empty table gives an empty result. Other columns are not returned.
    """
    base = _base(turns, conv_col, turn_col, role_col, text_col)
    # Only turns that can hold a call or a result are parsed, and that once.
    special = F.coalesce(F.contains("text", F.lit(OPEN)) | (F.col("role") == "tool"), F.lit(False))
    read = written(parsed(base.where(special), tools))
    called = _called(read)
    results = read.where("result_of is not null")
    answered = results.join(called, _on(results, called, "result_of"), "left").drop("of_conv", "call_id")
    none = {c: F.lit(None).cast(read.schema[c].dataType) for c in ("result_of", "result")}
    plain = base.where(~special).withColumns({"calls": F.array().cast(read.schema["calls"].dataType), "n_malformed": F.lit(0).cast("bigint"), **none})
    rows = answered.unionByName(read.where("result_of is null").unionByName(plain).withColumn("call_turn", F.lit(None).cast("bigint")))
    edges = written(_dependences(read))
    rows = rows.withColumns({"anchor_turn": F.col("turn"), "step": F.lit(0).cast("bigint")})
    if not edges.isEmpty():
        places = written(_places(edges)).withColumnsRenamed({"anchor_turn": "to_turn", "step": "to_step"})
        rows = rows.join(places, rows["conv_id"].eqNullSafe(places["of_conv"]) & (rows["turn"] == places["of_turn"]), "left")
        rows = rows.withColumns({"anchor_turn": F.coalesce("to_turn", "turn"), "step": F.coalesce("to_step", F.lit(0).cast("bigint"))})
    calls = F.when(F.size("calls") > 0, F.transform("calls", lambda c: F.struct(F.try_parse_json(c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))))
    message = F.struct(F.coalesce("result", "text").alias("content"), F.col("role").alias("role"), F.col("result_of").alias("tool_call_id"), calls.alias("tool_calls"))
    out = rows.select(
        "conv_id", "turn", "role", "anchor_turn", "step",
        F.size("calls").cast("bigint").alias("n_calls"), F.size(F.filter("calls", lambda c: F.size(c["errors"]) > 0)).cast("bigint").alias("n_invalid"), "n_malformed",
        F.when(F.col("result_of").isNotNull(), F.col("call_turn").isNotNull()).alias("linked"), F.to_json(message).alias("message"))
    order = ["conv_id", "anchor_turn", "step", "turn"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
