"""Operator 3. Tool-call linking: hash-join calls and results by identifier, order the calls topologically, validate their
arguments against schemas, serialise canonical JSON. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, stored, table

#: JSON schemas by tool.
Schemas = dict[str, dict]

#: Keywords of schemas that are checked (fixed values); any other is an error, as it would be passed over. additionalProperties
#: may be true or false.
KEYWORDS = set("type properties required additionalProperties items enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern minItems maxItems title description default examples".split())
#: What schema_of_variant calls the values of a JSON type, by its first letters (fixed values).
NUMBERS = ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"]
TYPE_NAMES = {"string": ["STRING"], "number": NUMBERS, "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


def any_holds(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def of_type(kind: Column, number: Column, name: str) -> Column:
    """Whether a value has a JSON type; a number without a fraction is an integer however it is written."""
    named = lambda names: any_holds([kind.startswith(n) for n in names])
    return named(NUMBERS) & F.coalesce(number % 1 == 0, F.lit(False)) if name == "integer" else named(TYPE_NAMES[name])


def equals(value: Column, kind: Column, number: Column, literal) -> Column:
    """Equality with a JSON literal that is no array or object: of one type, numbers by value."""
    if isinstance(literal, (dict, list)):
        raise ValueError(f"{literal} in a schema: only single values are compared")
    if literal is None:
        return of_type(kind, number, "null")
    if isinstance(literal, bool):
        return of_type(kind, number, "boolean") & (F.try_variant_get(value, "$", "boolean") == literal)
    if isinstance(literal, (int, float)):
        exact = F.try_variant_get(value, "$", "long") == literal if isinstance(literal, int) and abs(literal) < 2**63 else number == float(literal)
        return of_type(kind, number, "number") & F.when(kind.startswith("BIGINT"), exact).otherwise(number == float(literal))
    return of_type(kind, number, "string") & (F.try_variant_get(value, "$", "string") == literal)


def value_errors(value: Column, schema: dict, at: str) -> list[Column]:
    """Messages (null where all is well) about a variant that is present; a value that is absent has none. A keyword asks
    something of values of its own type only, and nothing of a value whose type is wrong already."""
    if not set(schema) <= KEYWORDS or not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"keywords that aren't known: {sorted(set(schema) - KEYWORDS) or ['additionalProperties']}")
    named = at or "arguments"
    kind = F.schema_of_variant(value)
    number = F.when(any_holds([kind.startswith(n) for n in NUMBERS]), F.try_variant_get(value, "$", "double"))
    text = F.when(kind.startswith("STRING"), F.try_variant_get(value, "$", "string"))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    fits = value.isNotNull() & (F.coalesce(any_holds([of_type(kind, number, t) for t in types]), F.lit(False)) if types else F.lit(True))
    bad = lambda broken, message: F.when(fits & F.coalesce(broken, F.lit(False)), f"{message} {named}")
    out = [F.when(value.isNotNull() & ~fits, f"type of {named}")]
    allowed = [*schema.get("enum", []), *([schema["const"]] if "const" in schema else [])]
    if allowed:
        one = lambda v: F.coalesce(equals(value, kind, number, v), F.lit(False))
        tests = [any_holds([one(v) for v in schema["enum"]])] if "enum" in schema else []
        tests += [one(schema["const"])] if "const" in schema else []
        out.append(bad(~reduce(lambda a, b: a & b, tests), "value of"))
    limits = [(k, f) for k, f in (("minimum", lambda v: number < v), ("maximum", lambda v: number > v), ("exclusiveMinimum", lambda v: number <= v), ("exclusiveMaximum", lambda v: number >= v)) if k in schema]
    if limits:
        out.append(bad(any_holds([f(float(schema[k])) for k, f in limits]), "range of"))
    if "minLength" in schema or "maxLength" in schema:
        out.append(bad(~F.length(text).between(schema.get("minLength", 0), schema.get("maxLength", 2**31 - 1)), "length of"))
    if "pattern" in schema:
        out.append(bad(~text.rlike(schema["pattern"]), "pattern of"))
    if "minItems" in schema or "maxItems" in schema:
        out.append(bad(~F.size(items).between(schema.get("minItems", 0), schema.get("maxItems", 2**31 - 1)), "items of"))
    if "items" in schema:
        wrong = lambda e: any_holds([m.isNotNull() for m in value_errors(e, schema["items"], f"{at}[]")])
        out.append(bad(F.exists(items, wrong), "an item of"))
    inner, is_object = f"{at}." if at else "", kind.startswith("OBJECT")
    for name in dict.fromkeys([*schema.get("properties", {}), *schema.get("required", [])]):
        got = F.when(is_object, F.try_variant_get(value, f"$['{name}']", "variant"))
        if name in schema.get("required", []):
            out.append(F.when(fits & is_object & got.isNull(), f"missing {inner}{name}"))
        if name in schema.get("properties", {}):
            out += value_errors(got, schema["properties"][name], inner + name)
    return out


def unknown_keys(value: Column, schema: dict, at: str) -> list[Column]:
    """Arrays of messages about keys that a closed object doesn't declare."""
    inner, out = f"{at}." if at else "", []
    if schema.get("additionalProperties") is False:
        keys = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
        more = F.array_except(keys, F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))
        out.append(F.transform(F.coalesce(more, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"unknown {inner}"), k)))
    for name, child in schema.get("properties", {}).items():
        out += unknown_keys(F.try_variant_get(value, f"$['{name}']", "variant"), child, inner + name)
    return out


def argument_errors(name: Column, value: Column, schemas: Schemas) -> Column:
    """Sorted messages about a call's arguments (a variant, null if the text is no JSON): no such tool, no JSON object, or
    what its tool's schema says."""
    none = F.array().cast("array<string>")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("no such tool"))
    for tool, schema in schemas.items():
        found = F.concat(F.array_compact(F.array(*value_errors(value, schema, ""))), *unknown_keys(value, schema, ""), none)
        out = F.when(name == tool, F.when(is_object, F.sort_array(found)).otherwise(F.array(F.lit("not a JSON object")))).otherwise(out)
    return out


def topological_depth(calls: DataFrame) -> DataFrame:
    """(call_id, depth) for the edge table (call_id, after), a row per call and predecessor: how many calls come before on
    the longest chain of `after`.

    Pointers are doubled along calls of one predecessor, so a chain of n calls takes log2(n) joins and no task holds a
    chain; a call whose chain is followed to its end leaves the loop. Calls of several predecessors then settle in rounds,
    one per level of such calls. An `after` that names no call starts a chain; a call on or behind a cycle has a null depth.
    """
    pairs = stored(calls.where(F.col("call_id").isNotNull()).select("call_id", "after").distinct())
    known = pairs.select("call_id").distinct()
    edges = stored(pairs.join(known.select(F.col("call_id").alias("after")), "after").select("call_id", F.col("after").alias("up")))
    fan = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"), F.min("up").alias("_up"))
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    state = cut(known.join(fan, "call_id", "left").select("call_id", F.when(one, F.col("_up")).alias("up"), F.when(one, F.col("_up")).otherwise(F.col("call_id")).alias("root"), one.cast("long").alias("depth"), (F.col("_n") > 1).alias("_several")))
    several = state.where("_several").select(F.col("call_id").alias("_j"), F.lit(None).cast("long").alias("_d"))
    state = state.drop("_several")
    done, active = state.where("up is null"), state.where("up is not null")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if active.isEmpty():
            break
        above = done.unionByName(active).select(F.col("call_id").alias("_id"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = active.join(above.hint("shuffle_hash"), F.col("up") == F.col("_id"))
        moved = cut(moved.select("call_id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth")))
        done, active = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    state = done.unionByName(active.withColumn("depth", F.lit(None).cast("long")))
    if several.isEmpty():
        return state.select("call_id", "depth")
    ends = state.select(F.col("call_id").alias("up"), "root", (F.col("depth") + 1).alias("steps"))
    parts = edges.join(several.select(F.col("_j").alias("call_id")), "call_id", "left_semi").join(ends, "up")
    parts = cut(parts.join(several.select("_j"), F.col("root") == F.col("_j"), "left").select(F.col("call_id").alias("_j"), F.col("_j").isNull().alias("free"), "root", "steps"))
    settled = 0
    while True:
        values = several.select(F.col("_j").alias("root"), "_d")
        far = F.when(F.col("free"), F.col("steps")).otherwise(F.col("steps") + F.col("_d"))
        several = cut(parts.join(values, "root", "left").groupBy("_j").agg(F.when(F.count(far) == F.count(F.lit(1)), F.max(far)).alias("_d")))
        now = several.where("_d is not null").count()
        if now == settled:
            break
        settled = now
    joined = state.join(several, F.col("root") == F.col("_j"), "left")
    return joined.select("call_id", F.when(F.col("_j").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("_d")).alias("depth"))


#: Parts that the rows of an identifier with several different ones are dealt to.
SALTS = 64


def summed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A row per identifier: n_<name> (rows), the least row (struct of columns) and whether there are different ones. Rows
    of an identifier are combined before they are shuffled."""
    row = F.struct(*columns)
    out = rows.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(row).alias(f"_{name}"), F.max(row).alias("_most"))
    return out.withColumn(f"_many_{name}", ~F.col(f"_{name}").eqNullSafe(F.col("_most"))).drop("_most")


def spread(rows: DataFrame, columns: list[str], ident: DataFrame) -> DataFrame:
    """Every different row of `rows` beside its identifier's row of ident. An identifier's rows are dealt to SALTS parts by
    their hash, and its ident row to each of them, so no task gets all rows of an identifier."""
    near = rows.join(ident.select("call_id"), "call_id", "left_semi").select("call_id", *columns).distinct()
    near = near.withColumn("_s", F.pmod(F.xxhash64(*columns), F.lit(SALTS)))
    salted = ident.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(near, ["call_id", "_s"]).drop("_s")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, edges: DataFrame | None = None) -> DataFrame:
    """Calls and results that share an identifier: call_id, name, depth, status (answered, unanswered, orphan, ambiguous),
    n_calls, n_results, errors, json (canonical: sorted keys, no white space).

    calls: call_id, name, arguments (JSON text), and after where there are no edges. results: call_id, content. Predecessors
    are those of `edges` (call_id, after), a row each, or of the calls' `after`. Every different call (name, arguments) and
    every different result is kept with its own errors and json: where an identifier has one different call, each of its
    results is a row with it; where it has one different result, each of its calls is a row with it. Where it has several of
    both, nothing says which result is whose, so each call and each result is a row of its own, with the status ambiguous.
    n_calls and n_results count the rows of the identifier. Rows grow with calls and results, not their product. Null
    identifiers are left out; null arguments are no JSON object; other columns are not read; empty tables give an empty one.
    """
    after = calls.select("call_id", "after") if edges is None else calls.select("call_id", F.lit(None).cast("string").alias("after")).unionByName(edges.join(calls.select("call_id"), "call_id", "left_semi").select("call_id", "after"))
    one, got = summed(calls, ["name", "arguments"], "calls"), summed(results, ["content"], "results")
    ident = one.join(got.hint("shuffle_hash"), "call_id", "full").join(topological_depth(after), "call_id", "left")
    ident = ident.withColumns({**{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_calls", "n_results")}, **{c: F.coalesce(c, F.lit(False)) for c in ("_many_calls", "_many_results")}})
    status = F.when(F.col("n_calls") == 0, "orphan").when(F.col("n_results") == 0, "unanswered").when(F.col("_many_calls") & F.col("_many_results"), "ambiguous").otherwise("answered")
    call, result = F.col("_calls"), F.col("_results.content")
    ident = stored(ident.select("call_id", call["name"].alias("name"), "depth", status.alias("status"), "n_calls", "n_results", call["arguments"].alias("arguments"), result.alias("content"), (F.col("n_calls") == 0).alias("_alone"), "_many_calls", "_many_results"))
    out = ident.where("not _many_calls and not _many_results")
    both = F.col("status") == "ambiguous"
    several = ident.where("_many_calls")
    if not several.isEmpty():
        out = out.unionByName(spread(calls, ["name", "arguments"], several.withColumn("content", F.when(~both, F.col("content"))).drop("name", "arguments")))
    several = ident.where("_many_results")
    if not several.isEmpty():
        lone = several.withColumns({"name": F.when(~both, F.col("name")), "arguments": F.when(~both, F.col("arguments")), "_alone": both | F.col("_alone")})
        out = out.unionByName(spread(results, ["content"], lone.drop("content")))
    out = out.withColumn("_v", F.try_parse_json("arguments"))
    errors = F.when(F.col("_alone"), F.array().cast("array<string>")).otherwise(argument_errors(F.coalesce("name", F.lit("")), F.col("_v"), schemas))
    message = F.struct(F.col("_v").alias("arguments"), F.col("call_id").alias("call"), "depth", "name", F.col("content").alias("result"), "status")
    return out.select("call_id", "name", "depth", "status", "n_calls", "n_results", errors.alias("errors"), F.to_json(message).alias("json"))


_TURN = {
    "meta": {"type": "object", "properties": {"chars": {"type": "integer", "minimum": 0}, "role": {"type": "string", "enum": ["user"]}}, "required": ["chars", "role"], "additionalProperties": False},
    "text": {"type": "string", "minLength": 1, "maxLength": 300},
    "turn": {"type": "integer", "minimum": 0},
}
#: What a turn of a conversation is called with. "open" starts a chain, "continue" follows the call two turns before, and
#: "compare" (turn 4) those two and four turns before.
TURN_SCHEMAS: Schemas = {
    "open": {"type": "object", "properties": _TURN, "required": ["meta", "text", "turn"], "additionalProperties": False},
    "continue": {"type": "object", "properties": {**_TURN, "previous": {"type": "integer", "minimum": 0}}, "required": ["meta", "previous", "text", "turn"], "additionalProperties": False},
    "compare": {"type": "object", "properties": {**_TURN, "previous": {"type": "array", "items": {"type": "integer"}, "minItems": 2}}, "required": ["meta", "previous", "text", "turn"], "additionalProperties": False},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, edges) of a conversation table: a user's turn calls, the assistant's next turn is the result.

    conversations holds faultless turns, so faults are made from the length n of a turn's text: a divisor 11 leaves out the
    text, 13 writes the turn as text, 17 names no tool, 19 makes no call, 23 names another role, 29 adds a key, 31 gives no
    object.
    """
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    n = F.length(F.coalesce("text", F.lit("")))
    fault = lambda d: n % d == 0
    users = turns.where("role = 'user'").where(~fault(19))
    name = F.when(fault(17), "resume").when(F.col("turn") < 2, "open").when(F.col("turn") == 4, "compare").otherwise("continue")

    def given(turn: Column) -> Column:
        meta = F.struct(n.alias("chars"), F.when(fault(23), "guest").otherwise("user").alias("role"))
        many = F.when(F.col("turn") == 4, F.array(F.col("turn") - 2, F.col("turn") - 4))
        one = F.when((F.col("turn") >= 2) & (F.col("turn") != 4), F.col("turn") - 2)
        previous = F.coalesce(F.to_variant_object(many), one.cast("variant"))
        return F.to_json(F.struct(meta.alias("meta"), F.when(fault(29), "odd").alias("mood"), previous.alias("previous"), F.when(~fault(11), F.coalesce("text", F.lit(""))).alias("text"), turn.alias("turn")))

    arguments = F.when(fault(31), "[1]").when(fault(13), given(F.col("turn").cast("string"))).otherwise(given(F.col("turn")))
    back = F.when(F.col("turn") == 4, F.array(F.lit(2), F.lit(4))).when(F.col("turn") >= 2, F.array(F.lit(2)))
    edges = users.select(ident(0).alias("call_id"), F.explode(back).alias("b"), "conv_id", "turn").select("call_id", ident(F.col("b")).alias("after"))
    calls = users.select(ident(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    return calls, turns.where("role = 'assistant'").select(ident(1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content")), edges


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of link_calls over conversation_calls, with length and MD5 of the JSON in its place."""
    calls, results, edges = conversation_calls(table(spark, sf_dir, "conversations"))
    out = link_calls(calls, results, TURN_SCHEMAS, edges)
    return out.select("call_id", "name", "depth", "status", "n_calls", "n_results", F.array_join("errors", ";").alias("errors"), F.length("json").cast("long").alias("json_chars"), F.md5("json").alias("json_md5"))
