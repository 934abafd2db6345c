"""Argument checks against a plain JSON Schema validator."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import tool_calls

SCHEMAS = [
    {"type": "integer"},
    {"type": "number", "minimum": 1, "exclusiveMaximum": 5},
    {"type": ["string", "null"], "minLength": 2},
    {"type": "null"},
    {"enum": [1, "1", True, None]},
    {"enum": ["a", "b"]},
    {"const": 2},
    {"type": "string", "pattern": "^x"},
    {"pattern": "^x", "maxLength": 3},
    {"minimum": 2, "exclusiveMinimum": 2},
    {"type": "array", "items": {"type": "integer"}, "minItems": 1, "maxItems": 2},
    {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a", "b"], "additionalProperties": False},
    {"properties": {"a": {"type": ["integer", "null"]}}},
    {"type": "boolean"},
]
VALUES = [1, 2, 1.0, 1e20, 1.5, 5, -3, 0, "1", "a", "x", "xyz!", "", None, True, False, [], [1], [1, 2.0, 3], ["a"], [1.5], {}, {"a": 1}, {"a": None, "b": 2}, {"a": 1.0, "b": None}, {"a": "x", "b": 1, "c": 2}, 2**53 + 1]


def kinds(v):
    if isinstance(v, bool):
        return {"boolean"}
    if isinstance(v, (int, float)):
        return {"number", "integer"} if v == int(v) else {"number"}
    return {type(None): {"null"}, str: {"string"}, list: {"array"}, dict: {"object"}}[type(v)]


def same(a, b):
    return kinds(a) & kinds(b) and a == b and isinstance(a, bool) == isinstance(b, bool)


def valid(v, s):
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    number, text, items = (v if kinds(v) & {k} else None for k in ("number", "string", "array"))
    return not (
        (types and not kinds(v) & set(types))
        or ("enum" in s and not any(same(v, x) for x in s["enum"]))
        or ("const" in s and not same(v, s["const"]))
        or (number is not None and not (s.get("minimum", number) <= number <= s.get("maximum", number) and ("exclusiveMinimum" not in s or number > s["exclusiveMinimum"]) and ("exclusiveMaximum" not in s or number < s["exclusiveMaximum"])))
        or (text is not None and not (s.get("minLength", 0) <= len(text) <= s.get("maxLength", len(text)) and re.search(s.get("pattern", ""), text)))
        or (items is not None and not (s.get("minItems", 0) <= len(items) <= s.get("maxItems", len(items)) and all(valid(x, s.get("items", {})) for x in items)))
        or (isinstance(v, dict) and (not set(s.get("required", [])) <= set(v) or (s.get("additionalProperties") is False and not set(v) <= set(s.get("properties", {}))) or not all(valid(v[k], p) for k, p in s.get("properties", {}).items() if k in v)))
    )


def test_values_against_schemas(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, t string").withColumn("v", F.parse_json("t"))
    for schema in SCHEMAS:
        errors = F.array_compact(F.array(*tool_calls.value_errors(F.col("v"), schema, "")))
        unknown = F.flatten(F.array(*tool_calls.unknown_keys(F.col("v"), schema, ""), F.array().cast("array<string>")))
        got = {r["i"]: r["fine"] for r in df.select("i", ((F.size(errors) == 0) & (F.size(unknown) == 0)).alias("fine")).collect()}
        assert {json.dumps(VALUES[i]): f for i, f in got.items()} == {json.dumps(v): valid(v, schema) for v in VALUES}, schema


@pytest.mark.parametrize("schema", [{"anyOf": []}, {"properties": {"a": {"uniqueItems": True}}}, {"additionalProperties": {"type": "string"}}, {"enum": [[1]]}])
def test_what_is_not_checked_is_refused(spark, schema):
    with pytest.raises(ValueError):
        tool_calls.value_errors(F.col("v"), schema, "")
