"""Text columns with a layout: split once or many times, delimited records, records by prefix, tagged fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_once(value: Column, how: str, at) -> Column:
    """struct(head, tail). how: "lines" or "columns" (a count), "delimiter", "starting" (a line that starts so) or
    "containing" (a line that contains it). Without a place to split, all is head."""
    if how == "columns":
        head = F.left(value, F.lit(at))
    elif how == "delimiter":
        where = F.instr(value, at)
        return F.struct(F.when(where > 0, F.substring(value, F.lit(1), where - 1)).otherwise(value).alias("head"), F.when(where > 0, F.substring(value, where + len(at), F.length(value))).otherwise("").alias("tail"))
    elif how == "lines":
        head = F.regexp_extract(value, rf"^((?:[^\n]*(?:\n|$)){{0,{at}}})", 1)
    else:
        inside = "" if how == "starting" else r"[^\n]*"
        found = F.regexp_extract(value, rf"(?s)^(.*?)(?:(?<=\n)|^)(?-s:{inside}{re.escape(at)})", 1)
        has = value.rlike(rf"(?m)^{inside}{re.escape(at)}")
        head = F.when(has, found).otherwise(value)
    return F.struct(head.alias("head"), F.substring(value, F.length(head) + 1, F.length(value)).alias("tail"))


def split_many(value: Column, how: str, at) -> Column:
    """Array of parts. how: "delimiter" (literal), "starting" (lines that start so begin a part) or "lines" (n a part)."""
    if how == "delimiter":
        return F.split(value, f"\\Q{at}\\E", -1)
    if how == "starting":
        return F.split(value, rf"\n(?=\Q{at}\E)", -1)
    lines = F.split(value, "\n", -1)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / at).cast("int")), lambda i: F.array_join(F.slice(lines, i * at + 1, at), "\n"))


def exploded(df: DataFrame, parts: Column, name: str, number: str) -> DataFrame:
    """One row per part, numbered from 1."""
    return df.select("*", F.posexplode(parts).alias("_i", name)).withColumn(number, F.col("_i") + 1).drop("_i")


def delimited_records(df: DataFrame, column: str, schema: str, record_sep: str = "\n", field_sep: str = ",", quote: str = '"', escape: str = "\\") -> DataFrame:
    """Rows of a text column that holds delimited records in its own dialect."""
    rows = exploded(df, F.filter(split_many(F.col(column), "delimiter", record_sep), lambda r: r != ""), "_record", "record_number")
    return rows.withColumn("record", F.from_csv("_record", schema, {"sep": field_sep, "quote": quote, "escape": escape, "mode": "FAILFAST"})).drop("_record")


def trimmed(value: Column, kind: str, side: str = "both", chars: str = " ") -> Column:
    """A typed leaf without the trim characters on its side."""
    cut = {"left": F.ltrim, "right": F.rtrim, "both": F.btrim}[side]
    return cut(value, F.lit(chars)).cast(kind)


def switch_route(df: DataFrame, value: Column, arms: dict[str, tuple[str, str]], mode: str = "first", default: str | None = None, name: str = "route") -> DataFrame:
    """Routes text to the first arm that matches, or to every one (mode "all"). An arm is ("prefix" or "regex", test)."""
    tests = {arm: value.startswith(t) if how == "prefix" else value.rlike(t) for arm, (how, t) in arms.items()}
    if mode == "first":
        return df.withColumn(name, F.coalesce(*[F.when(t, arm) for arm, t in tests.items()], F.lit(default).cast("string")))
    hits = F.array_compact(F.array(*[F.when(t, arm) for arm, t in tests.items()]))
    hits = F.when((F.size(hits) == 0) & F.lit(default is not None), F.array(F.lit(default).cast("string"))).otherwise(hits)
    return df.withColumn(name, F.explode(hits))


def records_by_prefix(lines: DataFrame, column: str, layouts: dict[str, list[tuple[str, int, int]]]) -> dict[str, DataFrame]:
    """One table per kind of record: the kind is the line's prefix, fields are (name, start, length), trimmed."""
    return {p: lines.where(F.col(column).startswith(p)).select(*[F.trim(F.substring(column, s, n)).alias(f) for f, s, n in fields]) for p, fields in layouts.items()}


def tagged_fields(df: DataFrame, column: str) -> DataFrame:
    """(place, tag, value) of every ':tag:value' field; a value runs to the next tag."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(column)), r"\n(?=:\w+:)", -1), lambda p: p.rlike(r"^:\w+:"))
    out = exploded(df, parts, "_field", "place")
    return out.withColumns({"tag": F.regexp_extract("_field", r"^:(\w+):", 1), "value": F.regexp_extract("_field", r"(?s)^:\w+:(.*)$", 1)}).drop("_field")


def compact_lexical(value: Column, kind: str) -> Column:
    """ISO text without separators: "date8", "date6", "time4" or "time6"."""
    digits = F.regexp_replace(value, "[-:]", "")
    return {"date8": F.left(digits, F.lit(8)), "date6": F.substring(digits, 3, 6), "time4": F.left(digits, F.lit(4)), "time6": F.left(digits, F.lit(6))}[kind]


def implied_decimal(value: Column, places: int) -> Column:
    """A number whose last digits are its decimals."""
    return value.cast("double") / F.lit(float(10**places))


#: A step from a text to a part of it: ("head" or "tail", how, at) of a split_once, ("part", how, at, n) of a split_many,
#: ("field", separator, n) of a record, ("cells", start, length), ("trim", side, characters).
LayoutStep = tuple


def layout_field(value: Column, steps: list[LayoutStep], kind: str = "string") -> Column:
    """One scalar of a text that follows a layout, cast to its type: null for null, and an error where the text has no such
    part. Places count from 1."""
    out = value
    for step, *args in steps:
        if step in ("head", "tail"):
            out = split_once(out, *args)[step]
        elif step == "part":
            how, at, n = args
            out = F.get(split_many(out, how, at), F.lit(n - 1))
        elif step == "field":
            sep, n = args
            out = F.get(split_many(out, "delimiter", sep), F.lit(n - 1))
        elif step == "cells":
            start, length = args
            out = F.when(F.length(out) >= start, F.substring(out, start, length))
        elif step == "trim":
            side, chars = args
            out = trimmed(out, "string", side, chars)
        else:
            raise ValueError(f"unknown step {step}")
    missing = F.raise_error(F.lit("the text does not follow the layout")).cast("string")
    return F.when(value.isNotNull(), F.coalesce(out, missing)).cast(kind)
