"""Generated sequences as array columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import as_column, flagged

#: Most items that one generated sequence may have.
LIMIT = 1_000_000


def tokenize(value, delimiter: str) -> Column:
    """Parts between literal delimiters, empties kept; null has none."""
    if not delimiter:
        raise ValueError("an empty delimiter")
    parts = F.split(as_column(value), re.escape(delimiter).replace("/", "\\/"), -1)
    return F.coalesce(parts, F.array().cast("array<string>"))


def tokenize_by_length(value, n: int) -> Column:
    """Chunks of n characters, the last may be shorter."""
    if n <= 0:
        raise ValueError("chunks need a length")
    value = F.coalesce(as_column(value), F.lit(""))
    starts = F.when(F.length(value) > 0, F.sequence(F.lit(0), F.floor((F.length(value) - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(value, i * n + 1, F.lit(n)))


def tokenize_regex(value, pattern: str, flags: str = "") -> Column:
    """Parts between matches; "" and null have none."""
    value = as_column(value)
    parts = F.split(value, flagged(pattern, flags, may_be_empty=False), -1)
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def generate(start, stop) -> Column:
    """start to stop inclusive; none if start is greater; beyond LIMIT items an error."""
    a, b = as_column(start).cast("long"), as_column(stop).cast("long")
    many = F.raise_error(F.lit("a sequence has over 1,000,000 items")).cast("array<bigint>")
    return F.when(b - a >= LIMIT, many).when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def sequence_exists(items: Column, predicate) -> Column:
    return F.exists(items, predicate)


def sequence_item_at(items: Column, n: int) -> Column:
    return F.get(items, F.lit(n - 1)) if n >= 1 else F.lit(None)


def sequence_aggregate(kind: str, items: Column, where=None, value=None, sep: str = "") -> Column:
    """count, sum, avg, min, max or string_join over the items that pass, each mapped by value(item, 1-based place)."""
    kept = F.filter(items, where) if where is not None else items
    made = F.transform(kept, lambda x, i: value(x, i + 1)) if value is not None else kept
    if kind == "count":
        return F.size(made)
    if kind == "string_join":
        return F.array_join(made, sep)
    if kind in ("min", "max"):
        return F.array_min(made) if kind == "min" else F.array_max(made)
    numbers = F.array_compact(F.transform(made, lambda x: x.cast("double")))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)
    return total if kind == "sum" else F.when(F.size(numbers) > 0, total / F.size(numbers))
