"""Comparisons and presence. They are two-valued: whatever is compared with null is false, even not_equal."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import as_column, text


def settled(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compared(a, b, test: Callable[[Column, Column], Column]) -> Column:
    """Numbers are widened; text beside anything else is compared as text. The types are known when the plan is made, so
    only one of the branches is left in it."""
    a, b = as_column(a), as_column(b)
    worded = (F.typeof(a) == "string") | (F.typeof(b) == "string")
    return settled(F.when(worded, test(text(a), text(b))).otherwise(test(a, b)))


def equal(a, b) -> Column:
    return compared(a, b, operator.eq)


def not_equal(a, b) -> Column:
    return compared(a, b, operator.ne)


def less_than(a, b) -> Column:
    return compared(a, b, operator.lt)


def greater_than(a, b) -> Column:
    return compared(a, b, operator.gt)


def less_or_equal(a, b) -> Column:
    return compared(a, b, operator.le)


def greater_or_equal(a, b) -> Column:
    return compared(a, b, operator.ge)


def between(value, low, high) -> Column:
    return greater_or_equal(value, low) & less_or_equal(value, high)


def one_of(value, *options) -> Column:
    """Equal to any of the options, each compared as equal() does: text beside anything else as text."""
    texts = [o for o in options if isinstance(o, str)]
    tests = [equal(value, o) for o in options if not isinstance(o, str)]
    return any_of(*([settled(text(value).isin(*texts))] if texts else []), *tests) if options else F.lit(False)


def none_of(value, *options) -> Column:
    """False for null."""
    return as_column(value).isNotNull() & ~one_of(value, *options)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def negated(condition: Column) -> Column:
    return ~condition


def exists(value, nil: Column | None = None) -> Column:
    """Not null; an explicit nil (its sidecar column) counts as present."""
    present = as_column(value).isNotNull()
    return present if nil is None else present | settled(nil)


def substitute_missing(value, other) -> Column:
    return F.coalesce(as_column(value), as_column(other))


def substitute_missing_with_nil(value, nil: Column | None = None) -> Column:
    """The nil sidecar of the result: set where the value is null."""
    return as_column(value).isNull() if nil is None else as_column(value).isNull() | settled(nil)


def is_nil(nil: Column) -> Column:
    return settled(nil)


def choose(condition: Column, yes, no) -> Column:
    """Only the chosen branch is evaluated. A null condition is an error."""
    checked = F.coalesce(condition, F.raise_error(F.lit("the condition is null")).cast("boolean"))
    return F.when(checked, as_column(yes)).otherwise(as_column(no))


#: Text that is a truth value (fixed values).
TRUE, FALSE = ("true", "1"), ("false", "0")


def value_map_input(value: Column, kind: str) -> Column:
    """A value as the type that the entries of a map have: "string", "long", "double" or "boolean"; null where it is none.
    A float is a whole number only where that is exact; only text and truth values are truth values."""
    from_text, is_text = F.trim(text(value)), F.typeof(value) == "string"
    number = value.try_cast("double")
    if kind == "string":
        return F.when(F.coalesce(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False)) & ~is_text, F.lit(None)).otherwise(text(value))
    if kind == "boolean":
        known = F.when(from_text.isin(*TRUE), True).when(from_text.isin(*FALSE), False)
        return F.when(is_text, known).when(F.typeof(value) == "boolean", value.cast("string") == "true")
    is_truth = F.typeof(value) == "boolean"
    if kind == "long":
        exact = (number % 1 == 0) & (number >= float(-(2**63))) & (number < float(2**63))
        whole = F.when(F.typeof(value).isin("float", "double"), F.when(exact, number.try_cast("long"))).otherwise(value.try_cast("long"))
        return F.when(is_truth, F.lit(None)).when(is_text, F.when(from_text.rlike(r"^[+-]?\d+$"), from_text.try_cast("long"))).otherwise(whole)
    made = F.when(is_text, F.when(from_text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), from_text.try_cast("double"))).otherwise(number)
    return F.when(is_truth | (F.abs(made) == float("inf")) | F.isnan(made), F.lit(None)).otherwise(made)


#: Types of Python values that map entries have.
ENTRY_TYPES = {str: "string", bool: "boolean", int: "long", float: "double"}


def value_map(value, entries: dict, default=None, input_type: str | None = None) -> Column:
    """The entry of the value; a None key stands for null; a miss gives the default. input_type: "string", "long", "double" or
    "boolean", what the value is turned into first; what can't be turned, or has another type than the keys then, misses."""
    given = as_column(value)
    keys = {ENTRY_TYPES[type(k)] for k in entries if k is not None}
    if len(keys) > 1:
        raise ValueError("the keys of a map are of one type")
    value = value_map_input(given, input_type) if input_type else given
    pairs = [F.lit(x) for k, v in entries.items() if k is not None for x in (k, v)]
    found = F.lit(None)
    if pairs and (input_type is None or input_type in keys):
        found = F.try_element_at(F.create_map(*pairs), value)
    missed = F.coalesce(found, as_column(default))
    return F.when(given.isNull(), F.lit(entries[None])).otherwise(missed) if None in entries else missed
