"""Data quality: rules over a table give a table of violations (key, rule, detail); enforce() fails a job that has any."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name -> (does the row pass, detail of a violation).
Rules = dict[str, tuple[Column, Column]]


class Violation(ValueError):
    """A rule that must hold does not."""


def check(df: DataFrame, key: list[str], rules: Rules) -> DataFrame:
    """One row per broken rule and row, in one pass over the table. A condition that is null passes."""
    hits = F.array_compact(F.array(*[F.when(~ok, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (ok, detail) in rules.items()]))
    return df.select(*key, F.explode(hits).alias("v")).select(*key, "v.rule", "v.detail")


def enforce(df: DataFrame, key: list[str], rules: Rules, order_by: list[str] | None = None) -> DataFrame:
    """The table itself, after an action that finds no violation; the first one in order is the error's message."""
    first = check(df, key, rules).orderBy(*(order_by or key)).limit(1).collect()
    if first:
        raise Violation(f"{first[0]['rule']}: {first[0].asDict()}")
    return df


class FailureRule:
    """A rule that a job must not start against: raises with the message of the first offending row of `df`. mode: "true" or
    "false" (when the condition is so), or "all" (when there is any row). A null condition offends too."""

    def __init__(self, df: DataFrame, condition: Column | None, message: Column, order_by: list[str], mode: str = "true"):
        if mode not in ("true", "false", "all"):
            raise ValueError(mode)
        self.df, self.order_by, self.message = df, order_by, message
        self.offends = F.lit(True) if mode == "all" else condition.isNull() | (condition == F.lit(mode == "true"))
        self.shown = message if mode == "all" else F.when(condition.isNull(), F.lit("the condition is null")).otherwise(message)

    def least(self) -> Column:
        """The message of the first offending row as an aggregate, (message) or null; combined before any shuffle."""
        shown = F.struct(F.coalesce(self.shown.cast("string"), F.lit("")).alias("m"))
        return F.min_by(F.when(self.offends, shown), F.when(self.offends, F.struct(*self.order_by)))


def check_failures(rules: list[FailureRule]) -> None:
    """All failure rules in one job, before anything is written: the first rule that any row offends gives the error. Rules
    over one table share a pass over it."""
    tables: dict[int, list[int]] = {}
    for i, rule in enumerate(rules):
        tables.setdefault(id(rule.df), []).append(i)
    found = None
    for places in tables.values():
        row = rules[places[0]].df.agg(*[rules[i].least().alias(f"_r{i}") for i in places])
        hits = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"_r{i}").alias("hit")) for i in places])).alias("x")).select("x.*").where("hit is not null")
        found = hits if found is None else found.unionByName(hits)
    first = found.orderBy("rule").limit(1).collect() if found is not None else []
    if first:
        raise Violation(f"rule {first[0]['rule'] + 1}: {first[0]['hit']['m']}")


def fail_when(df: DataFrame, condition: Column, message: Column, order_by: list[str], mode: str = "true") -> None:
    """One failure rule by itself: raises with its bare message."""
    row = df.agg(FailureRule(df, condition, message, order_by, mode).least().alias("hit")).first()
    if row["hit"] is not None:
        raise Violation(row["hit"]["m"])


def required(entries: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.map_contains_key(entries, n) for n in names])


def closed(entries: Column, declared: list[str]) -> Column:
    """No name beyond the declared ones."""
    return F.size(F.array_except(F.map_keys(entries), F.array(*map(F.lit, declared)))) == 0


def dependent_required(entries: Column, trigger: str, names: list[str]) -> Column:
    return ~F.map_contains_key(entries, trigger) | required(entries, names)


def dependent_schema(entries: Column, trigger: str, predicate: Column) -> Column:
    return ~F.map_contains_key(entries, trigger) | predicate


def property_count(entries: Column, low: int = 0, high: int | None = None) -> Column:
    n = F.size(F.map_keys(entries))
    return (n >= low) & (F.lit(True) if high is None else n <= high)


def property_names(entries: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.forall(F.map_keys(entries), predicate)


def pattern_properties(entries: Column, declared: list[str], pattern: str) -> Column:
    """Every name beyond the declared ones matches the pattern."""
    return F.forall(F.map_keys(entries), lambda k: k.isin(*declared) | k.rlike(pattern))


def fixed(value: Column, literal) -> Column:
    return value == F.lit(literal)


def enumerated(value: Column, *allowed) -> Column:
    return value.isin(*allowed)


def in_range(value: Column, low=None, high=None, open_low: bool = False, open_high: bool = False) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((value > low) if open_low else (value >= low))
    if high is not None:
        ok = ok & ((value < high) if open_high else (value <= high))
    return ok


def multiple_of(value: Column, *divisors: str) -> Column:
    """A multiple of any of the divisors (given as text): of decimals where the value fits one, of floats elsewhere."""
    exact = value.cast("string").try_cast("decimal(38,10)")
    one = lambda d: F.coalesce(exact % F.lit(d).cast("decimal(20,10)") == 0, value.cast("double") % float(d) == 0)
    return reduce(lambda a, b: a | b, [one(d) for d in divisors])


def text_length(value: Column, low: int = 0, high: int | None = None) -> Column:
    return in_range(F.length(value), low, high)


def text_pattern(value: Column, *patterns: str) -> Column:
    """Any of the patterns is found."""
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in patterns])


def item_count(array: Column, low: int = 0, high: int | None = None) -> Column:
    return in_range(F.size(array), low, high)


def contains_items(array: Column, predicate: Callable[[Column], Column], low: int = 1, high: int | None = None) -> Column:
    return in_range(F.size(F.filter(array, predicate)), low, high)


def unique_items(array: Column) -> Column:
    return F.size(F.array_distinct(array)) == F.size(array)


def canonical_items(arrays: pd.Series) -> pd.Series:
    """The items of JSON arrays in one form each: object names in order, numbers by their exact value. Null for no array."""

    def form(value) -> str:
        if isinstance(value, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{form(value[k])}" for k in sorted(value)) + "}"
        if isinstance(value, list):
            return "[" + ",".join(map(form, value)) + "]"
        if isinstance(value, Decimal):
            sign, digits, power = value.as_tuple()
            shown = "".join(map(str, digits)).lstrip("0")
            kept = shown.rstrip("0")
            return f"{'-' if sign else ''}{kept}e{power + len(shown) - len(kept)}" if kept else "0"
        return json.dumps(value)

    def items(text: str | None) -> list[str] | None:
        # JSON knows no NaN or Infinity.
        value = None if text is None else json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=lambda c: json.loads(""))
        return [form(v) for v in value] if isinstance(value, list) else None

    return arrays.map(items, na_action=None)


def unique_json_items(array: Column) -> Column:
    """No two items of a JSON array (as text) are equal, whatever is in them: objects are equal in any order of names, numbers by
    value. What is no array passes; text that is no JSON is an error."""
    items = F.pandas_udf(canonical_items, T.ArrayType(T.StringType()))(array)
    return F.coalesce(F.size(F.array_distinct(items)) == F.size(items), F.lit(True))


def alternatives(*matches: Column, exclusive: bool = True) -> Column:
    """Exactly one, or at least one, holds."""
    n = reduce(lambda a, b: a + b, [F.coalesce(m, F.lit(False)).cast("int") for m in matches])
    return n == 1 if exclusive else n >= 1


def json_type(value: Column, kinds: tuple[str, ...], nullable: bool = False) -> Column:
    """A JSON value (variant) has one of the types as schema_of_variant names them."""
    found = F.schema_of_variant(value)
    return F.coalesce(found.isin(*kinds) | (F.lit(nullable) & (found == "VOID")), F.lit(nullable))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that come more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def value_issues(df: DataFrame, key: list[str], lengths: dict[str, tuple[int, int]], codes: dict[str, list[str]]) -> DataFrame:
    """Length bounds and code lists on values that are present: one row per issue, with its column."""
    rules: Rules = {f"length of {c}": (F.coalesce(F.length(c).between(*b), F.lit(True)), F.col(c)) for c, b in lengths.items()}
    rules |= {f"code of {c}": (F.coalesce(F.col(c).isin(*v), F.lit(True)), F.col(c)) for c, v in codes.items()}
    return check(df, key, rules)
