"""Inner equi-joins, first-match lookups, existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import text
from tessella.operators.grouping import beside


def keys_match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equality of key pairs; keys of different types compare as text. Null matches nothing."""
    on = F.lit(True)
    for a, b in pairs:
        same = left.schema[a].dataType == right.schema[b].dataType
        on = on & ((left[a] == right[b]) if same else (text(left[a]) == text(right[b])))
    return on


def inner_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every pair of rows whose keys are equal; duplicates stay."""
    return left.join(right, keys_match(left, right, pairs), "inner")


def join_chain(first: DataFrame, stages: list[tuple[DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """Left-deep joins; a stage's keys may come from any table before it."""
    for right, pairs in stages:
        first = inner_join(first, right, pairs)
    return first


def with_singleton(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row beside the fields of a single record, which is read once and sent along as literals. More than one record
    is an error."""
    rows = one.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("the singleton has more than one record")
    if not rows:
        return df.where(F.lit(False)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema])
    return df.select("*", *[F.lit(rows[0][f.name]).cast(f.dataType).alias(f.name) for f in one.schema])


#: Types whose values can be equal: any others are different things.
DOMAINS = [(T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)]


def comparable(a: T.DataType, b: T.DataType) -> bool:
    return a == b or any(isinstance(a, d) and isinstance(b, d) for d in DOMAINS)


def lookup(df: DataFrame, table: DataFrame, needle: list[tuple[str, str]], order_by: list[str], take: dict[str, str]) -> DataFrame:
    """For each row the first match in the order of `table`; a miss gives nulls and a null needle matches a null key. A needle
    of another type than its key (text, truth, whole number, float) only matches it where both are null.
    take: column of table -> name of the result."""
    item = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    keys = [k for _, k in needle]
    first = table.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min_by(item, F.struct(*order_by)).alias("_hit"))
    on = F.lit(True)
    for c, k in needle:
        same = comparable(df.schema[c].dataType, table.schema[k].dataType)
        on = on & (F.col(c).eqNullSafe(F.col(f"_key_{k}")) if same else F.isnull(c).eqNullSafe(F.lit(True)) & F.isnull(f"_key_{k}"))
    return df.join(first, on, "left").select(*df.columns, *[F.col("_hit")[n].alias(n) for n in take.values()])


def find_in(array, predicate, value) -> Column:
    """The value of the first item of a nested array that satisfies any predicate; null without one."""
    array = F.col(array) if isinstance(array, str) else array
    return F.try_element_at(F.transform(F.filter(array, predicate), value), F.lit(1))


def find(df: DataFrame, table: DataFrame, keys: list[tuple[str, str]], condition: Column, value: Column, order_by: list[str], into: str) -> DataFrame:
    """For each row of df the value of the first row of `table` with equal keys that also meets a condition over both.
    Equal rows of df are looked up once, and all of them stay. Without keys every pair of rows would have to be compared:
    ranges.find_in_range() finds first matches by inequality."""
    if not keys:
        raise ValueError("give pairs of equal keys, or use find_in_range")
    names = df.columns
    once = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    pairs = once.join(table, keys_match(once, table, keys) & condition, "left")
    found = pairs.groupBy(*[once[c] for c in names], "_n").agg(F.min_by(value, F.struct(*order_by)).alias(into))
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def with_match(df: DataFrame, table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.join(table, keys_match(df, table, pairs), "left_semi")


def without_match(df: DataFrame, table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.join(table, keys_match(df, table, pairs), "left_anti")


def enriched(primary: DataFrame, sources: dict[str, tuple[DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """Primary rows with the matching row of each named source as a struct column of that name; the primary's own columns
    keep their names, so they win a clash."""
    for name, (source, pairs) in sources.items():
        keys = [F.col(b).alias(f"_key_{i}") for i, (_, b) in enumerate(pairs)]
        keyed = source.select(*keys, F.struct("*").alias(name))
        on = F.lit(True)
        for i, (a, _) in enumerate(pairs):
            on = on & (primary[a] == F.col(f"_key_{i}"))
        primary = primary.join(keyed, on, "left").drop(*[f"_key_{i}" for i in range(len(pairs))])
    return primary


def join_totals(df: DataFrame, keys: list[str], joined: DataFrame, totals: dict[str, Column], empty: dict[str, object] | None = None) -> DataFrame:
    """Rows of df with aggregates over the tuples of a join, grouped by keys; groups without tuples get `empty`. Null is a key."""
    sums = joined.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return beside(df, keys, sums).fillna(empty or {})
