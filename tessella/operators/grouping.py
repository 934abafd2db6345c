"""Reducers over items, and the five ways to group: by key, by adjacent key, from a start, to an end, in blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import NUMERIC
from tessella.ordinal import checkpointed, running_count, with_ordinal


def numeric(value: Column, kind: str) -> Column:
    """What a reducer counts: numbers as they are, text that reads as a number, nothing else."""
    return F.when(value.rlike(NUMERIC), F.trim(value).try_cast("double")) if kind == "string" else value


def item_count() -> Column:
    """Items, nulls included."""
    return F.count(F.lit(1))


def item_sum(value) -> Column:
    """The exact sum of whole numbers: 0 without items, an overflow is an error. totals() sums floats."""
    return F.coalesce(F.sum(F.col(value) if isinstance(value, str) else value), F.lit(0))


def string_join(value, order_by: list, sep: str = "") -> Column:
    """Texts in order, nulls skipped; "" without items."""
    value = F.col(value) if isinstance(value, str) else value
    items = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*order_by, value.cast("string").alias("_v")))))
    return F.array_join(F.transform(items, lambda x: x["_v"]), sep)


def same_keys(keys: list[str], other: str = "_key_") -> Column:
    """Equality of columns with those of the same names behind a prefix; null equals null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(other + k)) for k in keys])


def beside(df: DataFrame, keys: list[str], more: DataFrame) -> DataFrame:
    """Rows of df with the other columns of `more`, a row per key; null is a key."""
    keyed = more.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return df.join(keyed, same_keys(keys), "left").drop(*[f"_key_{k}" for k in keys])


def item_at(df: DataFrame, keys: list[str], value: str, order_by: list, n: int, name: str) -> DataFrame:
    """(keys, name) per group: the n-th value in order, null outside the range. Of a group no more than its first n rows
    are kept on the way, whatever its size."""
    groups = df.select(*keys).distinct()
    if n < 1:
        return groups.withColumn(name, F.lit(None).cast(df.schema[value].dataType))
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where(F.col("_place") <= n)
    return beside(groups, keys, placed.where(F.col("_place") == n).select(*keys, F.col(value).alias(name)))


def group_by(df: DataFrame, keys: list[str], totals: dict[str, Column], order_by: list[str], number: str | None = None) -> DataFrame:
    """One row per key (null is a key), with `first_seen`: the least order of its members, by which groups are ordered, and
    the group's 1-based number if a name for it is given."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()], F.min(F.struct(*order_by)).alias("first_seen"))
    return with_ordinal(out, ["first_seen"], number) if number else out


def with_group_total(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Every row beside the totals of its group (null is a key), aggregated before they are joined back, so that a large group is no
    window of one task."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return beside(df.drop(*totals), keys, sums)


#: Rows up to which a group is ordered in one task. The way beyond gives the same result.
LARGE_GROUP = 1 << 20


def by_group_size(df: DataFrame, within: list[str], one_task: Callable, spread: Callable) -> DataFrame:
    """one_task(rows of groups of up to LARGE_GROUP rows) and spread(rows of larger ones). Sizes are counted first, combined
    before the shuffle. Without `within` the whole table is spread."""
    if not within:
        return spread(df)
    large = checkpointed(df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE_GROUP).select(*within, F.lit(True).alias("_large")))
    if large.isEmpty():
        return one_task(df)
    marked = beside(df, within, large)
    return one_task(marked.where(F.col("_large").isNull()).drop("_large")).unionByName(spread(marked.where("_large").drop("_large")))


def placed(df: DataFrame, order_by: list, within: list[str], name: str, count: str | None = None) -> DataFrame:
    """Adds the 1-based place of each row in its group (null is a key), and the group's size if a name for it is given. Places
    in a large group come from a dense ordinal, so that it is spread over many tasks."""
    w = Window.partitionBy(*within)
    totals = [F.min("_ord").alias("_least"), *([F.count(F.lit(1)).alias(count)] if count else [])]

    def one_task(rows: DataFrame) -> DataFrame:
        out = rows.withColumn(name, F.row_number().over(w.orderBy(*order_by)).cast("long"))
        return out.withColumn(count, F.count(F.lit(1)).over(w)) if count else out

    def spread(rows: DataFrame) -> DataFrame:
        rows = with_ordinal(rows, [*within, *order_by], "_ord")
        return beside(rows, within, rows.groupBy(*within).agg(*totals)).withColumn(name, F.col("_ord") - F.col("_least") + 1).drop("_ord", "_least")

    return by_group_size(df, within, one_task, spread)


def flags_so_far(rows: DataFrame, flag: str, within: list[str], name: str, itself: bool = True) -> DataFrame:
    """How many rows of the same group up to this one (or before it) have the flag, along a dense ordinal `_ord` that runs
    group by group. Counted over the whole table in blocks; what stood before a group's first row is taken off."""
    rows = running_count(rows, flag, "_ord", "_all")
    before = F.col("_all") - F.col(flag).cast("long")
    if within:
        rows = beside(rows, within, rows.groupBy(*within).agg(F.min(before).alias("_off")))
    so_far = F.col("_all") if itself else before
    return rows.withColumn(name, so_far - F.col("_off") if within else so_far).drop("_all", "_off")


def group_adjacent(df: DataFrame, key: str, order_by: list[str], within: list[str], name: str = "run") -> DataFrame:
    """Contiguous runs of equal keys; a key that comes again later is another run. In a large group the row before comes by
    a join on the dense ordinal."""
    w = Window.partitionBy(*within).orderBy(*order_by)

    def one_task(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("_first", (F.row_number().over(w) == 1) | ~F.col(key).eqNullSafe(F.lag(key).over(w)))
        return marked.withColumn(name, F.sum(F.col("_first").cast("long")).over(w)).drop("_first")

    def spread(rows: DataFrame) -> DataFrame:
        rows = with_ordinal(rows, [*within, *order_by], "_ord")
        before = rows.select((F.col("_ord") + 1).alias("_ord"), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*within, key])]).alias("_before"))
        same = [F.col(c).eqNullSafe(F.col("_before")[f"_{i}"]) for i, c in enumerate([*within, key])]
        marked = rows.join(before, "_ord", "left").withColumn("_first", F.col("_before").isNull() | ~reduce(lambda a, b: a & b, same))
        return flags_so_far(marked, "_first", within, name).drop("_first", "_before", "_ord")

    return by_group_size(df, within, one_task, spread)


def group_adjacent_global(df: DataFrame, key: str, order_by: list[str], name: str = "run") -> DataFrame:
    """Runs over the whole table."""
    return group_adjacent(df, key, order_by, [], name)


def group_starting_with(df: DataFrame, predicate: Column, order_by: list[str], within: list[str], name: str = "run", itself: bool = True) -> DataFrame:
    """A group begins at each true (after it, if it is not to count itself); what leads is group 0."""
    w = Window.partitionBy(*within).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    flagged = df.withColumn("_flag", F.coalesce(predicate, F.lit(False)))
    one_task = lambda rows: rows.withColumn(name, F.coalesce(F.sum(F.col("_flag").cast("long")).over(w), F.lit(0)))
    spread = lambda rows: flags_so_far(with_ordinal(rows, [*within, *order_by], "_ord"), "_flag", within, name, itself).drop("_ord")
    return by_group_size(flagged, within, one_task, spread).drop("_flag")


def group_ending_with(df: DataFrame, predicate: Column, order_by: list[str], within: list[str], name: str = "run") -> DataFrame:
    """A group ends after each true; what trails is a group of its own."""
    return group_starting_with(df, predicate, order_by, within, name, itself=False)


def group_into_blocks(df: DataFrame, size: int, order_by: list[str], within: list[str] | None = None, name: str = "block") -> DataFrame:
    """Chunks of `size` rows in order, numbered from 0, in each group or over the whole table."""
    if size <= 0:
        raise ValueError("a block needs at least one item")
    rows = placed(df, order_by, within, "_place") if within else with_ordinal(df, order_by, "_place")
    return rows.withColumn(name, F.floor((F.col("_place") - 1) / size)).drop("_place")


def first_member(fields: list[str], order_by: list[str]) -> Column:
    """Plain bindings of a group read its first member."""
    return F.min_by(F.struct(*fields), F.struct(*order_by))


def distinct_values(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each distinct key."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_x")) if rest else df.select(*keys).distinct()
    return out.select(*[F.col("_x")[c].alias(c) if c in rest else F.col(c) for c in df.columns]) if rest else out


def one_mode(**modes) -> str:
    """The one grouping mode that is given; two at once are an error."""
    given = [k for k, v in modes.items() if v is not None]
    if len(given) != 1:
        raise ValueError(f"one grouping mode, not {given}")
    return given[0]


def group_rows(df: DataFrame, order_by: list[str], within: list[str], name: str = "group", *, by: list[str] | None = None, adjacent: str | None = None, starting: Column | None = None, ending: Column | None = None, block: int | None = None) -> DataFrame:
    """Numbers the groups of each partition by exactly one mode: equal keys (in the order of their first member), adjacent
    equal keys, from a start, to an end, or blocks."""
    mode = one_mode(by=by, adjacent=adjacent, starting=starting, ending=ending, block=block)
    if mode == "by":
        first = df.groupBy(*within, *by).agg(F.min(F.struct(*order_by)).alias("_first"))
        numbered = placed(first, ["_first"], within, name).drop("_first") if within else with_ordinal(first, ["_first"], name).drop("_first")
        return beside(df, [*within, *by], numbered)
    made = {"adjacent": lambda: group_adjacent(df, adjacent, order_by, within, name), "starting": lambda: group_starting_with(df, starting, order_by, within, name), "ending": lambda: group_ending_with(df, ending, order_by, within, name), "block": lambda: group_into_blocks(df, block, order_by, within, name)}
    return made[mode]()


def any_member(df: DataFrame, keys: list[str], predicate: Column, totals: dict[str, Column]) -> DataFrame:
    """Groups of which any member passes."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()], F.bool_or(F.coalesce(predicate, F.lit(False))).alias("_any"))
    return out.where("_any").drop("_any")
