"""Sorting and selecting by place. A sort is made stable by an ordinal as its last key."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.grouping import placed
from tessella.ordinal import with_ordinal

#: A selection by place: ("skip", n), ("first", n), ("last", n), ("from", p) or ("range", a, b).
Step = tuple


def sorted_by(df: DataFrame, keys: list[tuple[str, bool]], stable: str) -> DataFrame:
    """Keys with their directions (True: ascending); null is first ascending and last descending."""
    return df.orderBy(*[F.col(k).asc_nulls_first() if up else F.col(k).desc_nulls_last() for k, up in keys], stable)


def mixed_order(value: Column) -> list[Column]:
    """Sort keys for text of mixed content: missing, then booleans, then numbers (NaN last), then text. Whole numbers that are
    one and the same float are told apart by what the float leaves out."""
    number, whole, truth = value.try_cast("double"), F.trim(value).try_cast("long").cast("decimal(20,0)"), value.isin("true", "false")
    rank = F.when(value.isNull(), 0).when(truth, 1).when(number.isNotNull(), 2).otherwise(3)
    # 2^63 as a float is no long.
    shown = F.when(number >= float(2**63), F.lit(Decimal(2**63))).otherwise(number.try_cast("long").cast("decimal(20,0)"))
    return [rank, F.when(rank == 2, number), F.when(rank == 2, F.coalesce(whole - shown, F.lit(0).cast("decimal(20,0)"))), F.when(rank != 2, value)]


def bounds(steps: list[Step]) -> tuple[int, int | None, int | None]:
    """(first place, last place or None, rows from the end or None) of chained selections, folded at plan time. A `last`
    is only folded as the final step. Negative counts are 0."""
    lo, hi = 1, None
    for i, (kind, *args) in enumerate(steps):
        n = max(0, int(args[0]))
        if kind == "skip":
            lo += n
        elif kind == "first":
            hi = lo + n - 1 if hi is None else min(hi, lo + n - 1)
        elif kind == "from":
            lo += max(0, n - 1)
        elif kind == "range":
            end = lo + max(0, int(args[1])) - 1
            hi, lo = end if hi is None else min(hi, end), lo + max(0, n - 1)
        elif kind == "last":
            if i + 1 < len(steps):
                raise ValueError("last is the final step")
            return lo, hi, n
        else:
            raise ValueError(kind)
    return lo, hi, None


def select_rows(df: DataFrame, steps: list[Step], order_by: list, within: list[str] | None = None, number: str | None = None) -> DataFrame:
    """Rows of each group (or of the whole table) by place; `number` renumbers what is left from 1."""
    lo, hi, last = bounds(steps)
    if within and hi is not None and last is None:
        # Spark keeps no more than the first `hi` rows of a group on the way.
        out = df.withColumn("_place", F.row_number().over(Window.partitionBy(*within).orderBy(*order_by)).cast("long"))
    elif within:
        out = placed(df, order_by, within, "_place", "_count")
    else:
        out = with_ordinal(df, order_by, "_place")
        if last is not None:
            out = out.withColumn("_count", F.lit(out.count()))
    keep = F.col("_place") >= lo
    if hi is not None:
        keep = keep & (F.col("_place") <= hi)
    first = F.lit(lo)
    if last is not None:
        end = F.col("_count") if hi is None else F.least(F.col("_count"), F.lit(hi))
        keep = keep & (F.col("_place") > end - last)
        first = F.greatest(first, end - last + 1)
    out = out.where(keep)
    return (out.withColumn(number, F.col("_place") - first + 1) if number else out).drop("_place", "_count")


def top_rows(df: DataFrame, order_by: list, limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET."""
    return df.orderBy(*order_by).offset(offset).limit(limit) if offset else df.orderBy(*order_by).limit(limit)


def auto_number(order_by: list, start: int = 1, step: int = 1, restart_on: list[str] | None = None) -> Column:
    """start, start + step, ... within each of the restart columns' groups."""
    return F.lit(start) + (F.row_number().over(Window.partitionBy(*(restart_on or [])).orderBy(*order_by)) - 1) * step


def group_numbers(df: DataFrame, order_by: list[str], name: str = "group_number") -> DataFrame:
    """Ordinal of each row of a table of groups."""
    return with_ordinal(df, order_by, name)
