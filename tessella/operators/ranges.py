"""First matches by inequality, without comparing all pairs.

Values and bounds are replaced by their ranks among all distinct ones. Ranks are the leaves of a binary tree: an interval of
ranks is cut into at most two nodes of each level, and a value meets an interval at one of its ancestors. Each node keeps the
first row only, so no node grows with the rows; the upper levels, of at most 2^TOP nodes each, are broadcast, and below them a
node stands over few values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.ordinal import with_ordinal

#: Levels that are broadcast hold together at most 2^(TOP + 1) nodes, for each key if there are keys.
TOP = 14
#: A node is its level times 2^LEVEL plus its place.
LEVEL = 56


def node(level: Column, place: Column) -> Column:
    return F.shiftleft(level.cast("long"), LEVEL) + place


def ancestors(rank: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda j: node(j, F.expr("0L") + F.floor(rank / F.pow(F.lit(2.0), j)).cast("long")))


def cover(low: Column, high: Column, levels: int) -> Column:
    """Nodes that together hold the ranks from low to high, each once."""

    def level(j: Column) -> Column:
        size = F.pow(F.lit(2.0), j)
        a, b = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        return F.array(F.when((a < b) & (a % 2 == 1), node(j, a)), F.when((a < b) & (b % 2 == 1), node(j, b - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level)))


def find_in_range(df: DataFrame, table: DataFrame, value: str, low: str | None, high: str | None, order_by: list[str], take: Column, into: str, keys: list[tuple[str, str]] = (), closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """For each row of df what the first row of `table` gives, in its order, whose range holds the value; null without one.

    The range goes from column `low` to column `high`; None, or a null bound, leaves it open on that side. closed: whether
    the bounds belong to it. keys: pairs of columns that must be equal too (null equals nothing). A null value is in no range.
    """
    probe = df.select(F.col(value).alias("_v"), *[F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(keys)]).where(F.col(value).isNotNull()).distinct()
    bound = lambda c: F.col(c) if c else F.lit(None).cast(df.schema[value].dataType)
    rows = table.select(bound(low).alias("_low"), bound(high).alias("_high"), *[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)], F.struct(*order_by).alias("_ord"), take.alias("_take"))
    # Of rows with one range the first is enough.
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = rows.groupBy("_low", "_high", *ks).agg(F.min_by(F.struct("_ord", "_take"), "_ord").alias("_row")).select("_low", "_high", *ks, "_row.*")
    ends = [rows.select(F.col(c).alias("_v")).where(F.col(c).isNotNull()) for c, given in (("_low", low), ("_high", high)) if given]
    values = probe.select("_v")
    for e in ends:
        values = values.unionByName(e)
    ranks = with_ordinal(values.distinct(), ["_v"], "_rank")
    n = ranks.agg(F.coalesce(F.max("_rank"), F.lit(0)).alias("n")).first()["n"]
    levels = max(n + 1, 2).bit_length()
    for c, given, step, end in (("_low", low, 0 if closed[0] else 1, 1), ("_high", high, 0 if closed[1] else -1, n)):
        if given:
            rows = rows.join(ranks.select(F.col("_v").alias(c), F.col("_rank").alias(f"_r{c}")), c, "left").withColumn(f"_r{c}", F.coalesce(F.col(f"_r{c}") + step, F.lit(end)))
        else:
            rows = rows.withColumn(f"_r{c}", F.lit(end).cast("long"))
    nodes = rows.where(F.col("_r_low") <= F.col("_r_high")).select(*ks, "_ord", "_take", F.explode(cover(F.col("_r_low"), F.col("_r_high"), levels)).alias("_node"))
    nodes = nodes.groupBy(*ks, "_node").agg(F.min_by(F.struct("_ord", "_take"), "_ord").alias("_hit"))
    asked = probe.join(ranks, "_v").select("_v", *ks, F.explode(ancestors(F.col("_rank"), levels)).alias("_node"))
    border = (levels - TOP) << LEVEL if levels > TOP else 0
    upper, lower = nodes.where(F.col("_node") >= border), nodes.where(F.col("_node") < border)
    met = asked.where(F.col("_node") >= border).join(upper if keys else F.broadcast(upper), [*ks, "_node"])
    if border:
        met = met.unionByName(asked.where(F.col("_node") < border).join(lower, [*ks, "_node"]))
    best = met.groupBy("_v", *ks).agg(F.min_by("_hit", "_hit._ord")["_take"].alias(into))
    on = F.col(value) == F.col("_v")
    for i, (a, _) in enumerate(keys):
        on = on & (F.col(a) == F.col(f"_k{i}"))
    return df.drop(into).join(best, on, "left").drop("_v", *ks)
