"""Operator 1. Hilbert-curve sharding: rows that are near in several metadata dimensions land in the same file.

Plan: quantise each dimension by its approximate quantiles, number the cells along a Hilbert curve, number the rows
along the cells, cut that order into runs of equal counts. Only the dimensions and the keys are shuffled, never the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, stored, table


def text_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """At most cells - 1 texts that cut the rows, in the order of the whole texts, into runs of about equal counts. The
    different texts are counted and sorted by range; running counts go by partition, and only the cuts reach the driver."""
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = cut(values.orderBy("v").withColumn("pid", F.spark_partition_id()))
    parts = values.groupBy("pid").agg(F.sum("n").alias("m"))
    # One row per partition: its size does not follow the rows.
    parts = parts.select("pid", F.coalesce(F.sum("m").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("all"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = values.withColumn("at", inside).join(F.broadcast(parts), "pid").withColumn("cell", F.expr(f"((before + at) * {cells}) div all"))
    return sorted((r["v"] for r in placed.where("cell > 0").groupBy("cell").agg(F.min("v").alias("v")).collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))


def quantised(df: DataFrame, dims: list[str], bits: int) -> tuple[DataFrame, list[str]]:
    """Adds _q0, _q1, ...: how many of the 2^bits - 1 inner quantiles of a dimension lie below the value; null is 0.
    Numbers are cut at approximate quantiles; texts are compared whole with text_cuts, so that a shared beginning of any
    length tells nothing away. The cuts are the only values that reach the driver (dims x 2^bits)."""
    steps = [i / 2**bits for i in range(1, 2**bits)]
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    found = df.select(*[F.percentile_approx(F.col(d).cast("double"), steps, 1000).alias(f"b{i}") for i, d in enumerate(numbers)]).first() if numbers else []
    cuts = {d: sorted(set(c or [])) for d, c in zip(numbers, found, strict=True)}
    names = [f"_q{i}" for i in range(len(dims))]
    for i, d in enumerate(dims):
        if d in cuts:
            above = [F.coalesce(F.col(d).cast("double") > F.lit(b), F.lit(False)).cast("int") for b in cuts[d]]
        else:
            above = [F.coalesce(F.col(d) >= F.lit(b), F.lit(False)).cast("int") for b in text_cuts(df, d, 2**bits)]
        df = df.withColumn(names[i], reduce(lambda a, b: a + b, above, F.lit(0)))
    return df, names


def with_hilbert_index(df: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """Index along the Hilbert curve through a grid of 2^bits cells in each of the axes (Skilling's transform)."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else None

    def step(x: Column, s: Column) -> Column:
        p, first, own = s["q"] - 1, F.get(x, F.lit(0)), F.get(x, s["i"])
        inside, swap = own.bitwiseAND(s["q"]) != 0, first.bitwiseXOR(own).bitwiseAND(p)
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(F.when(inside, p).otherwise(swap))).when((j == s["i"]) & ~inside, v.bitwiseXOR(swap)).otherwise(v))

    x = F.array(*[F.col(a).cast("long") for a in axes])
    df = df.withColumn("_x", F.aggregate(steps, x, step) if steps is not None else x)
    df = df.withColumn("_g", F.transform("_x", lambda v, j: F.aggregate(F.slice("_x", 1, j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))))
    last = F.get("_g", F.lit(n - 1))
    flip = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0).cast("long") for b in range(1, bits)], F.lit(0).cast("long"))
    df = df.withColumn("_t", flip)
    bit = lambda i, b: F.shiftleft(F.shiftright(F.get("_g", F.lit(i)).bitwiseXOR(F.col("_t")), b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i)
    return df.withColumn(out, reduce(lambda a, b: a + b, [bit(i, b) for i in range(n) for b in range(bits)])).drop("_x", "_g", "_t")


def hilbert_shards(df: DataFrame, dims: list[str], order_by: list[str], n_shards: int, bits: int = 4, rows_per_run: int = 4096) -> DataFrame:
    """Adds hilbert (cell index), shard (0 to n_shards - 1) and slot (gapless from 0 in a shard).

    Shards are consecutive runs of the curve whose row counts are at most one apart. A cell with many rows (a hot
    source, say) is dealt by a hash of `order_by` into runs of about rows_per_run rows that are numbered apart from each
    other, so no task sorts a whole cell. Null dimensions rank lowest; rows equal in `order_by` are interchangeable;
    an empty table gives an empty table; other columns pass through (hilbert, shard and slot are
    replaced, and names with a leading underscore are reserved).
    """
    names = [c for c in df.columns if c not in ("hilbert", "shard", "slot")]
    df, axes = quantised(df, dims, bits)
    cell = axes
    # At most 2^(bits x dims) cells, whatever the size of the table: safe to broadcast.
    cells = with_hilbert_index(df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")), axes, bits, "hilbert")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut(cells.select(*cell, "hilbert", before.alias("_cell_at"), F.ceil(F.col("_n") / rows_per_run).alias("_runs"), F.sum("_n").over(Window.partitionBy()).alias("_all")))
    dealt = df.join(F.broadcast(cells), cell).withColumn("_run", F.pmod(F.xxhash64(*order_by), F.col("_runs")))
    runs = dealt.groupBy("hilbert", "_run").agg(F.count(F.lit(1)).alias("_rows"))
    in_cell = Window.partitionBy("hilbert").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("hilbert", "_run", F.coalesce(F.sum("_rows").over(in_cell), F.lit(0)).alias("_run_at"))
    at = F.col("_cell_at") + F.col("_run_at") + F.row_number().over(Window.partitionBy("hilbert", "_run").orderBy(*order_by)) - 1
    out = dealt.join(runs, ["hilbert", "_run"]).withColumn("_at", at)
    out = out.withColumn("shard", F.expr(f"cast((_at * {n_shards}) div _all as int)"))
    return out.withColumn("slot", F.expr(f"_at - (cast(shard as long) * _all + {n_shards} - 1) div {n_shards}")).select(*names, "hilbert", "shard", "slot")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    # The keys are a few numbers a row; written once, they spare the later passes the texts.
    docs = stored(docs.select("doc_id", "source", "lang", "n_chars", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32")))
    out = hilbert_shards(docs, ["source", "lang", "n_chars"], ["doc_id", "size", "text_crc32"], n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
