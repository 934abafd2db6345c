"""Order as data. Spark rows have no order, so ordered operators take order_by columns or an ordinal made here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder to spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own; on a
    cluster it is an error, as executors can't share such a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later stages, and a retry after a lost executor, read the files."""
    with_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows from a new Parquet folder beside the checkpoints, and its path, which discard() takes. Such files take a fraction
    of a checkpoint's room."""
    spark = df.sparkSession
    with_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored folder that no later step reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def with_ordinal(df: DataFrame, order_by: list, name: str = "ord", start: int = 1) -> DataFrame:
    """Dense ordinal over the whole table without a single-partition window: sort by range, number the rows in each
    partition, add the counts of the partitions before. Ties are numbered in any order, so order_by should be unique."""
    parts = df.orderBy(*order_by).withColumns({"_pid": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()})
    parts = checkpointed(parts)
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: its size does not follow the rows.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_pid", before.alias("_before")))
    ordinal = F.col("_before") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return parts.join(offsets, "_pid").select(*df.columns, ordinal.cast("long").alias(name))


def position(order_by: list, within: list | None = None) -> Column:
    """1-based place within the rows that share the `within` columns."""
    return F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*order_by))


def sums_before(totals: DataFrame, at: str, total: str, name: str, size: int) -> DataFrame:
    """Adds the sum of `total` over the rows before, along the numbers `at`. `size` of them make a block; blocks of blocks follow
    until they are few enough for one task."""
    up, pre, block = f"{at}_up", f"{at}_pre", F.floor(F.col(at) / size)
    inside = F.coalesce(F.sum(total).over(Window.partitionBy(up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = totals.groupBy(block.alias(up)).agg(F.sum(total).alias("_sum"))
    few = upper.agg(F.coalesce(F.max(up), F.lit(0)).alias("n")).first()["n"] < size
    if few:
        before = upper.select(up, F.coalesce(F.sum("_sum").over(Window.orderBy(up).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(pre))
    else:
        before = sums_before(upper, up, "_sum", pre, size).drop("_sum")
    return totals.withColumn(up, block).join(before, up).withColumn(name, F.col(pre) + inside).drop(up, pre)


def running_count(df: DataFrame, flag: str, ordinal: str, name: str, block: int = 65536) -> DataFrame:
    """Running number of true flags along a dense ordinal: inside blocks, after the totals of the blocks before, which are
    summed in blocks in turn."""
    blocked = df.withColumn("_block", F.floor((F.col(ordinal) - 1) / block))
    inside = F.sum(F.col(flag).cast("long")).over(Window.partitionBy("_block").orderBy(ordinal))
    totals = df.select(F.floor((F.col(ordinal) - 1) / block).alias("_block"), F.col(flag).cast("long").alias("_f")).groupBy("_block").agg(F.sum("_f").alias("_total"))
    before = sums_before(totals, "_block", "_total", "_rows_before", block).drop("_total")
    return blocked.join(before, "_block").withColumn(name, F.col("_rows_before") + inside).drop("_block", "_rows_before")
