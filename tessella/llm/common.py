"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and the five control characters tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the
    master is local. On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that stored() writes to, innermost last.
_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that stored() writes inside are deleted at the end. Gives a function that writes a table to stay."""
    outer = _SCRATCH[-1] if _SCRATCH else shared_dir(spark)
    folder = f"{outer}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    try:
        yield lambda df: written(df, outer)
    finally:
        _SCRATCH.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages, and a retry after a lost executor, read the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but written as a Parquet table in the shared folder: compressed, and pruned by column when it is read."""
    return written(df, _SCRATCH[-1] if _SCRATCH else shared_dir(df.sparkSession))


def ascii_lower(text: Column) -> Column:
    """A-Z only: no other letter changes."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(m))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, m: int, held: int, limit: int) -> DataFrame:
    """(doc_id, text, label) of a bounded training sample: per class at most `limit` rows, those of the smallest hash of
    doc_id, from rows whose crc32(doc_id as text) mod `m` is not `held`. A doc_id counts once: with several texts it stands
    for that of the least hash, and with both labels it is left out."""
    train = labels.where(crc_mod(F.col("doc_id"), m) != held).where(F.col(label).isin(0, 1))
    train = train.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").drop("_most")
    picks = [train.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for k in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("label").alias("label"))


def class_log_odds(labels: DataFrame, label: str, m: int, held: int) -> float:
    """Log odds of label 1 among all labelled rows that may be learnt from."""
    rows = labels.where(crc_mod(F.col("doc_id"), m) != held).where(F.col(label).isin(0, 1))
    n = {r["k"]: r["count"] for r in rows.groupBy(F.col(label).alias("k")).count().collect()}
    return float(np.log(n[1] / n[0]))
