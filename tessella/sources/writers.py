"""Sinks and jobs with several outputs. What must hold is checked before anything is written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.checks import FailureRule, check_failures
from tessella.ordinal import checkpointed, with_ordinal


def exact_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in its order; a missing or extra column or another type is an error."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    if have != want:
        raise ValueError(f"columns differ: {sorted(have)} and {sorted(want)}")
    return df.select(*[f.name for f in schema])


def write_csv(df: DataFrame, path: str, schema: T.StructType, sep: str = ",", header: bool = False) -> None:
    """A quote inside a cell is doubled, white space around it stays."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    exact_columns(df, schema).write.mode("overwrite").options(sep=sep, header=header, nullValue="", emptyValue="", escape='"', **spaces).csv(path)


def fixed_record(fields: list[tuple[str, int]], fill: str = " ") -> Column:
    """One record of right-filled fields; a value that is too long is an error."""
    cells = []
    for name, width in fields:
        cell = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cells.append(F.when(F.length(cell) > width, F.raise_error(F.concat(F.lit(f"{name} is longer than {width}: "), cell)).cast("string")).otherwise(F.rpad(cell, width, fill)))
    return F.concat(*cells)


def write_fixed_width(df: DataFrame, path: str, fields: list[tuple[str, int]], fill: str = " ") -> None:
    df.select(fixed_record(fields, fill).alias("value")).write.mode("overwrite").text(path)


def json_document(*fields) -> Column:
    """A JSON object of columns; null fields are left out."""
    return F.to_json(F.struct(*fields))


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, null fields left out."""
    df.write.mode("overwrite").json(path)


def write_xml(df: DataFrame, path: str, root: str, row_tag: str) -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row_tag).save(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table; if it exists, its columns and types must be the same. The new table is written whole beside
    the old one before it takes its place, so the old one may be read for it, and a job that fails leaves it as it was. Plain
    readers know no versions, so there is a moment between two renames; commit_table() has none."""
    try:
        old = df.sparkSession.read.parquet(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and [(f.name, f.dataType) for f in old] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError("the table has other columns")
    moved = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(moved)
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    files = target.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(jvm.Path(moved), target):
        raise OSError(f"{moved} is complete but could not be renamed to {path}")


#: A version of a table: a folder with its number, and a name of its own, as two jobs may commit at once.
VERSION = r"version-(\d{12})-[0-9a-f]{32}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.sc().hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions of a table, the current one last."""
    files, at = hadoop(spark, path)
    return sorted(n for n in ([f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []) if re.fullmatch(VERSION, n))


def moved(spark: SparkSession, source: str, target: str) -> None:
    files, at = hadoop(spark, source)
    if not files.rename(at, hadoop(spark, target)[1]):
        raise OSError(f"{source} could not be renamed to {target}")


def removed(spark: SparkSession, path: str) -> None:
    files, at = hadoop(spark, path)
    files.delete(at, True)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that commit_table() writes."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{path.rstrip('/')}/{found[-1]}")


def commit_table(df: DataFrame, path: str) -> None:
    """Replaces a table in one step: the new version is written whole under a passing name, and one rename makes it current.
    A job that dies anywhere leaves the old table or the new one. The version before stays for jobs that still read it; older
    ones go. The columns and types of an existing table must be the same. current_table() reads it."""
    spark, base = df.sparkSession, path.rstrip("/")
    found = versions(spark, base)
    if found:
        old = spark.read.parquet(f"{base}/{found[-1]}").schema
        if [(f.name, f.dataType) for f in old] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the table has other columns")
    own = uuid.uuid4().hex
    passing, number = f"{base}/_passing-{own}", int(re.fullmatch(VERSION, found[-1])[1]) + 1 if found else 1
    try:
        df.write.parquet(passing)
        moved(spark, passing, f"{base}/version-{number:012d}-{own}")
    except BaseException:
        removed(spark, passing)
        raise
    for name in found[:-1]:
        removed(spark, f"{base}/{name}")


def generated_keys(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Keys 1, 2, 3... in order; a column of that name that is there already is an error."""
    if key in df.columns:
        raise ValueError(f"{key} is supplied")
    return with_ordinal(df, order_by, key)


def split_nested(df: DataFrame, key: str, order_by: list[str], child: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of rows with a nested array: parents get generated keys, children carry them and get their own,
    in the order of parents and items."""
    keyed = generated_keys(df, key, order_by)
    rows = keyed.select(key, F.posexplode(child).alias("_at", "_item")).select(key, "_at", "_item.*")
    return keyed.drop(child), generated_keys(rows, child_key, [key, "_at"]).drop("_at")


def write_documents(df: DataFrame, path: str, name: str) -> int:
    """Every row as a JSON document of its own at the path that its column `name` gives below `path`; the number of documents.

    An empty, null, absolute or climbing name is an error, and so are two rows of one name; both are found before anything is
    written. Executors write the documents themselves, each under a passing name first, so a task that is run again leaves
    the same files.
    """
    shown = F.coalesce(F.col(name).cast("string"), F.lit(""))
    wrong = df.where((shown == "") | shown.rlike(r"^/|(^|/)\.\.(/|$)")).limit(1).count()
    if wrong:
        raise ValueError("a document has no path below the folder")
    twice = df.groupBy(name).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two documents have the path {twice[0][name]}")
    rest = [c for c in df.columns if c != name]
    folder = re.sub("^file:/+", "/", path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for at, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                place = f"{base.rstrip('/')}/{at}"
                target.create_dir(place.rpartition("/")[0], recursive=True)
                passing = f"{place}.{uuid.uuid4().hex}"
                with target.open_output_stream(passing) as out:
                    out.write(text.encode("utf-8"))
                target.move(passing, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = df.select(shown.alias("name"), F.to_json(F.struct(*rest)).alias("text")).mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


#: A target: a table, or a function that makes it from the source that all targets of a job share.
Target = DataFrame | Callable[[DataFrame], DataFrame]


def run_outputs(targets: dict[str, Target], path: str, source: DataFrame | None = None, failures: list[FailureRule] = ()) -> dict[str, int]:
    """Writes every target as a Parquet table and reports the rows of each, in order. A source that targets share is made
    once, whatever it costs, and read by each of them. Failure rules are checked first: where one fails nothing is written."""
    check_failures(list(failures))
    shared = checkpointed(source) if source is not None and len(targets) > 1 else source
    return {name: run_selected(targets, name, path, shared) for name in targets}


def run_selected(targets: dict[str, Target], name: str, path: str, source: DataFrame | None = None) -> int:
    """Writes one target; the others are plans that never run. The rows written are counted as they pass."""
    seen, target = Observation(), targets[name]
    out = target if isinstance(target, DataFrame) else target(source)
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
    return seen.get["rows"]
