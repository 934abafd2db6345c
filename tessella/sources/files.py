"""Files that executors open themselves: documents named by a table, and byte ranges of files without line breaks.

Paths are those that the file systems of pyarrow know (local, HDFS, S3, GCS). The driver sees numbers of files and bytes only.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents a task opens, and bytes of a range.
DOCUMENTS, RANGE = 1000, 16 << 20
#: Bytes of a character in encodings where all have the same (fixed values).
WIDTHS = {"ascii": 1, "latin-1": 1, "utf-16-le": 2, "utf-16-be": 2, "utf-32-le": 4, "utf-32-be": 4}


def plain_path(path: Column) -> Column:
    """A path without the file scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def opened(path: str) -> pa.NativeFile:
    path = re.sub("^file:/+", "/", path)
    store, at = fs.FileSystem.from_uri(path) if re.match(r"^\w+:/", path) else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def documents(paths: DataFrame, path: str, kind: str = "text", wholetext: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """(_doc_path, columns) of the documents that a column names, each opened once by the executor that has its path. kind:
    "text" (a row `value` for each line, or for the document), "binary" (`content`), "json" (a document is an object or an
    array of objects), "jsonl". A document that can't be opened is an error of the job."""
    if kind not in ("text", "binary", "json", "jsonl") or (kind.startswith("json") and schema is None):
        raise ValueError(f"kind {kind}, schema {schema}")
    found = paths.where(F.col(path).isNotNull()).select(plain_path(F.col(path)).alias("_doc_path")).distinct()
    lines, column = kind == "jsonl" or (kind == "text" and not wholetext), "content" if kind == "binary" else "value"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with opened(at) as f:
                    content = f.read()
                values = [content] if kind == "binary" else [content.decode("utf-8")]
                if lines:
                    values = re.split(r"\r\n|\r|\n", values[0])
                    values = values[:-1] if values[-1] == "" else values
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(values), pa.string()), pa.array(values, pa.binary() if kind == "binary" else pa.string())], ["_doc_path", column])

    # The number of tasks follows the number of documents: paths are short, and would be dealt to few tasks by their size.
    tasks = -(-found.count() // DOCUMENTS)
    docs = found.repartition(max(tasks, 1), "_doc_path").mapInArrow(read, f"_doc_path string, {column} {'binary' if kind == 'binary' else 'string'}")
    if not kind.startswith("json"):
        return docs
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if kind == "jsonl":
        return docs.where(F.trim("value") != "").select("_doc_path", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_v")).select("_doc_path", "_v.*")
    return docs.select("_doc_path", F.explode(F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})).alias("_v")).select("_doc_path", "_v.*")


def fixed_records(spark: SparkSession, path: str, total: int, encoding: str = "utf-8", size: int = RANGE) -> DataFrame:
    """(_r) of files that are unbroken runs of records of `total` characters, cut by byte ranges into as many tasks as they
    need. In UTF-8 the characters of every range are counted first, so that each knows which record it begins in; other
    encodings have characters of one width. The last record of a file may be shorter."""
    encoding = codecs.lookup(encoding).name.replace("iso8859-1", "latin-1")
    if encoding != "utf-8" and encoding not in WIDTHS:
        raise ValueError(f"characters of {encoding} have no fixed width")
    width = WIDTHS.get(encoding, 0)
    size = max(size // 4, 1) * 4
    found = spark.read.format("binaryFile").load(path).where("length > 0").select(plain_path(F.col("path")).alias("path"), "length")
    tasks = max(found.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1, 1)
    ranges = found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start")).repartition(tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as f:
                    content = f.read_at(size, row["start"])
                # Bytes 0x80 to 0xBF continue a character.
                yield pa.RecordBatch.from_pylist([{**row, "chars": len(content) - sum(content.count(bytes([b])) for b in range(0x80, 0xC0))}])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, before, chars = row["start"], row["before"], row["chars"]
                first = -(-before // total)
                skip, n = first * total - before, max(0, -(-(before + chars) // total) - first)
                if not n:
                    continue
                with opened(row["path"]) as f:
                    content = f.read_at(size + total * max(width, 4), start)
                ends = start + len(content) == row["length"]
                while not width and start and content and 0x80 <= content[0] < 0xC0:
                    content = content[1:]
                text = codecs.getincrementaldecoder(encoding)().decode(content, ends)
                yield pa.RecordBatch.from_arrays([pa.array([text[skip + i * total : skip + (i + 1) * total] for i in range(n)], pa.string())], ["_r"])

    if width:
        chars = F.ceil(F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")) / width).cast("long")
        known = ranges.withColumns({"before": F.floor(F.col("start") / width).cast("long"), "chars": chars})
    else:
        counted = ranges.mapInArrow(count, "path string, length long, start long, chars long")
        # A row for each range of a file: few, whatever the file holds.
        so_far = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        known = counted.withColumn("before", F.coalesce(F.sum("chars").over(so_far), F.lit(0))).repartition(tasks)
    return known.mapInArrow(read, "_r string")
