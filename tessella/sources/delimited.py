"""Records of delimited text, whatever their cells hold: separators, quotes and line breaks inside quotes.

Files are read by lines, in splits. Where no line leaves a quote open, each line is a record. Else records are put together:
every split says what it does to an open quote, these steps are chained along each file, and then every split knows how it
begins. A record that runs over the end of a split is joined from its fragments, of which a split has two at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Quotes:
    """Whether a line leaves a quoted cell open. A quote counts at the start of a cell only; inside, two stand for one."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.cell = re.compile(rf'(?:"(?:[^"]++|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|)(?:{s}|\Z)')

    def leaves_open(self, line: str, inside: bool) -> bool:
        """inside: a quoted cell is open when the line begins."""
        if '"' not in line:
            return inside
        at, text = 0, '"' + line if inside else line
        while at < len(text):
            cell = self.cell.match(text, at)
            if cell is None:
                return True
            at = cell.end()
        return False


def closed_pattern(sep: str) -> str:
    """A line, or a record, whose quoted cells all end. Possessive, so that no long cell is tried twice."""
    s = f"\\x{{{ord(sep):x}}}"
    cell = rf'(?:"(?:[^"]++|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|)'
    return rf"(?s)\A{cell}(?:{s}{cell})*+\z"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, line) of the lines of text files, in splits; `at` rises in each split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def records_of(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """(record, skip) of delimited text files. Blank records are to be skipped, and with `header` each file's first one. They
    are marked and not dropped, so that no check of a record is made before it is known to be one."""
    lines = lines_of(spark, path)
    if not lines.where(F.col("line").contains('"') & ~F.col("line").rlike(closed_pattern(sep))).isEmpty():
        records = joined_records(lines, sep)
    elif header:
        first = lines.groupBy("file").agg(F.min(F.when((F.col("split") == 0) & F.col("line").rlike(r"[^\r]"), F.col("at"))).alias("_first"))
        # A row for each file, fewer than the driver's own list of them: no file's lines are moved for its header.
        records = lines.join(F.broadcast(first), "file").select(F.col("line").alias("record"), F.coalesce(F.col("at") == F.col("_first"), F.lit(False)).alias("first"))
    else:
        records = lines.select(F.col("line").alias("record"), F.lit(False).alias("first"))
    record = F.regexp_replace("record", r"\r\z", "")
    return records.select(record.alias("record"), ((F.col("first") & F.lit(header)) | (record == "")).alias("skip"))


def joined_records(lines: DataFrame, sep: str) -> DataFrame:
    """(first, record) where cells may hold line breaks; `first` marks what may be a file's header."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How each split ends if it begins outside a quoted cell, and if it begins inside one."""
        quotes, ends = Quotes(sep), {}
        for batch in batches:
            batch = batch.filter(pc.match_substring(batch.column("line"), '"'))
            for file, split, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "line")), strict=True):
                ends[file, split] = tuple(quotes.leaves_open(line, inside) for inside in ends.get((file, split), (False, True)))
        if ends:
            yield pa.RecordBatch.from_pylist([{"file": f, "split": s, "outside": o, "inside": i} for (f, s), (o, i) in ends.items()])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that lie in a split (part 0), and its fragments: the end of an earlier record (1), the begin of one (2)."""
        quotes, here, kept, inside, part, first = Quotes(sep), (None, None), [], False, 0, False
        out: list[dict] = []

        def put(part: int) -> None:
            nonlocal first
            text = "\n".join(kept)
            out.append({"file": here[0], "split": here[1], "part": part, "first": first, "record": text})
            first = first and not text.strip("\r")

        for batch in batches:
            for file, split, begins, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "begins", "line")), strict=True):
                if (file, split) != here:
                    if kept:
                        put(part or 2)
                    here, kept, inside, part, first = (file, split), [], begins, int(begins), split == 0
                kept.append(line)
                inside = quotes.leaves_open(line, inside)
                if not inside:
                    put(part)
                    kept, part = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out)
                out.clear()
        if kept:
            put(part or 2)
            yield pa.RecordBatch.from_pylist(out)

    found = lines.mapInArrow(steps, "file string, split long, outside boolean, inside boolean")
    # One row for each split: a file's are as few as its size over that of a split.
    chain = F.sort_array(F.collect_list(F.struct("split", "outside", "inside")))
    begins = F.aggregate(chain, F.struct(F.array().cast("array<struct<split:bigint,begins:boolean>>").alias("out"), F.lit(False).alias("open")), lambda a, s: F.struct(F.concat(a["out"], F.array(F.struct(s["split"].alias("split"), a["open"].alias("begins")))).alias("out"), F.when(a["open"], s["inside"]).otherwise(s["outside"]).alias("open")))
    splits = lines.select("file", "split").distinct().join(found, ["file", "split"], "left").fillna({"outside": False, "inside": True})
    starts = splits.groupBy("file").agg(begins["out"].alias("b")).select("file", F.explode("b").alias("b")).select("file", "b.split", "b.begins")
    known = lines.join(starts, ["file", "split"]).sortWithinPartitions("file", "split", "at").select("file", "split", "begins", "line")
    made = known.mapInArrow(pieces, "file string, split long, part long, first boolean, record string")
    whole = made.where("part = 0")
    # The fragments of a record follow each other along its file; a fragment that begins one starts the next number.
    w = Window.partitionBy("file").orderBy("split", "part")
    torn = made.where("part > 0").withColumn("n", F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "part", "record"))), lambda x: x["record"]), "\n")
    torn = torn.groupBy("file", "n").agg(F.bool_or("first").alias("first"), text.alias("record"))
    return whole.select("first", "record").unionByName(torn.select("first", "record"))


def cells_of(record: Column, sep: str) -> Column:
    """The cells of a record as texts, quotes taken off; an empty cell is null."""
    s = f"\\x{{{ord(sep):x}}}"
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(rf'(?s){s}("(?:[^"]++|"")*+(?:"[^{s}]*+|\z)|[^{s}]*+)'), F.lit(1))

    def bare(cell: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(cell, r'(?s)\A"((?:[^"]++|"")*+)', 1), '""', '"')
        return F.when(cell.startswith('"'), F.concat(inner, F.regexp_extract(cell, r'(?s)\A"(?:[^"]++|"")*+"(.*)\z', 1))).otherwise(cell)

    return F.transform(found, lambda c: F.nullif(bare(c), F.lit("")))


def typed(cell: Column, kind: T.DataType) -> Column:
    return cell if isinstance(kind, T.StringType) else cell.try_cast(kind)


def parsed(records: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    """Typed columns of (record, skip). Cells that are missing at the end are null. Too many cells, cells that aren't of their
    column's type and floats that aren't finite are errors, whichever columns are asked for: the check is a filter."""
    fields = schema.fields
    df = records.select("skip", cells_of(F.col("record"), sep).alias("_cells"))
    wrong = F.when(F.col("skip"), False).when(F.size("_cells") > len(fields), F.raise_error(F.concat(F.lit("a record has too many columns: "), F.size("_cells").cast("string"))).cast("boolean"))
    for i, f in enumerate(fields):
        if not isinstance(f.dataType, T.StringType):
            cell = F.get("_cells", F.lit(i))
            made = typed(cell, f.dataType)
            bad = cell.isNotNull() & made.isNull()
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                bad = bad | F.isnan(made) | (F.abs(made) == float("inf"))
            wrong = wrong.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"not a value of {f.name}: "), cell)).cast("boolean"))
    return df.where(wrong.otherwise(True)).select(*[typed(F.get("_cells", F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(fields)])
