"""Flat, fixed-width, JSON, XML and file-set sources. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.delimited import parsed, records_of
from tessella.sources.files import documents, fixed_records, plain_path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = False) -> DataFrame:
    """Positional columns; an empty cell is null, missing trailing cells are null; too many cells or a bad cell is an
    error of the job, whichever columns it asks for. A quoted cell may hold separators, line breaks and doubled quotes."""
    return parsed(records_of(spark, path, sep, header), schema, sep)


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, str]], fill: str = " ", delimited: bool = True, empty_as_null: bool = True, encoding: str = "utf-8") -> DataFrame:
    """Records of (name, width, type) fields, one per line or unbroken; widths count characters; a record of another length
    is an error; trailing fill is trimmed. Unbroken files are cut into byte ranges, and `encoding` is theirs."""
    if delimited:
        records = spark.read.text(path).withColumnRenamed("value", "_r")
    else:
        records = fixed_records(spark, path, sum(w for _, w, _ in fields), encoding)
    return records.select(*fixed_fields(F.col("_r"), fields, fill, empty_as_null))


def fixed_fields(record: Column, fields: list[tuple[str, int, str]], fill: str = " ", empty_as_null: bool = True) -> list[Column]:
    total, at, out = sum(w for _, w, _ in fields), 1, []
    wrong = F.raise_error(F.concat(F.lit(f"a record is not {total} characters long: "), record)).cast("string")
    for name, width, kind in fields:
        cell = F.rtrim(F.substring(F.when(F.length(record) == total, record).otherwise(wrong), at, width), F.lit(fill))
        cell = F.nullif(cell, F.lit("")) if empty_as_null or kind != "string" else cell
        out.append(cell.cast(kind).alias(name))
        at += width
    return out


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents that are an object or an array of objects. Absent repeating fields are empty arrays; a wrong type is an
    error."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    return filled_arrays(df)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per nonblank line."""
    return filled_arrays(spark.read.option("mode", "FAILFAST").schema(schema).json(path))


def filled_arrays(df: DataFrame) -> DataFrame:
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    return df.withColumns(empty) if empty else df


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Rows are the elements named row_tag; attributes are fields with a leading _; absent repeating children are empty."""
    return filled_arrays(spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path))


def read_file_set(spark: SparkSession, pattern: str, kind: str = "text", **options) -> DataFrame:
    """Files of a pattern, each row with its document's path; no match is an error."""
    df = spark.read.format(kind).options(**options).load(pattern)
    return df.select("*", given_path(F.col("_metadata.file_path")).alias("_doc_path"))


def read_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Typed columns of a Parquet table."""
    return spark.read.parquet(path).select(*[F.col(c).cast(k).alias(c) for c, k in columns.items()])


def given_path(path: Column) -> Column:
    """A file path as it was given, from the escaped form of _metadata.file_path."""
    return plain_path(F.url_decode(F.regexp_replace(path, r"\+", "%2B")))


def load_by_path(driver: DataFrame, path: str, kind: str = "text", **options) -> DataFrame:
    """For each row the rows of the document whose path it names, whatever characters are in it; null paths are skipped and
    every document is opened once, by an executor (see documents())."""
    return driver.join(documents(driver, path, kind, **options), plain_path(F.col(path)) == F.col("_doc_path"))


def resolve_relation(keys: list[tuple[str, str, str, str]], parent: str, child: str, column: str | None = None) -> tuple[str, str]:
    """(parent column, child column) of the one declared key edge (parent, parent column, child, child column) between two
    tables; none or several are an error."""
    found = [(a, b) for p, a, c, b in keys if p == parent and c == child and column in (None, b, a)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} key edges between {parent} and {child}")
    return found[0]


def facts_by_context(facts: DataFrame, contexts: DataFrame, context: str, concept: str, value: str, wanted: list[str]) -> DataFrame:
    """One row per context that holds any wanted fact, a column per concept; two facts of one concept in one context are an
    error."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("a fact comes twice in its context")).cast("double")).otherwise(F.max(value))
    wide = facts.where(F.col(concept).isin(*wanted)).groupBy(context).pivot(concept, wanted).agg(one)
    return contexts.join(wide, context)


def unpivot_grid(df: DataFrame, ids: list[str], columns: list[str], name: str = "header", value: str = "value") -> DataFrame:
    """One row per nonempty cell of a grid, with the physical place of its column (from 1)."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias(name), F.col(c).alias(value)) for i, c in enumerate(columns, 1)])
    return df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.*").where(F.col(value).isNotNull())


def transpose_rows(cells: DataFrame, rows: dict[int, str], driver: int) -> DataFrame:
    """One record per column whose cell in the driver row is nonempty; the chosen rows are its fields. cells: row, col,
    value."""
    wide = cells.where(F.col("row").isin(*rows)).groupBy("col").pivot("row", list(rows)).agg(F.max("value"))
    wide = wide.where(F.col(str(driver)).isNotNull() & (F.col(str(driver)).cast("string") != ""))
    return wide.select("col", *[F.col(str(r)).alias(n) for r, n in rows.items()])


def union_sheets(sheets: dict[str, DataFrame], order_by: str) -> DataFrame:
    """Rows of several sheets with the sheet's name and the row's physical number in it."""
    from tessella.ordinal import with_ordinal

    out = None
    for name, df in sheets.items():
        numbered = with_ordinal(df, [order_by], "row_number").withColumn("sheet", F.lit(name))
        out = numbered if out is None else out.unionByName(numbered)
    return out
