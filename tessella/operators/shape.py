"""Flattening and building: paths that cross repeating levels, nested groups, dynamic names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.grouping import beside
from tessella.ordinal import with_ordinal


def iterate(df: DataFrame, path: str, alias: str, number: str | None = None) -> DataFrame:
    """One row per item of the repeating field at `path`; the outer columns stay, an empty repetition gives no row.
    `number`: a column with the item's 1-based place."""
    out = df.select("*", F.posexplode(F.col(path)).alias("_at", alias))
    return (out.withColumn(number, F.col("_at") + 1) if number else out).drop("_at")


def iterate_path(df: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """Crosses several levels: (path, alias) from the outside in. Each level adds <alias>_position."""
    for path, alias in levels:
        df = iterate(df, path, alias, f"{alias}_position")
    return df


def field(df: DataFrame, name: str, frames: list[str]) -> Column:
    """A field looked up in the innermost frame (struct column) that has it, then outwards, then among the columns."""
    for frame in reversed(frames):
        kind = df.schema[frame].dataType
        if name in getattr(kind, "names", []):
            return F.col(frame)[name]
    if name in df.columns:
        return F.col(name)
    raise KeyError(name)


def pinned_field(df: DataFrame, frame: str, name: str) -> Column:
    """A field of one named frame; null if the frame has none."""
    return F.col(frame)[name] if name in getattr(df.schema[frame].dataType, "names", []) else F.lit(None)


def first_item(array) -> Column:
    """What a repetition reads as where it is not iterated: its first item, null if there is none."""
    return F.try_element_at(F.col(array) if isinstance(array, str) else array, F.lit(1))


def dynamic_field(entries, key) -> Column:
    """The entry of a map whose name is computed; null if it is absent."""
    return F.try_element_at(F.col(entries) if isinstance(entries, str) else entries, key)


def repeated(*values) -> Column:
    """Several bindings of one repeating field: the values that are not null, in order."""
    return F.array_compact(F.array(*values))


def bind(df: DataFrame, fields: dict[str, Column] | list[tuple[str, Column]]) -> DataFrame:
    """The target's fields, each bound once; pairs that bind a name twice are an error."""
    pairs = list(fields.items()) if isinstance(fields, dict) else fields
    if len({n for n, _ in pairs}) != len(pairs):
        raise ValueError(f"a field is bound twice: {sorted(n for n, _ in pairs)}")
    fields = dict(pairs)
    return df.select(*[c.alias(n) for n, c in fields.items()])


def nest(parent: DataFrame, child: DataFrame, keys: list[str], name: str, fields: list[str], order_by: list[str], null_is_key: bool = False) -> DataFrame:
    """Parents with an array of their children (structs of `fields`, in order); a parent without any has an empty array, and
    so has one without a key, unless null is a key."""
    item = F.struct(*order_by, F.struct(*fields).alias("_item"))
    lists = child.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    lists = lists.select(*keys, F.transform("_items", lambda x: x["_item"]).alias(name))
    kind = lists.schema[name].dataType
    out = beside(parent, keys, lists) if null_is_key else parent.join(lists, keys, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def single_group(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Exactly one row; none or several are an error."""
    out = df.agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(n) for n, c in fields.items()])
    fine = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("a single group has rows: "), F.col("_n").cast("string"))).cast("boolean"))
    return out.where(fine).drop("_n")


def dynamic_object(df: DataFrame, keys: list[str], name: Column, value: Column, into: str = "object") -> DataFrame:
    """One map per key from a computed name and a value per row; a name that comes twice is an error."""
    entries = F.collect_list(F.struct(name.alias("k"), value.alias("v")))
    made = F.map_from_entries(F.sort_array(entries)).alias(into)
    return df.groupBy(*keys).agg(made) if keys else df.agg(made)


def dynamic_children(df: DataFrame, keys: list[str], name: Column, item: Column, into: str = "object") -> DataFrame:
    """As dynamic_object, but each computed name holds the sorted array of its items."""
    lists = df.groupBy(*keys, name.alias("_name")).agg(F.sort_array(F.collect_list(item)).alias("_list"))
    return dynamic_object(lists, keys, F.col("_name"), F.col("_list"), into)


def document_path(df: DataFrame, frames: list[str]) -> Column:
    """The path of the nearest source document: that of the innermost frame that was read from one."""
    return field(df, "_doc_path", frames)


def surviving(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; a null predicate is an error."""
    return df.where(F.coalesce(predicate, F.raise_error(F.lit("the predicate of a filter is null")).cast("boolean")))


def copied(df: DataFrame, name: str = "item") -> DataFrame:
    """The whole row as one group."""
    return df.select(F.struct("*").alias(name))


def projected(df: DataFrame, target: list[str]) -> DataFrame:
    """The fields that source and target share, in the target's order."""
    return df.select(*[n for n in target if n in df.columns])


def first_of(df: DataFrame, within: list[str], order_by: list) -> DataFrame:
    """The first row of each group."""
    item = F.struct(*[c for c in df.columns if c not in within])
    return df.groupBy(*within).agg(F.min_by(item, F.struct(*order_by)).alias("_x")).select(*within, "_x.*")


def first_or_empty(groups: DataFrame, df: DataFrame, within: list[str], order_by: list) -> DataFrame:
    """Each group's first surviving row; a group without any stays, empty. Null is a key."""
    return beside(groups, within, first_of(df, within, order_by))


def mapped_sequence(groups: DataFrame, df: DataFrame, within: list[str], item: Column, order_by: list[str], name: str) -> DataFrame:
    """Groups with the array of an expression over their surviving rows, in order; a group without any has an empty one."""
    return nest(groups, df.withColumn(name, item), within, name, [name], order_by, null_is_key=True).withColumn(name, F.transform(name, lambda x: x[name]))


def whole_number(value: Column) -> Column:
    """A float as a long where that is exact and fits; null where it is not."""
    exact = (value % 1 == 0) & (value >= float(-(2**63))) & (value < float(2**63))
    return F.when(exact, value.cast("long"))


def exact_float(value: Column) -> Column:
    """A long as a double where that is exact; null where it is not."""
    return F.when(value.cast("double").cast("decimal(38,0)") == value.cast("decimal(38,0)"), value.cast("double"))


def adapted_number(value: Column, target: str) -> Column:
    """A number as a variant for a target of type "long" or "double": converted where that is exact, else unchanged."""
    made = whole_number(value.cast("double")) if target == "long" else exact_float(value)
    of_kind = F.typeof(value).isin("double", "float") if target == "long" else ~F.typeof(value).isin("double", "float")
    return F.coalesce(F.when(of_kind, made).cast("variant"), value.cast("variant"))


#: What schema_of_variant calls the types that a union target can allow (fixed values).
UNION = {"string": ["STRING"], "long": ["BIGINT"], "double": ["DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"]}


def adapted_union(value: Column, types: list[str]) -> Column:
    """A variant for a target that allows several types: an allowed type stays, a whole number is widened to a float and a
    float becomes a whole number only where that is needed and exact; anything else stays as it is."""
    kind = F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
    allowed = kind.isin(*[k for t in types for k in UNION[t]])
    out = value
    if "double" in types:
        out = F.when(kind.isin(UNION["long"]), F.coalesce(exact_float(F.try_variant_get(value, "$", "long")).cast("variant"), value)).otherwise(out)
    if "long" in types:
        out = F.when(kind.isin(UNION["double"]), F.coalesce(whole_number(F.try_variant_get(value, "$", "double")).cast("variant"), value)).otherwise(out)
    return F.when(allowed, value).otherwise(out)


def mixed_content(items, replacements: dict[str, Column] | None = None, text_name: str = "") -> Column:
    """Text of an array of struct(name, text): runs of text stay, elements named in `replacements` are replaced by a
    function of their text."""
    items, chosen = F.col(items) if isinstance(items, str) else items, replacements or {}

    def shown(item: Column) -> Column:
        out = item["text"]
        for name, make in chosen.items():
            out = F.when(item["name"] == name, make(item["text"])).otherwise(out)
        return out

    return F.array_join(F.transform(items, shown), "")


def renamed_content(items, names: dict[str, str]) -> Column:
    """Mixed content with renamed elements; unmapped elements go, text (name null) stays."""
    items = F.col(items) if isinstance(items, str) else items
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = F.filter(items, lambda i: i["name"].isNull() | F.map_contains_key(table, i["name"]))
    return F.transform(kept, lambda i: F.struct(F.try_element_at(table, i["name"]).alias("name"), i["text"].alias("text")))


def xml_text(value: Column, **options: str) -> Column:
    """A struct as XML text."""
    return F.to_xml(value, options)


def concatenated(segments: list[DataFrame], order_by: list[str] | None = None) -> DataFrame:
    """Independent segments one after the other: duplicates stay, `segment` leads the order; with order_by a dense `ord`."""
    out = None
    for i, df in enumerate(segments):
        df = df.withColumn("segment", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return with_ordinal(out, ["segment", *order_by]) if order_by else out
