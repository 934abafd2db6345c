"""File paths with either separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import as_column


def get_folder(path) -> Column:
    """Up to and with the last separator; "" if there is none."""
    return F.regexp_extract(as_column(path), r"^(?s)(.*[/\\])", 1)


def remove_folder(path) -> Column:
    return F.regexp_extract(as_column(path), r"([^/\\]*)$", 1)


def get_fileext(path) -> Column:
    """From the last dot of the file name on, with the dot."""
    return F.regexp_extract(remove_folder(path), r"(\.[^.]*)$", 1)


def resolve_filepath(base, path) -> Column:
    """path seen from the folder of base; an absolute path wins; ./ goes and ../ climbs, never above the root."""
    base, path = as_column(base), as_column(path)
    absolute = path.rlike(r"^([/\\]|[A-Za-z]:)")
    joined = F.translate(F.when(absolute, path).otherwise(F.concat(get_folder(base), path)), "\\", "/")
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    climb = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), climb)
    return F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def json_object(pairs: dict) -> Column:
    """Compact JSON object; dotted names nest; nulls are left out."""
    tree: dict = {}
    for name, value in pairs.items():
        *above, leaf = name.split(".")
        node = tree
        for a in above:
            node = node.setdefault(a, {})
        node[leaf] = as_column(value)
    build = lambda node: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])
    return F.to_json(build(tree))


def json_field(text, schema: str, path: str) -> Column:
    """One field of JSON text that is read with a schema; null for null."""
    out = F.from_json(as_column(text), schema, {"mode": "FAILFAST"})
    for part in path.split("."):
        out = out[part]
    return out


def create_guid() -> Column:
    """32 random hexadecimal digits."""
    return F.regexp_replace(F.uuid(), "-", "")
