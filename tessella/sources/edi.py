"""EDI interchanges as segment tables: X12, EDIFACT, HL7 and TRADACOMS. Everything is text functions on whole documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Private-use characters that stand for escaped ones while a text is split.
HELD = {c: chr(0xE000 + i) for i, c in enumerate("?+:'*~^|&\\")}


def literal(sep: Column) -> Column:
    """A separator as a pattern that matches just it."""
    return F.concat(F.lit("\\Q"), sep, F.lit("\\E"))


def split_by(value: Column, sep: Column) -> Column:
    return F.call_function("split", value, literal(sep), F.lit(-1))


def separators(text: Column, dialect: str) -> dict[str, Column]:
    """element, component, segment and (where there is one) repetition and release characters of an interchange."""
    at = lambda i: F.substring(text, i, 1)
    if dialect == "x12":
        return {"element": at(4), "component": at(105), "segment": at(106)}
    if dialect == "edifact":
        una = text.startswith("UNA")
        pick = lambda i, default: F.when(una, at(i)).otherwise(default)
        return {"component": pick(4, ":"), "element": pick(5, "+"), "release": pick(7, "?"), "segment": pick(9, "'")}
    if dialect == "hl7":
        return {"element": at(4), "component": at(5), "repetition": at(6), "segment": F.lit("\r")}
    if dialect == "tradacoms":
        return {"element": F.lit("+"), "component": F.lit(":"), "release": F.lit("?"), "segment": F.lit("'")}
    raise ValueError(dialect)


#: Documents a task reads, where they are dealt out before they are cut.
DOCUMENTS = 20000
#: Noncharacters, which no interchanged text has, that stand for a document's element, component and segment separators.
ELEMENT, COMPONENT, SEGMENT = "\uFDD0", "\uFDD1", "\uFDD2"


def dealt(docs: DataFrame, doc: list[str], n: int) -> DataFrame:
    """The same rows, about n, in tasks of DOCUMENTS: the number of tasks grows with the documents, and not a task's size."""
    return docs.repartition(max(1, -(-n // DOCUMENTS)), *doc)


def held_back(text: Column, sep: dict[str, Column]) -> Column:
    """Released characters as their stand-ins: ?? first, so that pairs of release characters pair up from the left."""
    if "release" not in sep:
        return text
    out = F.replace(text, F.concat(sep["release"], sep["release"]), F.lit(HELD["?"]))
    for c in "+:'":
        out = F.replace(out, F.concat(sep["release"], F.lit(c)), F.lit(HELD[c]))
    return out


def put_back(value: Column) -> Column:
    return F.translate(value, "".join(HELD.values()), "".join(HELD))


def edi_segments(docs: DataFrame, text: str, dialect: str) -> DataFrame:
    """Columns of docs and, per segment, seg_no (from 1), id, elements: array<array<string>> (elements of components)."""
    whole = F.col(text)
    sep = separators(whole, dialect)
    if dialect == "hl7":
        body = F.regexp_replace(whole, "\r?\n", "\r")
    else:
        body = held_back(F.when(whole.startswith("UNA"), F.substring(whole, F.lit(10), F.length(whole))).otherwise(whole) if dialect == "edifact" else whole, sep)
    if "release" in sep:
        # One pass replaces a document's own separators by fixed ones, which are split at without patterns of each row.
        body = F.call_function("translate", body, F.concat(sep["element"], sep["component"], sep["segment"]), F.lit(ELEMENT + COMPONENT + SEGMENT))
        sep = {"element": F.lit(ELEMENT), "component": F.lit(COMPONENT), "segment": F.lit(SEGMENT)}
        cut = lambda value, by: F.split(value, {"_seg": SEGMENT, "_el": ELEMENT, "_co": COMPONENT}[by], -1)
    else:
        cut = lambda value, by: split_by(value, F.col(by))
    held = docs.withColumns({"_seg": sep["segment"], "_el": sep["element"], "_co": sep["component"], "_body": body})
    rows = held.select(*docs.columns, "_el", "_co", F.posexplode(F.filter(F.transform(cut(F.col("_body"), "_seg"), lambda s: F.btrim(s, F.lit("\r\n "))), lambda s: s != "")).alias("_i", "_s"))
    if dialect == "tradacoms":
        rows = rows.withColumn("_s", F.regexp_replace("_s", "^([A-Z]{3})=", f"$1{ELEMENT}"))
    rows = rows.withColumn("_parts", cut(F.col("_s"), "_el"))
    keep_whole = (F.get("_parts", F.lit(0)).isin("MSH", "FHS", "BHS", "ISA")) if dialect in ("hl7", "x12") else F.lit(False)
    elements = F.transform(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), lambda e: F.when(keep_whole, F.array(put_back(e))).otherwise(F.transform(cut(e, "_co"), put_back)))
    return rows.select(*docs.columns, (F.col("_i") + 1).alias("seg_no"), F.get("_parts", F.lit(0)).alias("id"), elements.alias("elements"))


def element(n: int, component: int = 1) -> Column:
    """Element n (from 1) of a segment, its component (from 1); null if absent or empty."""
    return F.nullif(F.get(F.get(F.col("elements"), F.lit(n - 1)), F.lit(component - 1)), F.lit(""))


def edi_loops(segments: DataFrame, doc: list[str], loops: dict[str, Column], known: list[str] | None = None) -> DataFrame:
    """Adds, per loop (name -> trigger condition), the running number of its occurrence in the document; an inner loop (a
    later entry) starts anew with each outer one. Segments before the first trigger have 0. With `known`, another segment
    id is an error."""
    out = segments
    if known is not None:
        strange = F.raise_error(F.concat(F.lit("unknown segment "), F.col("id"))).cast("string")
        out = out.withColumn("id", F.when(F.col("id").isin(*known), F.col("id")).otherwise(strange))
    above = list(doc)
    for name, trigger in loops.items():
        out = out.withColumn(name, F.sum(F.coalesce(trigger, F.lit(False)).cast("int")).over(Window.partitionBy(*above).orderBy("seg_no")))
        above.append(name)
    return out


def loop_fields(segments: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per loop occurrence: each field is (which segment, value), the first that there is."""
    return segments.groupBy(*keys).agg(*[F.min_by(F.when(which, value), F.when(which & value.isNotNull(), F.col("seg_no"))).alias(n) for n, (which, value) in fields.items()])


def edi_render(segments: DataFrame, doc: list[str], element_sep: str = "+", component_sep: str = ":", segment_sep: str = "'", release: str = "?") -> DataFrame:
    """(doc, text): segments as text again, separators in values released."""
    specials = re.escape(element_sep + component_sep + segment_sep + release)
    escape = lambda c: F.regexp_replace(c, f"([{specials}])", (re.escape(release) if release == "\\" else release).replace("?", "?") + "$1") if release else c
    line = F.concat(F.array_join(F.concat(F.array("id"), F.transform("elements", lambda e: F.array_join(F.transform(e, escape), component_sep))), element_sep), F.lit(segment_sep))
    rows = segments.select(*doc, F.struct("seg_no", line.alias("line")).alias("s"))
    return rows.groupBy(*doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), "").alias("text"))


def control_counts(segments: DataFrame, doc: list[str], opens: str, closes: str) -> DataFrame:
    """(doc, group, n, reference): for each message from an `opens` to its `closes` segment the number of its segments, both
    counted, and the first element of its opening segment; a closing segment that was not opened is an error."""
    numbered = edi_loops(segments, doc, {"message": F.col("id") == opens})
    orphan = F.raise_error(F.concat(F.lit("not opened: "), F.col("id"))).cast("int")
    numbered = numbered.withColumn("message", F.when((F.col("message") == 0) & (F.col("id") == closes), orphan).otherwise(F.col("message")))
    w = Window.partitionBy(*doc, "message").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = numbered.withColumn("_closed", F.coalesce(F.max((F.col("id") == closes).cast("int")).over(w), F.lit(0))).where("message > 0 and _closed = 0")
    return inside.groupBy(*doc, "message").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.get(F.get("elements", F.lit(0)), F.lit(0)), "seg_no").alias("reference"))
