"""Number functions. Whole numbers stay whole and overflow is an error (ANSI mode); numeric text is read as a number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import as_column, string

#: Text that counts as a number (fixed value).
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_numeric(value) -> Column:
    value = as_column(value)
    s = value.cast("string")
    return F.coalesce(s.rlike(NUMERIC), F.lit(False))


def to_number(value, strict: bool = False, kind: str = "double") -> Column:
    """A number from text: null if it is none, or an error with strict. kind: "double", "long" (null, or an error, for what is
    no whole number of that range), or "variant" (a long where that is possible, a double elsewhere)."""
    s = F.trim(as_column(value).cast("string"))
    known = s.rlike(NUMERIC)
    whole = F.when(known & s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))
    found = whole if kind == "long" else F.when(known, s.try_cast("double"))
    if kind == "variant":
        found = F.coalesce(whole.cast("variant"), found.cast("variant"))
    wrong = F.raise_error(F.concat(F.lit("not a number: "), s)).cast(kind if kind != "variant" else "long")
    return F.coalesce(found, F.when(s.isNotNull(), wrong).cast(kind)) if strict else found


def add(*values) -> Column:
    return reduce(lambda a, b: a + b, map(as_column, values))


def subtract(*values) -> Column:
    return reduce(lambda a, b: a - b, map(as_column, values))


def scientific(value: Column) -> tuple[Column, Column]:
    """(digits as a decimal, power of ten) of a number's decimal text; nulls for NaN and infinity."""
    s = value.cast("string")
    part = lambda i: F.regexp_extract(s, r"^(-?\d+)(?:\.(\d+))?(?:E([+-]?\d+))?$", i)
    digits = F.concat(part(1), part(2)).try_cast("decimal(19,0)")
    return digits, F.coalesce(part(3).try_cast("int"), F.lit(0)) - F.length(part(2))


def multiply(a, b) -> Column:
    """A float: the decimal texts of both numbers are multiplied exactly and the product is rounded once, at any magnitude.
    multiply_whole() is for whole numbers."""
    a, b = as_column(a), as_column(b)
    (x, i), (y, j) = scientific(a), scientific(b)
    exact = F.concat((x * y).cast("string"), F.lit("E"), (i + j).cast("string")).try_cast("double")
    # Numbers of at most 4 decimals, as whole numbers whose product is exact: the division rounds once.
    m, n = F.rint(a.cast("double") * 1e4), F.rint(b.cast("double") * 1e4)
    plain = lambda c, k: F.typeof(c).isin("double", "int", "bigint") & (F.abs(c.cast("double")) < 1e11) & (k / 1e4 == c.cast("double"))
    short = plain(a, m) & plain(b, n) & (F.abs(m * n) < float(2**53))
    return F.when(short, m * n / 1e8 + 0.0).otherwise(F.coalesce(exact, a.cast("double") * b.cast("double")))


def multiply_whole(a, b) -> Column:
    return as_column(a) * as_column(b)


def divide(a, b) -> Column:
    """Always a float; division by zero is an error."""
    return as_column(a).cast("double") / as_column(b).cast("double")


def positive(value) -> Column:
    return +1 * as_column(value)


def floor(value) -> Column:
    """A whole number stays as it is, a float stays a float of any size."""
    value = as_column(value)
    rest = value % 1  # has the sign of the value
    return F.when(F.isnan(rest.cast("double")), value).otherwise(value - rest - F.when(rest < 0, 1).otherwise(0))


def round_half_away(value, digits: int = 0, kind: str = "double") -> Column:
    """Half away from zero, computed on the double. kind "long": a whole number, which stays as it is."""
    if kind == "long":
        return as_column(value)
    value, k = as_column(value).cast("double"), float(10**digits)
    whole = floor(F.abs(value) * k)
    up = (whole + F.when(F.abs(value) * k - whole >= 0.5, 1.0).otherwise(0.0)) / k
    return F.when(F.abs(value) * k < float(2**53), F.signum(value) * up).otherwise(value)


def lenient_multiply(a, b) -> Column:
    """Null with null; a product of whole numbers that overflows becomes a float."""
    a, b = as_column(a), as_column(b)
    return F.coalesce(F.try_multiply(a, b).cast("double"), a.cast("double") * b.cast("double"))


def format_number(value, picture: str, decimal: str = ".", group: str = ",") -> Column:
    """A number by a picture such as '#,##0.00', '0.0%' or '#,##0;(#,##0)': optional second part for negatives,
    grouping, percent and per mille, rounded half up. The picture is read once, on the driver."""
    parts = picture.split(";")
    plus, minus = parts[0], parts[1] if len(parts) > 1 else None

    def one(amount: Column, pattern: str) -> Column:
        marks = "#0" + decimal + group
        first = next(i for i, c in enumerate(pattern) if c in marks)
        last = len(pattern) - next(i for i, c in enumerate(reversed(pattern)) if c in marks)
        prefix, body, suffix = pattern[:first], pattern[first:last], pattern[last:]
        scale = 100 if "%" in prefix + suffix else 1000 if "‰" in prefix + suffix else 1
        whole, _, frac = body.partition(decimal)
        most, least = len(frac), frac.count("0")
        rounded = F.round((amount * scale).cast("decimal(38,12)"), most)
        if group in whole:
            if len(whole) - whole.rfind(group) != 4:
                raise ValueError("groups of three only")
            out = F.format_number(rounded, most)
        else:
            out = F.regexp_replace(F.format_number(rounded, most), ",", "")
        for _ in range(most - least):
            out = F.regexp_replace(out, rf"(\.\d{{{least},}}?)0$", "$1")
        out = F.regexp_replace(out, r"\.$", "") if most else out
        need = whole.count("0")
        if need == 0:
            out = F.regexp_replace(out, r"^0(?=\.)", "")
        elif need > 1 and group not in whole:
            digits = F.regexp_extract(out, r"^\d+", 0)
            out = F.concat(F.when(F.length(digits) < need, F.lpad(digits, need, "0")).otherwise(digits), F.regexp_replace(out, r"^\d+", ""))
        out = F.translate(out, ",.", group + decimal) if group + decimal != ",." else out
        return F.concat(F.lit(prefix), out, F.lit(suffix))

    value = as_column(value)
    negative = one(F.abs(value), minus) if minus is not None else F.concat(F.lit("-"), one(F.abs(value), plus))
    return F.when(value < 0, negative).otherwise(one(value, plus))


def boolean(value, kind: str) -> Column:
    """Truth of a value of the given Spark type: null, 0, NaN and "" are false."""
    value = as_column(value)
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    if kind == "string":
        return string(value) != ""
    return F.coalesce((value != 0) & ~F.isnan(value.cast("double")), F.lit(False))
