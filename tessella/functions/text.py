"""Text functions as columns. They take the text form of any value; null counts as "" where a docstring says so."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that the one-sided trims and normalize_space know (fixed value).
BLANKS = " \t\r\n"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text(value) -> Column:
    """Text form: a float in plain digits without a trailing .0, a boolean as true or false; null stays null."""
    value = as_column(value)
    kind = F.typeof(value)
    plain = value.cast("string")
    whole = F.try_to_number(F.regexp_extract(plain, r"^(-?\d{1,15})\.0$", 1), F.lit("S999999999999999")).cast("string")
    wide = F.regexp_replace(F.regexp_replace(F.when(plain.contains("E"), plain).try_cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    is_float = kind.isin("float", "double")
    return F.when(is_float & plain.rlike(r"^-?\d+\.0$"), F.coalesce(whole, F.regexp_replace(plain, r"\.0$", ""))).when(is_float & plain.contains("E"), F.coalesce(wide, plain)).otherwise(plain)


def string(value) -> Column:
    """text(), with "" for null."""
    return F.coalesce(text(value), F.lit(""))


def concat(*values) -> Column:
    """Text forms one after the other; null adds nothing, no argument gives ""."""
    return F.concat_ws("", *[text(v) for v in values]) if values else F.lit("")


def upper(value) -> Column:
    return F.upper(as_column(value))


def lower(value) -> Column:
    return F.lower(as_column(value))


def normalize_space(value) -> Column:
    """Runs of space, tab, CR and LF become one space; none at the ends."""
    return F.trim(F.regexp_replace(as_column(value), f"[{BLANKS}]+", " "))


def is_empty(value) -> Column:
    return string(value) == ""


def trim(value) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(as_column(value), r"^\p{IsWhite_Space}+", ""), r"\p{IsWhite_Space}+$", "")


def left_trim(value) -> Column:
    return F.ltrim(as_column(value), F.lit(BLANKS))


def right_trim(value) -> Column:
    return F.rtrim(as_column(value), F.lit(BLANKS))


def left(value, n) -> Column:
    return F.left(as_column(value), as_column(n))


def right(value, n) -> Column:
    return F.right(as_column(value), as_column(n))


def length(value) -> Column:
    """Characters of the text form; null has 0."""
    return F.length(string(value))


def starts_with(value, prefix) -> Column:
    return F.startswith(string(value), string(prefix))


def ends_with(value, suffix) -> Column:
    return F.endswith(string(value), string(suffix))


def contains(value, needle) -> Column:
    return F.contains(string(value), string(needle))


def flagged(pattern: str, flags: str, may_be_empty: bool = True) -> str:
    """The pattern with its flags (of i, m, s, x) in front; look-around and back-references are refused."""
    if set(flags) - set("imsx"):
        raise ValueError(f"unknown flags: {flags}")
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not part of this dialect")
    if not may_be_empty and re.search(pattern, ""):
        raise ValueError("the pattern matches an empty text")
    return f"(?{flags}){pattern}" if flags else pattern


def matches(value, pattern: str, flags: str = "") -> Column:
    """Whether the pattern is found anywhere."""
    return string(value).rlike(flagged(pattern, flags))


def replace(value, pattern: str, replacement: str, flags: str = "") -> Column:
    """All matches; $n in the replacement is a group."""
    return F.regexp_replace(string(value), flagged(pattern, flags, may_be_empty=False), replacement)


def sql_like(value, pattern: str) -> Column:
    """Whole text, % and _, without regard to case."""
    return F.ilike(as_column(value), F.lit(pattern.replace("\\", "\\\\")))


def pad_left(value, n: int, char: str) -> Column:
    return padded(value, n, char, F.lpad)


def pad_right(value, n: int, char: str) -> Column:
    return padded(value, n, char, F.rpad)


def padded(value, n: int, char: str, pad) -> Column:
    """To n characters; a longer text stays whole."""
    if len(char) != 1 or n > 1_000_000:
        raise ValueError("one pad character, and at most 1,000,000 characters")
    s = string(value)
    return F.when(F.length(s) < n, pad(s, n, char)).otherwise(s)


def substring(value, start, length=None) -> Column:
    """Characters from a 1-based start; both numbers are rounded, and what lies before the first character is cut off."""
    value, begin = as_column(value), F.floor(as_column(start) + 0.5).cast("int")
    first = F.greatest(begin, F.lit(1))
    if length is None:
        return F.substring(value, first, F.length(value))
    end = F.floor(as_column(start) + 0.5).cast("int") + F.floor(as_column(length) + 0.5).cast("int")
    return F.substring(value, first, F.greatest(end - first, F.lit(0)))


def substring_before(value, sep: str) -> Column:
    """"" without a match."""
    at = F.instr(as_column(value), sep)
    return F.when(at > 0, F.substring(as_column(value), F.lit(1), at - 1)).otherwise(F.when(as_column(value).isNotNull(), ""))


def substring_after(value, sep: str) -> Column:
    value = as_column(value)
    at = F.instr(value, sep)
    return F.when(at > 0, F.substring(value, at + len(sep), F.length(value))).otherwise(F.when(value.isNotNull(), ""))


def isbn10_to_isbn13(value) -> Column:
    """Checks the tenth digit (an error if it is wrong) and gives the 13-digit form."""
    s = F.regexp_replace(as_column(value), "[- ]", "")
    digit = lambda i: F.when(F.substring(s, i, 1) == "X", 10).otherwise(F.substring(s, i, 1).try_cast("int"))
    check = sum((11 - i) * digit(i) for i in range(1, 11)) % 11
    body = F.concat(F.lit("978"), F.substring(s, 1, 9))
    last = (10 - sum((1 if i % 2 else 3) * F.substring(body, i, 1).try_cast("int") for i in range(1, 13)) % 10) % 10
    good = s.rlike("^[0-9]{9}[0-9X]$") & (check == 0)
    return F.when(good, F.concat(body, last.cast("string"))).when(s.isNotNull(), F.raise_error(F.concat(F.lit("no ISBN-10: "), s)))
