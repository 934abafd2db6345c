"""Value tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import compare as C
from tessella.functions import dates as D
from tessella.functions import numbers as N
from tessella.functions import paths as U
from tessella.functions import text as X

def cases():
    return [
        (X.text(F.lit(8.0)), "8"),
        (X.text(F.lit(1.5)), "1.5"),
        (X.text(F.lit(1e7)), "10000000"),
        (X.text(F.lit(1e-7)), "0.0000001"),
        (X.text(F.lit(True)), "true"),
        (X.string(F.lit(None).cast("string")), ""),
        (X.concat("a", F.lit(None).cast("string"), 1), "a1"),
        (X.concat(), ""),
        (X.normalize_space(F.lit(" a \t\n b ")), "a b"),
        (X.trim(F.lit("  a ")), "a"),
        (X.left(F.lit("abc"), 0), ""),
        (X.length(F.lit("a🙂")), 2),
        (X.contains(F.lit(None).cast("string"), ""), True),
        (X.substring(F.lit("motor car"), 0, 3), "mo"),
        (X.substring(F.lit("motor car"), 6), " car"),
        (X.substring(F.lit("12345"), 1.5, 2.6), "234"),
        (X.substring_before(F.lit("a-b"), "+"), ""),
        (X.substring_after(F.lit("a-b-c"), "-"), "b-c"),
        (X.pad_left(F.lit("12345"), 3, "0"), "12345"),
        (X.matches(F.lit("aBc"), "b", "i"), True),
        (X.replace(F.lit("abab"), "(a)(b)", "$2$1"), "baba"),
        (X.isbn10_to_isbn13(F.lit("0-306-40615-2")), "9780306406157"),
        (N.is_numeric(F.lit("1d")), False),
        (N.is_numeric(F.lit(" 1.5e3 ")), True),
        (N.to_number(F.lit("x")), None),
        (N.to_number(F.lit(str(2**53 + 1)), kind="long"), 2**53 + 1),
        (N.to_number(F.lit("1.5"), kind="long"), None),
        (F.to_json(F.struct(N.to_number(F.lit(str(2**53 + 1)), kind="variant").alias("v"))), '{"v":9007199254740993}'),
        (F.to_json(F.struct(N.to_number(F.lit(" 1.5 "), kind="variant").alias("v"))), '{"v":1.5}'),
        (N.multiply(F.lit(1e-7), F.lit(1e7)), 1.0),
        (N.multiply(F.lit(1.23456789), 1), 1.23456789),
        (N.multiply(F.lit(1e14), 2), 2e14),
        (N.multiply(F.lit(1.1), F.lit(1.1)), 1.21),
        (N.multiply(F.lit(1e300), F.lit(-1e-300)), -1.0),
        (N.multiply(F.lit(float("inf")), F.lit(2.0)), float("inf")),
        (N.floor(F.lit(2**53 + 1)), 2**53 + 1),
        (N.floor(F.lit(1e19)), 1e19),
        (N.floor(F.lit(-2.5)), -3.0),
        (N.floor(F.lit(-1e-20)), -1.0),
        (N.floor(F.lit(float("-inf"))), float("-inf")),
        (N.round_half_away(F.lit(2**53 + 1), kind="long"), 2**53 + 1),
        (N.round_half_away(F.lit(1e300), 2), 1e300),
        (C.equal(F.lit("abc"), 1), False),
        (C.equal(F.lit("1.0"), 1), False),
        (C.equal(F.lit("1"), 1.0), True),
        (C.less_than(F.lit("10"), 9), True),
        (C.not_equal(F.lit("abc"), 1), True),
        (C.greater_or_equal(F.lit(2), F.lit(1.5)), True),
        (C.equal(F.lit(None).cast("string"), 1), False),
        (N.round_half_away(F.lit(1.005), 2), 1.0),
        (N.round_half_away(F.lit(-2.5)), -3.0),
        (N.lenient_multiply(F.lit(2**62), F.lit(4)), float(2**64)),
        (N.format_number(F.lit(1234567.891), "#,##0.00"), "1,234,567.89"),
        (N.format_number(F.lit(0.256), "0.0%"), "25.6%"),
        (N.format_number(F.lit(-5), "0;(0)"), "(5)"),
        (N.format_number(F.lit(7), "000"), "007"),
        (N.format_number(F.lit(1.5), "0.0##"), "1.5"),
        (N.boolean(F.lit(float("nan")), "double"), False),
        (C.not_equal(F.lit(None).cast("int"), 1), False),
        (C.none_of(F.lit(None).cast("int"), 1), False),
        (C.value_map(F.lit(None).cast("string"), {None: "n", "a": "b"}), "n"),
        (C.value_map(F.lit("z"), {"a": "b"}), None),
        (D.weekday(F.lit("2024-01-07")), 7),
        (D.day_from_datetime(F.lit("2024-01-31T24:00:00")), 1),
        (D.datetime_add(F.lit("2024-01-31T10:00:00Z"), F.lit("P1M")), "2024-02-29T10:00:00Z"),
        (D.datetime_add(F.lit("2024-01-31T10:00:00"), F.lit("-PT1H30M")), "2024-01-31T08:30:00"),
        (D.coerce_datetime(F.lit("2024-01-31Z")), "2024-01-31T00:00:00Z"),
        (D.datetime_from_parts(2024, 2, 29, 1, 2, 3, 40, -90), "2024-02-29T01:02:03.04-01:30"),
        (D.duration_from_parts(day=1, minute=5), "P1DT5M"),
        (D.duration_from_parts(), "PT0S"),
        (D.parse_date(F.lit("5. March 2024"), "[D]. [MNn] [Y]"), "2024-03-05"),
        (D.parse_time(F.lit("1:05 pm"), "[h]:[m01] [Pn]"), "13:05:00"),
        (D.format_date(F.lit("2024-03-05"), "[FNn], [D] [MNn,*-3] [Y,2]"), "Tuesday, 5 Mar 24"),
        (D.format_time(F.lit("13:05:09"), "[h]:[m]:[s] [P]"), "1:05:09 pm"),
        (D.compact_datetime(F.lit("202403051530 PDT"), "303"), "2024-03-05T15:30:00-09:00"),
        (D.compact_datetime(F.lit("202403051530+0100"), "205"), "2024-03-05T15:30:00+01:00"),
        (U.get_folder(F.lit("a\\b/c.x")), "a\\b/"),
        (U.get_fileext(F.lit("a.b/c")), ""),
        (U.resolve_filepath(F.lit("/a/b/c"), F.lit("../d/./e")), "/a/d/e"),
        (U.resolve_filepath(F.lit("a/b"), F.lit("/x")), "/x"),
    ]


def test_value_table(spark):
    table = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(table)]).first()
    wrong = [(i, row[i], want) for i, (_, want) in enumerate(table) if row[i] != want]
    assert not wrong


@pytest.mark.parametrize("make", [lambda: N.divide(1, F.lit(0)), lambda: N.to_number(F.lit("x"), strict=True), lambda: X.isbn10_to_isbn13(F.lit("0306406153")), lambda: C.choose(F.lit(None).cast("boolean"), 1, 2), lambda: D.parse_date(F.lit("x"), "[Y]-[M01]-[D01]")])
def test_errors_are_loud(spark, make):
    with pytest.raises(Exception):
        spark.range(1).select(make()).collect()


@pytest.mark.parametrize("make", [lambda: X.matches("a", "(?=a)"), lambda: X.replace("a", "a*", ""), lambda: X.pad_left("a", 3, "xy"), lambda: D.compact_datetime("x", "999")])
def test_bad_arguments(make):
    with pytest.raises(ValueError):
        make()


def test_guids_differ(spark):
    rows = [r[0] for r in spark.range(5).select(U.create_guid()).collect()]
    assert len(set(rows)) == 5 and all(len(r) == 32 for r in rows)
