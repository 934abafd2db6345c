"""Queries over the column functions, several to a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import compare as C
from tessella.functions import dates as D
from tessella.functions import numbers as N
from tessella.functions import paths as U
from tessella.functions import text as X
from tessella.operators import functions as R
from tessella.plans.registry import Tables, query


@query("""SELECT p_partkey, p_name || '-' || p_size AS joined, upper(p_name) AS up, lower(p_brand) AS low, left(p_name, 3) AS l3, right(p_name, 3) AS r3, length(p_name)::INT AS n,
 starts_with(p_type, 'S') AS s, ends_with(p_type, 'S') AS e, contains(p_name, 'a') AS c, regexp_matches(p_brand, '[12]$') AS m, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rep, p_type ILIKE 's%' AS lk FROM part""")
def fn_text(t: Tables) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select("p_partkey", X.concat(name, "-", F.col("p_size")).alias("joined"), X.upper(name).alias("up"), X.lower(brand).alias("low"), X.left(name, 3).alias("l3"), X.right(name, 3).alias("r3"), X.length(name).alias("n"), X.starts_with(kind, "S").alias("s"), X.ends_with(kind, "S").alias("e"), X.contains(name, "a").alias("c"), X.matches(brand, "[12]$").alias("m"), X.replace(name, "[aeiou]", "_").alias("rep"), X.sql_like(kind, "S%").alias("lk"))


@query("""SELECT o_orderkey, trim(regexp_replace('  ' || o_orderpriority || E' \\n ', E'[ \\t\\r\\n]+', ' ', 'g')) AS spaced, ltrim('  ' || o_orderpriority) AS l, rtrim(o_orderpriority || '  ') AS r, lpad(o_orderkey::VARCHAR, 12, '0') AS padded, rpad(o_orderstatus, 4, '*') AS rp,
 CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, 1, instr(o_orderpriority, '-') - 1) ELSE '' END AS before, CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE '' END AS after, substr(o_orderpriority, 1, 2) AS clipped, substr(o_orderpriority, 3) AS rest FROM orders""")
def fn_text_space(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", X.normalize_space(F.concat(F.lit("  "), p, F.lit(" \n "))).alias("spaced"), X.left_trim(F.concat(F.lit("  "), p)).alias("l"), X.right_trim(F.concat(p, F.lit("  "))).alias("r"), X.pad_left(F.col("o_orderkey"), 12, "0").alias("padded"), X.pad_right(F.col("o_orderstatus"), 4, "*").alias("rp"), X.substring_before(p, "-").alias("before"), X.substring_after(p, "-").alias("after"), X.substring(p, 0, 3).alias("clipped"), X.substring(p, 3).alias("rest"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS added, l_extendedprice - l_discount AS less, l_extendedprice / l_quantity AS ratio, floor(l_extendedprice) AS fl, floor(l_extendedprice * 10 + 0.5) / 10 AS r1,
 l_quantity::BIGINT::VARCHAR AS shown, l_partkey * l_suppkey AS product FROM lineitem""")
def fn_numbers(t: Tables) -> DataFrame:
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", N.add(price, F.col("l_tax")).alias("added"), N.subtract(price, F.col("l_discount")).alias("less"), N.divide(price, qty).alias("ratio"), N.floor(price).alias("fl"), N.round_half_away(price, 1).alias("r1"), X.text(qty).alias("shown"), N.multiply_whole(F.col("l_partkey"), F.col("l_suppkey")).alias("product"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity::DECIMAL(12,2) * l_extendedprice::DECIMAL(12,2))::DOUBLE AS exact, format('{:,}', l_partkey) AS grouped FROM lineitem""")
def fn_exact_numbers(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", N.multiply(F.col("l_quantity"), F.col("l_extendedprice")).alias("exact"), N.format_number(F.col("l_partkey"), "#,##0").alias("grouped"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS eq, l_returnflag <> 'R' AS ne, l_quantity < 10 AS lt, l_quantity > 10 AS gt, l_quantity <= 10 AS le, l_quantity >= 10 AS ge, (l_quantity < 10 AND l_tax > 0) AS both_hold, (l_quantity < 10 OR l_tax > 0) AS any_holds, NOT (l_tax > 0) AS neg, l_discount <> 0 AS truth FROM lineitem""")
def fn_compare(t: Tables) -> DataFrame:
    q, flag, tax = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_tax")
    small, taxed = C.less_than(q, 10), C.greater_than(tax, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", C.equal(flag, "R").alias("eq"), C.not_equal(flag, "R").alias("ne"), small.alias("lt"), C.greater_than(q, 10).alias("gt"), C.less_or_equal(q, 10).alias("le"), C.greater_or_equal(q, 10).alias("ge"), C.all_of(small, taxed).alias("both_hold"), C.any_of(small, taxed).alias("any_holds"), C.negated(taxed).alias("neg"), N.boolean(F.col("l_discount"), "double").alias("truth"))


@query("""SELECT c_custkey, coalesce(o_orderkey, -1) AS key, o_orderkey IS NOT NULL AS present, coalesce(o_orderkey::VARCHAR, '') = '' AS empty, coalesce(try_cast(o_orderpriority[1] AS DOUBLE), 0) AS priority, try_cast(o_orderpriority[1] AS DOUBLE) IS NOT NULL AS numeric FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def fn_presence(t: Tables) -> DataFrame:
    rows, digit = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left"), X.left(F.col("o_orderpriority"), 1)
    return rows.select("c_custkey", C.substitute_missing(F.col("o_orderkey"), -1).alias("key"), C.exists(F.col("o_orderkey")).alias("present"), X.is_empty(F.col("o_orderkey")).alias("empty"), F.coalesce(N.to_number(digit), F.lit(0.0)).alias("priority"), N.is_numeric(digit).alias("numeric"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%H:%M:%S') AS time, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, isodow(o_orderdate)::INT AS w, hour(o_orderdate)::INT AS h, minute(o_orderdate)::INT AS mi,
 strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:00' AS made, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%S') AS later, strftime(o_orderdate, '%d %B %Y') AS shown FROM orders""")
def fn_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", D.date_from_datetime(d).alias("date"), F.left(D.time_from_datetime(d), F.lit(8)).alias("time"), D.year_from_datetime(d).alias("y"), D.month_from_datetime(d).alias("m"), D.day_from_datetime(d).alias("d"), D.weekday(d).alias("w"), D.hours_from_datetime(d).alias("h"), D.minutes_from_datetime(d).alias("mi"), D.datetime_from_date_and_time(D.date_from_datetime(d), F.lit("08:30:00")).alias("made"), D.datetime_add(d, F.lit("P1M")).alias("later"), D.format_date(d, "[D01] [MNn] [Y]").alias("shown"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS parsed, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS edi, strftime(ts, '%Y-%m-%dT00:00:00') AS midnight, strftime(date_trunc('month', ts), '%Y-%m-%dT00:00:00') AS parts, 'P' || (user_id % 20 + 1) || 'D' AS duration FROM events""")
def fn_date_parts(t: Tables) -> DataFrame:
    shown = D.format_datetime(F.col("ts"), "[D01]/[M01]/[Y] [H01]:[m01]:[s01]")
    rows = t.events.withColumn("shown", shown).withColumn("compact", F.date_format("ts", "yyyyMMddHHmmss"))
    return rows.select("event_id", D.parse_date(F.substring_index("shown", " ", 1), "[D01]/[M01]/[Y]").alias("parsed"), D.parse_time(F.substring_index("shown", " ", -1), "[H01]:[m01]:[s01]").alias("clock"), D.compact_datetime(F.col("compact"), "204").alias("edi"), D.coerce_datetime(F.to_date("ts")).alias("midnight"), D.datetime_from_parts(F.year("ts"), F.month("ts"), 1).alias("parts"), D.duration_from_parts(day=F.col("user_id") % 20 + 1).alias("duration"))


@query("""SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]*)$', 1) AS ext, regexp_extract(url, '^(.*/)', 1) IS NOT NULL AS has, '/d' || page_id || '/x.html' AS resolved FROM pages""")
def fn_paths(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", U.get_folder(url).alias("folder"), U.remove_folder(url).alias("name"), U.get_fileext(url).alias("ext"), U.get_folder(url).isNotNull().alias("has"), U.resolve_filepath(F.concat(F.lit("/d"), "page_id", F.lit("/e/"), U.remove_folder(url)), F.lit(".././x.html")).alias("resolved"))


@query("""SELECT event_id, '{"event":{"type":"' || event_type || '","user":' || user_id || '}}' AS json, (props->>'$.k')::BIGINT AS k FROM events""")
def fn_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", U.json_object({"event.type": F.col("event_type"), "event.user": F.col("user_id")}).alias("json"), U.json_field(F.col("props"), "k BIGINT", "k").alias("k"))


@query("""SELECT p_partkey, p_size::VARCHAR = '7' AS eq, p_size::VARCHAR <> '7' AS ne, p_size::VARCHAR < '7' AS lt, p_size::VARCHAR > '7' AS gt, p_size::VARCHAR <= '7' AS le, p_size::VARCHAR >= '7' AS ge, p_brand = p_size::VARCHAR AS words FROM part""")
def fn_compare_text_with_numbers(t: Tables) -> DataFrame:
    """A text beside a number: both are compared as texts."""
    size, seven = F.col("p_size"), F.lit("7")
    return t.part.select("p_partkey", C.equal(size, seven).alias("eq"), C.not_equal(size, seven).alias("ne"), C.less_than(size, seven).alias("lt"), C.greater_than(seven.cast("string"), size).alias("lt2"), C.greater_than(size, seven).alias("gt"), C.less_or_equal(size, seven).alias("le"), C.greater_or_equal(size, seven).alias("ge"), C.equal(F.col("p_brand"), size).alias("words")).drop("lt2")


@query("""SELECT o_orderkey, o_orderkey + 9007199254740992 AS fl, o_orderkey + 9007199254740993 AS ro, o_orderkey + 9007199254740992 AS num, (o_custkey::DECIMAL(18,0) * 12345678 / 100000000)::DOUBLE AS tiny, o_orderkey::DOUBLE * 1e19 AS big FROM orders""")
def fn_large_numbers(t: Tables) -> DataFrame:
    """Whole numbers beyond 2^53, small and large factors, floats beyond any long."""
    key = F.col("o_orderkey").cast("long") + 2**53
    return t.orders.select("o_orderkey", N.floor(key).alias("fl"), N.round_half_away(key + 1, kind="long").alias("ro"), N.to_number(key.cast("string"), kind="long").alias("num"), N.multiply(F.col("o_custkey"), F.lit(0.12345678)).alias("tiny"), N.floor(N.multiply(F.col("o_orderkey"), F.lit(1e19))).alias("big"))


@query("""SELECT event_id, event_type AS trimmed, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS parsed, strftime(ts, '%H.%M') AS clock, event_id % 3 = 0 AS nil, event_id % 3 = 0 OR event_id % 2 = 0 AS nil_or_missing, true AS guid, 'jobs/shape.map' AS mapping, true AS known FROM events""")
def fn_rest(t: Tables) -> DataFrame:
    """Trim, texts to times and back, explicit nils, random identifiers, values of the run."""
    nil, value = F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 != 0, F.col("event_type"))
    shown = D.format_datetime(F.col("ts"), "[Y]/[M01]/[D01] [H01]:[m01]:[s01]")
    guid, rows = U.create_guid(), t.events.withColumn("shown", shown)
    return rows.select("event_id", X.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"), D.parse_datetime(F.col("shown"), "[Y]/[M01]/[D01] [H01]:[m01]:[s01]").alias("parsed"), D.format_time(D.time_from_datetime(F.col("ts")), "[H01].[m01]").alias("clock"), C.is_nil(nil).alias("nil"), C.substitute_missing_with_nil(value, nil).alias("nil_or_missing"), guid.rlike("^[0-9a-f]{32}$").alias("guid"), R.runtime_value("mapping_path", "jobs/shape.map").alias("mapping"), R.runtime_value("current_datetime").rlike("^20[0-9]{2}-").alias("known"))


@query("""SELECT p_partkey, ((p_size * 2 + 1) * 2 + 1)::BIGINT AS nested, round(p_retailprice / 4, 4) AS quarter, CASE WHEN p_brand LIKE '%1' THEN '/' || p_brand || '/x' ELSE '/lib/' || p_brand || '/x' END AS resolved FROM part""")
def d2_nested_calls(t: Tables) -> DataFrame:
    """User functions that call user functions, and paths of columns resolved against paths of columns."""
    odd = R.UserFunction("odd", {"x": "long"}, "long", lambda x: x * 2 + 1)
    half = R.UserFunction("half", {"x": "double"}, "double", lambda x: x / 2)
    quarter = R.UserFunction("quarter", {"x": "double"}, "double", lambda x: half(half(x)))
    base = F.concat(F.lit("/lib/"), "p_brand", F.lit("/base.txt"))
    path = F.when(F.col("p_brand").endswith("1"), F.concat(F.lit("../../"), "p_brand", F.lit("/./x"))).otherwise(F.lit("x"))
    return t.part.select("p_partkey", odd(odd(F.col("p_size"))).alias("nested"), F.round(quarter(F.col("p_retailprice")), 4).alias("quarter"), U.resolve_filepath(base, path).alias("resolved"))
