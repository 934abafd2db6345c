"""Queries over joins, grouping, sequences, trees and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import checks as V
from tessella.operators import grouping as A
from tessella.operators import joins as J
from tessella.operators import sequences as G
from tessella.operators import trees as H
from tessella.operators.ranges import find_in_range
from tessella.operators.totals import totals
from tessella.ordinal import with_ordinal
from tessella.plans.registry import Tables, query


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_inner_join(t: Tables) -> DataFrame:
    return J.inner_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey::VARCHAR = r_regionkey::VARCHAR")
def j1_mixed_keys(t: Tables) -> DataFrame:
    regions = t.region.withColumn("r_regionkey", F.col("r_regionkey").cast("string"))
    return J.inner_join(t.nation, regions, [("n_regionkey", "r_regionkey")]).select("r_name", "n_name")


@query("SELECT c_custkey, o_orderkey, l_linenumber, l_extendedprice FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def j2_n_way_join(t: Tables) -> DataFrame:
    out = J.join_chain(t.customer, [(t.orders, [("c_custkey", "o_custkey")]), (t.lineitem, [("o_orderkey", "l_orderkey")])])
    return out.select("c_custkey", "o_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT n_name, r_name FROM nation, (SELECT * FROM region WHERE r_regionkey = 1)")
def j3_singleton(t: Tables) -> DataFrame:
    return J.with_singleton(t.nation, t.region.where("r_regionkey = 1")).select("n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def j4_correlated_join(t: Tables) -> DataFrame:
    return J.join_chain(t.orders, [(t.lineitem, [("o_orderkey", "l_orderkey")]), (t.part, [("l_partkey", "p_partkey")])]).select("o_orderkey", "l_linenumber", "p_brand")


@query("SELECT row_number() OVER (ORDER BY c_custkey, o_orderkey) AS place, c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def j6_join_position(t: Tables) -> DataFrame:
    pairs = J.inner_join(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")
    return with_ordinal(pairs, ["c_custkey", "o_orderkey"], "place")


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer")
def j7_lookup(t: Tables) -> DataFrame:
    return J.lookup(t.customer, t.orders, [("c_custkey", "o_custkey")], ["o_orderkey"], {"o_orderkey": "first_order"}).select("c_custkey", "first_order")


@query("SELECT o_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_quantity > 40) AS part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j8_find(t: Tables) -> DataFrame:
    return J.find(t.orders.select("o_orderkey"), t.lineitem, [("o_orderkey", "l_orderkey")], F.col("l_quantity") > 40, F.col("l_partkey"), ["l_linenumber", "l_partkey"], "part")


@query("SELECT o_custkey, (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_custkey AND l_quantity > 40 AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_custkey AND l_quantity > 40)) AS part FROM orders")
def j8_find_for_repeated_rows(t: Tables) -> DataFrame:
    """Rows that are equal in all columns are each a row of the result."""
    return J.find(t.orders.select("o_custkey"), t.lineitem, [("o_custkey", "l_orderkey")], F.col("l_quantity") > 40, F.col("l_partkey"), ["l_linenumber", "l_partkey"], "part")


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE c_acctbal BETWEEN o_totalprice / 100 AND o_totalprice / 40) AS o_orderkey FROM customer")
def j8_first_range(t: Tables) -> DataFrame:
    """The first order whose range of amounts holds the customer's balance: no pairs of all customers and orders are made."""
    ranges = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100).alias("low"), (F.col("o_totalprice") / 40).alias("high"))
    return find_in_range(t.customer.select("c_custkey", "c_acctbal"), ranges, "c_acctbal", "low", "high", ["o_orderkey"], F.col("o_orderkey"), "o_orderkey").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AND o_totalprice < c_acctbal * 10) AS o_orderkey FROM customer")
def j8_first_smaller(t: Tables) -> DataFrame:
    """The first order of a status whose price is below a bound; the other side is open."""
    asked = t.customer.select("c_custkey", (F.col("c_acctbal") * 10).alias("bound"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("status"))
    return find_in_range(asked, t.orders, "bound", "o_totalprice", None, ["o_orderkey"], F.col("o_orderkey"), "o_orderkey", [("status", "o_orderstatus")], (False, False)).select("c_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size IN (7, 12) OR p_size::VARCHAR = '20' THEN 'listed' ELSE 'other' END AS size, (SELECT n_name FROM nation WHERE p_partkey % 3 = 0 AND n_nationkey = p_size) AS n_name FROM part")
def x6_and_j7_mixed_types(t: Tables) -> DataFrame:
    """Options of several types beside one value, and a lookup whose needle is text where the key is a whole number, or not."""
    from tessella.functions import compare as C

    nation = t.nation.withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    rows = t.part.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("long")).alias("key"), F.concat("p_brand", F.lit("")).alias("words"))
    found = J.lookup(rows, nation, [("key", "n_nationkey")], ["n_nationkey"], {"n_name": "n_name"})
    missed = J.lookup(found, nation, [("words", "n_nationkey")], ["n_nationkey"], {"n_name": "none"})
    listed = C.one_of(F.col("p_size"), 7, "20", 12) & C.none_of(F.col("words"), 7, 1.5, True) & F.col("none").isNull()
    return missed.select("p_partkey", F.when(listed, "listed").otherwise("other").alias("size"), "n_name")


@query("SELECT k, count(*) FILTER (l_quantity > 30) AS n, (sum(l_orderkey) FILTER (l_quantity > 30))::BIGINT AS total, min(l_orderkey * 10 + l_linenumber) FILTER (l_quantity > 30) AS first FROM (SELECT *, nullif(l_suppkey % 5, 0) AS k FROM lineitem) GROUP BY 1")
def p11_and_a11_null_keys(t: Tables) -> DataFrame:
    """Null is a key: first rows, sequences and join aggregates of its group."""
    from tessella.operators import shape as P

    rows = t.lineitem.select(F.nullif(F.col("l_suppkey") % 5, F.lit(0)).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_orderkey", "l_quantity")
    groups, kept = rows.select("k").distinct(), rows.where("l_quantity > 30")
    firsts = P.first_or_empty(groups, kept.select("k", F.col("line").alias("first")), ["k"], ["first"])
    listed = P.mapped_sequence(firsts, kept, ["k"], F.col("line"), ["line"], "lines").withColumn("n", F.size("lines").cast("long")).drop("lines")
    return J.join_totals(listed, ["k"], kept, {"total": F.sum("l_orderkey")}).select("k", "n", "total", "first")


@query("SELECT event_id, k % 3 = 0 AS same FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)")
def v18_unique_json(t: Tables) -> DataFrame:
    """Items of JSON arrays that are equal in value: names in another order, whole numbers written as floats."""
    k = F.get_json_object("props", "$.k").cast("long")
    items = F.concat(F.lit('[{"a":1,"b":['), k.cast("string"), F.lit('.50]},{"b":['), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.lit("-1")), F.lit('],"a":1.0e0},"x"]'))
    return t.events.select("event_id", (~V.unique_json_items(items)).alias("same"))


@query("SELECT 'rule 2: order ' || o_orderkey || ' of ' || o_custkey AS message, 0::BIGINT AS written FROM orders WHERE o_totalprice < 5000 OR o_orderkey = (SELECT min(o_orderkey) FROM orders) ORDER BY o_custkey, o_orderkey LIMIT 1")
def v1_failure_rules(t: Tables) -> DataFrame:
    """A job whose second rule fails: the error names the first offending row, and nothing is written."""
    from tessella.sources import writers as K

    first, path = t.orders.agg(F.min("o_orderkey").alias("least")), t.scratch("failing")
    orders = t.orders.crossJoin(F.broadcast(first))
    offends = (F.col("o_totalprice") < 5000) | (F.col("o_orderkey") == F.col("least"))
    rules = [V.FailureRule(t.customer, F.col("c_custkey") >= 0, F.lit("no key"), ["c_custkey"], "false"), V.FailureRule(orders, offends, F.concat(F.lit("order "), "o_orderkey", F.lit(" of "), "o_custkey"), ["o_custkey", "o_orderkey"]), V.FailureRule(t.customer, None, F.lit("any"), ["c_custkey"], "all")]
    try:
        K.run_outputs({"orders": t.orders}, path, failures=rules)
        message = "none"
    except V.Violation as e:
        message = str(e)
    left = t.spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).count() if K.hadoop(t.spark, path)[0].exists(K.hadoop(t.spark, path)[1]) else 0
    return t.orders.agg(F.lit(message).alias("message"), F.lit(left).cast("long").alias("written"))


@query("SELECT o_orderkey, nullif(o_custkey % 7, 0) AS k, count(*) OVER (PARTITION BY nullif(o_custkey % 7, 0)) AS n FROM orders")
def a10_total_of_null_keys(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"))
    return A.with_group_total(rows, ["k"], {"n": A.item_count()})


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1")
def a2_sum_beside_large_items(t: Tables) -> DataFrame:
    """Each order's prices beside two amounts that cancel, and a mean of amounts whose sum is no float."""
    price = F.col("l_extendedprice")
    items = t.lineitem.select("l_orderkey", F.explode(F.array(price, F.lit(1e100), F.lit(-1e100))).alias("x"))
    sums = totals(items, ["l_orderkey"], {"total": ("sum", "x")})
    means = totals(t.lineitem, ["l_orderkey"], {"m": ("avg", price * 1e303)})
    return sums.join(means, "l_orderkey").select("l_orderkey", F.round("total", 2).alias("total"), F.round(F.col("m") / 1e303, 6).alias("mean"))


@query("SELECT l_orderkey, sum(l_quantity) AS total, sum(l_quantity) / (5 * count(*)) AS mean, 5 * count(*) AS n FROM lineitem GROUP BY 1")
def a2_exact_sums(t: Tables) -> DataFrame:
    """Each line's quantity beside amounts of several sizes that cancel, in any order: sums have no rounding but the last."""
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    items = t.lineitem.select("l_orderkey", F.explode(F.array(price * 1e30, F.lit(2.0**47) * qty, qty, -price * 1e30, F.lit(-(2.0**47)) * qty)).alias("x"))
    return totals(items, ["l_orderkey"], {"total": ("sum", "x"), "mean": ("avg", "x"), "n": ("rows", "x")})


@query("SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY f) AS g FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)")
def a20_grouped_by_one_mode(t: Tables) -> DataFrame:
    return A.group_rows(t.events, ["event_id"], ["user_id"], "g", by=["event_type"]).select("user_id", "event_id", "g")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j9_with_match(t: Tables) -> DataFrame:
    return J.with_match(t.customer, t.orders.where("o_orderstatus = 'F'"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j10_without_match(t: Tables) -> DataFrame:
    return J.without_match(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity * p_size AS volume FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity * p_size > 500")
def j11_computed_column(t: Tables) -> DataFrame:
    out = J.inner_join(t.lineitem, t.part, [("l_partkey", "p_partkey")]).withColumn("volume", F.col("l_quantity") * F.col("p_size"))
    return out.where("volume > 500").select("l_orderkey", "l_linenumber", "volume")


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def a1_reducers(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    out = totals(t.lineitem, ["l_orderkey"], {"n": ("rows", price), "total": ("sum", price), "mean": ("avg", "l_quantity"), "low": ("min", price), "high": ("max", price)})
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def a6_string_join(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(A.string_join("n_name", ["n_nationkey"], "; ").alias("names"))


@query("SELECT l_orderkey, max(CASE WHEN r = 2 THEN l_partkey END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY 1")
def a7_item_at(t: Tables) -> DataFrame:
    return A.item_at(t.lineitem, ["l_orderkey"], "l_partkey", ["l_linenumber", "l_partkey"], 2, "second")


@query("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY 1")
def a8_computed_aggregate(t: Tables) -> DataFrame:
    return totals(t.lineitem, ["l_orderkey"], {"revenue": ("sum", F.col("l_extendedprice") * (1 - F.col("l_discount")))}).withColumn("revenue", F.round("revenue", 4))


@query("SELECT c_custkey, coalesce(round(sum(l_quantity), 2), 0) AS quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a9_multi_level_aggregate(t: Tables) -> DataFrame:
    lines = J.inner_join(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")]).withColumnRenamed("o_custkey", "c_custkey")
    return J.join_totals(t.customer.select("c_custkey"), ["c_custkey"], lines, {"quantity": F.round(F.sum("l_quantity"), 2)}, {"quantity": 0.0})


@query("SELECT l.l_orderkey, l_linenumber, round(l_quantity / total, 8) AS share FROM lineitem l JOIN (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) s ON s.l_orderkey = l.l_orderkey")
def a10_enclosing_total(t: Tables) -> DataFrame:
    out = A.with_group_total(t.lineitem, ["l_orderkey"], {"total": F.sum("l_quantity")})
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / F.col("total"), 8).alias("share"))


@query("SELECT n_nationkey, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a11_join_aggregate(t: Tables) -> DataFrame:
    tuples = J.inner_join(t.customer, t.orders, [("c_custkey", "o_custkey")]).withColumnRenamed("c_nationkey", "n_nationkey")
    return J.join_totals(t.nation.select("n_nationkey"), ["n_nationkey"], tuples, {"orders": F.count("o_orderkey")}, {"orders": 0})


@query("SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY min(o_orderkey)) AS group_number FROM orders GROUP BY 1")
def a12_group_by(t: Tables) -> DataFrame:
    return A.group_by(t.orders, ["o_orderpriority"], {"n": A.item_count()}, ["o_orderkey"], "group_number").drop("first_seen")


@query("SELECT user_id, event_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS f FROM events)")
def a13_adjacent_groups(t: Tables) -> DataFrame:
    return A.group_adjacent(t.events, "event_type", ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "run")


@query("SELECT event_id, sum(f) OVER (ORDER BY ts, event_id)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS f FROM events)")
def a13_adjacent_groups_of_all(t: Tables) -> DataFrame:
    return A.group_adjacent_global(t.events.select("event_id", "ts", "event_type"), "event_type", ["ts", "event_id"]).select("event_id", "run")


@query("SELECT event_id, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM events")
def a14_starting_groups(t: Tables) -> DataFrame:
    return A.group_starting_with(t.events, F.col("event_type") == "click", ["ts", "event_id"], ["user_id"]).select("event_id", "run")


@query("SELECT event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM events")
def a15_ending_groups(t: Tables) -> DataFrame:
    return A.group_ending_with(t.events, F.col("event_type") == "purchase", ["ts", "event_id"], ["user_id"]).select("event_id", "run")


@query("SELECT user_id, ((r - 1) // 5)::BIGINT AS block, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2")
def a16_blocks(t: Tables) -> DataFrame:
    out = A.group_into_blocks(t.events, 5, ["ts", "event_id"], ["user_id"])
    return out.groupBy("user_id", "block").agg(A.item_count().alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderpriority, arg_min(o_custkey, o_orderkey) AS custkey, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def a17_group_fields(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_orderpriority").agg(A.first_member(["o_custkey", "o_orderstatus"], ["o_orderkey"]).alias("f"))
    return out.select("o_orderpriority", F.col("f.o_custkey").alias("custkey"), F.col("f.o_orderstatus").alias("status"))


@query("SELECT r_name, n_name, count(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def a18_nested_groups(t: Tables) -> DataFrame:
    rows = J.join_chain(t.region, [(t.nation, [("r_regionkey", "n_regionkey")]), (t.supplier, [("n_nationkey", "s_nationkey")])])
    inner = rows.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"))
    outer = inner.groupBy("r_name").agg(F.collect_list(F.struct("n_name", "suppliers")).alias("nations"))
    return outer.select("r_name", F.explode("nations").alias("n")).select("r_name", "n.*")


@query("SELECT event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def a19_distinct_values(t: Tables) -> DataFrame:
    return A.distinct_values(t.events.select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id")


@query("SELECT p_partkey, len(str_split(p_name, ' '))::INT AS n, str_split(p_name, ' ')[2] AS second, list_max([length(x) for x in str_split(p_name, ' ')])::INT AS longest FROM part")
def g1_tokenize(t: Tables) -> DataFrame:
    words = G.tokenize(F.col("p_name"), " ")
    return t.part.select("p_partkey", F.size(words).alias("n"), G.sequence_item_at(words, 2).alias("second"), G.sequence_aggregate("max", words, value=lambda x, i: F.length(x)).alias("longest"))


@query("SELECT c_custkey, i::INT AS place, substr(c_name, 1 + 5 * (i - 1), 5) AS chunk FROM customer, range(1, 50) r(i) WHERE 5 * (i - 1) < length(c_name)")
def g2_tokenize_by_length(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.posexplode(G.tokenize_by_length(F.col("c_name"), 5)).alias("i", "chunk")).select("c_custkey", (F.col("i") + 1).alias("place"), "chunk")


@query("SELECT doc_id, len(regexp_split_to_array(text, '[,.]'))::INT AS n FROM documents WHERE text <> ''")
def g3_tokenize_regex(t: Tables) -> DataFrame:
    return t.documents.where("text <> ''").select("doc_id", F.size(G.tokenize_regex(F.col("text"), "[,.]")).alias("n"))


@query("SELECT l_orderkey, count(*) AS units, max(unit) AS largest FROM (SELECT l_orderkey, unnest(range(1, l_quantity::BIGINT + 1)) AS unit FROM lineitem) GROUP BY 1")
def g4_generate(t: Tables) -> DataFrame:
    units = t.lineitem.select("l_orderkey", F.explode(G.generate(1, F.col("l_quantity"))).alias("unit"))
    return units.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("units"), F.max("unit").alias("largest"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(^| )[a-c]')")
def g6_sequence_exists(t: Tables) -> DataFrame:
    return t.part.where(G.sequence_exists(G.tokenize(F.col("p_name"), " "), lambda w: w.rlike("^[a-c]"))).select("p_partkey")


@query("SELECT event_id, upper(event_type) || '/' || (props->>'$.k') AS joined FROM events")
def g8_sequence_aggregate(t: Tables) -> DataFrame:
    items = F.array(F.upper("event_type"), F.get_json_object("props", "$.k"), F.lit(""))
    return t.events.select("event_id", G.sequence_aggregate("string_join", items, where=lambda x: x != "", sep="/").alias("joined"))


@query("WITH w AS (SELECT p_partkey, unnest(str_split(p_name, ' ')) AS word FROM part) SELECT p_partkey, word FROM (SELECT p_partkey, word, row_number() OVER (PARTITION BY p_partkey ORDER BY word) AS r FROM w) WHERE r = 1")
def g9_iterate_sequence(t: Tables) -> DataFrame:
    from tessella.operators.windows import select_rows

    words = t.part.select("p_partkey", F.explode(G.tokenize(F.col("p_name"), " ")).alias("word"))
    return select_rows(words, [("first", 1)], ["word"], ["p_partkey"]).select("p_partkey", "word")


@query("WITH u AS (SELECT 'root' || substr(url, instr(url, '://') + 2) AS path FROM pages), p AS (SELECT str_split(path, '/') AS a FROM u), d AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS path, i FROM p, range(1, 30) r(i) WHERE i < len(a)) SELECT path, CASE WHEN i > 1 THEN rtrim(regexp_replace(path, '[^/]*$', ''), '/') END AS parent FROM d")
def h2_path_hierarchy(t: Tables) -> DataFrame:
    paths = t.pages.select(F.concat(F.lit("root"), F.expr("substring(url, instr(url, '://') + 2)")).alias("path"), "page_id")
    folders, _ = H.path_hierarchy(paths, "path", "/", "page_id")
    return folders.select("path", "parent")


@query("WITH RECURSIVE e AS (SELECT 'world' AS key, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), t AS (SELECT key, 0 AS depth, key AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.key, depth + 1, path || '/' || e.key FROM e JOIN t ON e.parent = t.key) SELECT key, depth, path FROM t")
def h3_adjacency_tree(t: Tables) -> DataFrame:
    world = t.region.groupBy().agg(F.lit("world").alias("key"), F.lit(None).cast("string").alias("parent"))
    regions = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit("world").alias("parent"))
    nations = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    tree = H.adjacency_tree(world.unionByName(regions).unionByName(nations), "key", "parent", F.col("parent").isNull())
    return tree.select("key", "depth", F.array_join("path", "/").alias("path"))


@query("SELECT o_orderkey AS key, (1 + (row_number() OVER (ORDER BY o_orderkey) - 1) % 150)::INT AS depth FROM orders")
def h3_deep_tree(t: Tables) -> DataFrame:
    """Chains of 150 orders below one root: a join for each doubling of the depth."""
    rows = with_ordinal(t.orders.select("o_orderkey"), ["o_orderkey"], "place")
    before = rows.select((F.col("place") + 1).alias("place"), F.col("o_orderkey").alias("before"))
    linked = rows.join(before, "place", "left").select(F.col("o_orderkey").alias("key"), F.when((F.col("place") - 1) % 150 == 0, -1).otherwise(F.col("before")).cast("long").alias("parent"))
    root = t.orders.agg(F.lit(-1).cast("long").alias("key"), F.lit(None).cast("long").alias("parent"))
    tree = H.adjacency_tree(linked.withColumn("key", F.col("key").cast("long")).unionByName(root), "key", "parent", F.col("parent").isNull(), paths=False)
    return tree.where("depth > 0").select("key", "depth")


@query("SELECT 'r' || r_name || '/' || n_name AS path, count(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def g5_recursive_collect(t: Tables) -> DataFrame:
    regions = t.region.select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.concat(F.lit("r"), "r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    nations = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    leaves = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("node"), F.col("s_name").alias("value"), F.col("s_suppkey").alias("ord"))
    return H.recursive_collect(regions.unionByName(nations), leaves, "root").groupBy("path").agg(F.count("value").alias("suppliers"))


@query("SELECT o_orderkey, (count(*) FILTER (l_quantity > 30))::INT AS large FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def h1_recursive_filter(t: Tables) -> DataFrame:
    from tessella.plans.shape_queries import orders_with_lines

    orders = orders_with_lines(t).where(F.size("lines") > 0).select("o_orderkey", "o_custkey", "lines")
    customers = orders.groupBy("o_custkey").agg(F.struct(F.array(F.struct(F.lit(0.0).alias("l_quantity"))).alias("lines"), F.collect_list(F.struct("o_orderkey", "lines")).alias("branches")).alias("tree"))
    kept = customers.select(H.recursive_filter(F.col("tree"), customers.schema["tree"].dataType, "lines", "branches", lambda x: x["l_quantity"] > 30).alias("tree"))
    kept = kept.where(F.size("tree.lines") == 0).select(F.explode("tree.branches").alias("b"))
    return kept.select("b.o_orderkey", F.size("b.lines").alias("large"))


@query("SELECT l_orderkey, l_linenumber, rule FROM (SELECT *, 'discount' AS rule, NOT (l_discount BETWEEN 0 AND 0.05) AS bad FROM lineitem UNION ALL SELECT *, 'flag', l_returnflag NOT IN ('A', 'N') FROM lineitem UNION ALL SELECT *, 'quantity', NOT (l_quantity % 5 = 0) FROM lineitem) WHERE bad")
def v_line_checks(t: Tables) -> DataFrame:
    rules = {
        "discount": (V.in_range(F.col("l_discount"), 0, 0.05), F.col("l_discount")),
        "flag": (V.enumerated(F.col("l_returnflag"), "A", "N"), F.col("l_returnflag")),
        "quantity": (V.multiple_of(F.col("l_quantity"), "5"), F.col("l_quantity")),
    }
    return V.check(t.lineitem, ["l_orderkey", "l_linenumber"], rules).drop("detail")


@query("SELECT event_id, rule FROM (SELECT event_id, 'name' AS rule, (props->>'$.k') IS NULL AS bad FROM events UNION ALL SELECT event_id, 'size', (props->>'$.k')::INT >= 50 FROM events) WHERE bad")
def v_property_checks(t: Tables) -> DataFrame:
    entries = F.from_json("props", "map<string,int>")
    names = V.required(entries, ["k"]) & V.closed(entries, ["k"]) & V.property_count(entries, 1, 1) & V.property_names(entries, lambda k: F.length(k) == 1) & V.pattern_properties(entries, [], "^[a-z]$") & V.dependent_required(entries, "k", ["k"])
    small = V.dependent_schema(entries, "k", F.try_element_at(entries, F.lit("k")) < 50)
    return V.check(t.events, ["event_id"], {"name": (names, F.col("props")), "size": (small, F.col("props"))}).drop("detail")


@query("SELECT o_orderkey, rule FROM (SELECT o_orderkey, 'items' AS rule, count(l_linenumber) NOT BETWEEN 2 AND 5 AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT o_orderkey, 'large', coalesce(count(*) FILTER (l_quantity > 45), 0) < 1 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT o_orderkey, 'unique', count(DISTINCT l_quantity) <> count(l_quantity) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE bad")
def v_item_checks(t: Tables) -> DataFrame:
    from tessella.plans.shape_queries import orders_with_lines

    amounts = F.transform("lines", lambda x: x["l_quantity"])
    rules = {
        "items": (V.item_count(F.col("lines"), 2, 5), F.size("lines")),
        "large": (V.contains_items(F.col("lines"), lambda x: x["l_quantity"] > 45), F.size("lines")),
        "unique": (V.unique_items(amounts), F.size("lines")),
    }
    return V.check(orders_with_lines(t), ["o_orderkey"], rules).drop("detail")


@query("SELECT c_custkey, rule FROM (SELECT c_custkey, 'either' AS rule, ((c_mktsegment = 'BUILDING')::INT + (c_acctbal > 5000)::INT) <> 1 AS bad FROM customer UNION ALL SELECT c_custkey, 'name', NOT regexp_matches(c_name, '^Customer#.*[0-4]$') FROM customer UNION ALL SELECT c_custkey, 'length of c_mktsegment', length(c_mktsegment) NOT BETWEEN 9 AND 10 FROM customer) WHERE bad")
def v_value_checks(t: Tables) -> DataFrame:
    rules = {
        "either": (V.alternatives(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 5000), F.col("c_acctbal")),
        "name": (V.text_pattern(F.col("c_name"), "^Customer#.*[0-4]$"), F.col("c_name")),
    }
    issues = V.value_issues(t.customer, ["c_custkey"], {"c_mktsegment": (9, 10)}, {})
    return V.check(t.customer, ["c_custkey"], rules).unionByName(issues).drop("detail")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def v21_unique_key(t: Tables) -> DataFrame:
    return V.duplicate_keys(t.orders, ["o_custkey"])
