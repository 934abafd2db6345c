"""Queries over sources, field access, construction and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import compare as C
from tessella.functions import text as X
from tessella.operators import shape as P
from tessella.operators import windows as O
from tessella.ordinal import position, with_ordinal
from tessella.plans.registry import Tables, query
from tessella.sources import readers as S
from tessella.sources import text_layouts as L
from tessella.sources import writers as K


def orders_with_lines(t: Tables) -> DataFrame:
    return P.nest(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], "lines", ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"], ["l_linenumber"])


@query("SELECT o_orderkey, l_linenumber AS line, l_partkey, o_orderdate, upper(o_orderpriority) AS priority FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def order_lines(t: Tables) -> DataFrame:
    """Flagship: orders with nested lines, flattened again with the order's fields on every line."""
    flat = P.iterate(orders_with_lines(t), "lines", "line")
    return flat.select("o_orderkey", F.col("line.l_linenumber").alias("line"), F.col("line.l_partkey").alias("l_partkey"), "o_orderdate", X.upper(F.col("o_orderpriority")).alias("priority"))


@query("SELECT o_orderkey, count(l_linenumber)::INT AS n_lines, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def s8_read_nested(t: Tables) -> DataFrame:
    lines = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return orders_with_lines(t).select("o_orderkey", F.size("lines").alias("n_lines"), lines.alias("quantity"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def s9_resolved_relation(t: Tables) -> DataFrame:
    keys = [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
    a, b = S.resolve_relation(keys, "customer", "orders")
    return t.customer.join(t.orders, F.col(a) == F.col(b)).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name AS customer_name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def s10_with_sources(t: Tables) -> DataFrame:
    from tessella.operators.joins import enriched

    out = enriched(t.orders, {"customer": (t.customer, [("o_custkey", "c_custkey")])})
    return out.select("o_orderkey", F.col("customer.c_name").alias("customer_name"), F.col("customer.c_mktsegment").alias("segment"))


@query("SELECT l_orderkey, l_partkey, l_quantity::BIGINT AS quantity FROM lineitem")
def s7_read_table(t: Tables) -> DataFrame:
    return S.read_columns(t.spark, f"{t.folder}/lineitem.parquet", {"l_orderkey": "bigint", "l_partkey": "bigint", "l_quantity": "bigint"}).withColumnRenamed("l_quantity", "quantity")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def s3_read_json_field(t: Tables) -> DataFrame:
    from tessella.functions.paths import json_field

    return t.events.select("event_id", json_field(F.col("props"), "k BIGINT", "k").alias("k"))


@query("SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS head, CASE WHEN instr(text, chr(10)) > 0 THEN length(substr(text, instr(text, chr(10)) + 1)) ELSE 0 END::INT AS tail_length FROM documents")
def s16_split_once(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", L.split_once(F.col("text"), "delimiter", "\n").alias("s")).select("doc_id", "s.head", F.length("s.tail").alias("tail_length"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT AS line_number, line FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS i FROM documents)")
def s17_split_many(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return L.exploded(docs, L.split_many(F.col("text"), "delimiter", "\n"), "line", "line_number").select("doc_id", "line_number", "line")


@query("SELECT p_partkey, trim('xyz' || p_name || 'zz', 'xyz') AS name FROM part")
def s19_store_trim(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", L.trimmed(F.concat(F.lit("xyz"), "p_name", F.lit("zz")), "string", "both", "xyz").alias("name"))


@query("SELECT CASE WHEN l_returnflag LIKE 'R%' THEN 'returned' WHEN regexp_matches(l_returnflag, '[AN]') THEN 'open' ELSE 'other' END AS route, count(*) AS n FROM lineitem GROUP BY 1")
def s20_switch_route(t: Tables) -> DataFrame:
    routed = L.switch_route(t.lineitem, F.col("l_returnflag"), {"returned": ("prefix", "R"), "open": ("regex", "[AN]")}, default="other")
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'purchase') AS purchase FROM f WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def s21_facts_by_context(t: Tables) -> DataFrame:
    facts = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return S.facts_by_context(facts, t.events.select("user_id").distinct(), "user_id", "event_type", "v", ["click", "purchase"])


@query("SELECT l_orderkey, l_linenumber, place, header, value FROM (SELECT l_orderkey, l_linenumber, 1 AS place, 'l_quantity' AS header, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, 'l_tax', l_tax FROM lineitem)")
def s22_unpivot_grid(t: Tables) -> DataFrame:
    return S.unpivot_grid(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"])


@query("SELECT n_nationkey AS col, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def s23_transpose_rows(t: Tables) -> DataFrame:
    cells = t.nation.select(F.explode(F.array(F.struct(F.lit(1).alias("row"), F.col("n_nationkey").alias("col"), F.col("n_name").alias("value")), F.struct(F.lit(2).alias("row"), F.col("n_nationkey").alias("col"), F.col("n_regionkey").cast("string").alias("value")))).alias("c")).select("c.*")
    return S.transpose_rows(cells, {1: "name", 2: "region"}, driver=1)


@query("SELECT 'customers' AS sheet, row_number() OVER (ORDER BY c_custkey) AS row_number, c_name AS name FROM customer UNION ALL SELECT 'suppliers', row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier")
def s24_union_sheets(t: Tables) -> DataFrame:
    sheets = {"customers": t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k")), "suppliers": t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))}
    return S.union_sheets(sheets, "k").select("sheet", "row_number", "name")


@query("SELECT c_custkey, rpad(c_custkey::VARCHAR, 8, '_') || rpad(c_mktsegment, 12, '_') AS record FROM customer")
def k2_fixed_width_record(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", K.fixed_record([("c_custkey", 8), ("c_mktsegment", 12)], "_").alias("record"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def k3_json_document(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", K.json_document("n_nationkey", "n_name", F.lit(None).cast("string").alias("nothing")).alias("json"))


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders")
def k7_generated_keys(t: Tables) -> DataFrame:
    return K.generated_keys(t.orders.select("o_orderkey", "o_orderdate"), "id", ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS order_id FROM orders) SELECT order_id, row_number() OVER (ORDER BY order_id, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS line_id, l_linenumber, l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey")
def k8_split_nested(t: Tables) -> DataFrame:
    _, lines = K.split_nested(orders_with_lines(t), "order_id", ["o_orderkey"], "lines", "line_id")
    return lines.select("order_id", "line_id", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, o_totalprice / 100 AS implied FROM orders")
def k14_compact_lexical(t: Tables) -> DataFrame:
    from tessella.functions.dates import date_from_datetime

    return t.orders.select("o_orderkey", L.compact_lexical(date_from_datetime(F.col("o_orderdate")), "date8").alias("compact"), L.implied_decimal(F.col("o_totalprice"), 2).alias("implied"))


@query("SELECT o_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def f3_first_item(t: Tables) -> DataFrame:
    return orders_with_lines(t).select("o_orderkey", P.first_item("lines")["l_partkey"].alias("first_part"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def f5_dynamic_field(t: Tables) -> DataFrame:
    entries = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", P.dynamic_field(entries, F.lower(F.lit("K"))).alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def f6_runtime_parameter(t: Tables) -> DataFrame:
    from tessella.operators.functions import parameter

    return t.orders.where(F.col("o_totalprice") > parameter({"least": "100000"}, "least", "double")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, order_position, o_custkey, l_linenumber FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS order_position FROM orders) JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")
def p1_iterate_levels(t: Tables) -> DataFrame:
    """Customers > orders > lines, both levels numbered; the first line of each order is kept."""
    lines = orders_with_lines(t).select("o_custkey", "o_orderkey", F.col("lines"))
    nested = lines.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "lines"))).alias("orders"))
    flat = P.iterate_path(nested, [("orders", "o"), ("o.lines", "line")]).where("line.l_linenumber = 1")
    return flat.select(F.col("o.o_orderkey").alias("o_orderkey"), F.col("o_position").alias("order_position"), "o_custkey", F.col("line.l_linenumber").alias("l_linenumber"))


@query("SELECT c_custkey, '[' || concat_ws(', ', c_name, nullif(c_mktsegment, 'BUILDING')) || ']' AS both_names FROM customer")
def p3_repeated_binding(t: Tables) -> DataFrame:
    made = P.repeated(F.col("c_name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return t.customer.select("c_custkey", F.concat(F.lit("["), F.array_join(made, ", "), F.lit("]")).alias("both_names"))


@query("SELECT count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer")
def p5_single_group(t: Tables) -> DataFrame:
    totals = t.customer.agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return P.single_group(totals, {"customers": F.col("customers"), "balance": F.col("balance")})


@query("SELECT user_id, count(DISTINCT event_type)::INT AS n_types, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1")
def p6_dynamic_binding(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    made = P.dynamic_object(counts, ["user_id"], F.col("event_type"), F.col("n"))
    return made.select("user_id", F.size("object").alias("n_types"), F.coalesce(P.dynamic_field("object", F.lit("click")), F.lit(0)).alias("clicks"))


@query("SELECT event_type, count(*)::INT AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def p7_dynamic_child(t: Tables) -> DataFrame:
    made = P.dynamic_children(t.events.withColumn("day", F.to_date("ts")), ["day"], F.col("event_type"), F.col("event_id"))
    rows = made.select(F.explode("object").alias("event_type", "ids"))
    return rows.groupBy("event_type").agg(F.sum(F.size("ids")).cast("int").alias("n"), F.min(F.array_min("ids")).alias("first_id"))


@query("SELECT r_regionkey, r_name FROM region")
def p9_copy_source(t: Tables) -> DataFrame:
    return P.copied(t.region).select("item.*")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def p10_scalar_construction(t: Tables) -> DataFrame:
    lists = P.nest(t.nation.select("n_regionkey").distinct(), t.nation, ["n_regionkey"], "names", ["n_name"], ["n_name"])
    return lists.select("n_regionkey", F.array_join(F.transform("names", lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def p11_first_per_group(t: Tables) -> DataFrame:
    return P.first_of(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS quantity, CASE WHEN l_tax = 0 THEN '0' ELSE l_tax::VARCHAR END AS tax, (l_orderkey::HUGEINT * 1152921504606846976 % 4611686018427387904)::BIGINT::VARCHAR AS large FROM lineitem")
def p12_numeric_adaptation(t: Tables) -> DataFrame:
    """Whole floats become whole numbers, at any size; the others stay floats."""
    large = (F.col("l_orderkey") % 4).cast("double") * float(2**60)
    shown = lambda c: F.try_variant_get(P.adapted_number(c, "long"), "$", "string")
    return t.lineitem.select("l_orderkey", "l_linenumber", shown(F.col("l_quantity")).alias("quantity"), shown(F.col("l_tax")).alias("tax"), shown(large).alias("large"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderkey::VARCHAR ELSE (o_custkey * 2)::VARCHAR END AS narrow, CASE o_orderkey % 3 WHEN 0 THEN 'STRING' WHEN 1 THEN 'BIGINT' ELSE 'BIGINT' END AS narrow_kind, CASE o_orderkey % 3 WHEN 0 THEN 'STRING' ELSE 'DOUBLE' END AS wide_kind FROM orders")
def p13_union_adaptation(t: Tables) -> DataFrame:
    """Text, whole numbers and whole floats for targets of text or whole number, and of text or float."""
    key = F.col("o_orderkey") % 3
    mixed = F.when(key == 0, F.col("o_orderstatus").cast("variant")).when(key == 1, F.col("o_orderkey").cast("variant")).otherwise((F.col("o_custkey") * 2.0).cast("variant"))
    narrow, wide = P.adapted_union(mixed, ["string", "long"]), P.adapted_union(mixed, ["string", "double"])
    return t.orders.select("o_orderkey", F.try_variant_get(narrow, "$", "string").alias("narrow"), F.schema_of_variant(narrow).alias("narrow_kind"), F.schema_of_variant(wide).alias("wide_kind"))


@query("SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'F')::INT AS n, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS first_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def p11_cardinalities(t: Tables) -> DataFrame:
    """Finished orders of a customer as a sequence of none or many, and the first of them or nothing."""
    finished = t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_orderkey")
    all_of = P.mapped_sequence(t.customer.select("c_custkey"), finished, ["c_custkey"], F.col("o_orderkey") * 2, ["o_orderkey"], "keys")
    out = P.first_or_empty(all_of, finished.withColumnRenamed("o_orderkey", "first_key"), ["c_custkey"], ["first_key"])
    return out.select("c_custkey", F.size("keys").alias("n"), "first_key")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size FROM orders")
def p14_if(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C.choose(F.col("o_totalprice") > 200000, "large", "small").alias("size"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
def p15_value_map(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", C.value_map(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other").alias("status"))


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'other' END AS level, CASE WHEN o_totalprice = floor(o_totalprice) AND o_custkey % 2 = 0 THEN 'even' ELSE 'unknown' END AS kind FROM orders")
def p15_value_map_of_another_type(t: Tables) -> DataFrame:
    """Text and floats turned into whole numbers before they are looked up; what is none misses."""
    digit, price = F.left("o_orderpriority", F.lit(1)), F.when(F.col("o_totalprice") == F.floor("o_totalprice"), F.col("o_custkey") % 2).otherwise(0.5).cast("double")
    return t.orders.select("o_orderkey", C.value_map(digit, {1: "urgent", 2: "high"}, "other", input_type="long").alias("level"), C.value_map(price, {0: "even"}, "unknown", input_type="long").alias("kind"))


@query("SELECT p_partkey, p_brand || ' <' || upper(p_type) || '>' AS content FROM part")
def p17_mixed_content(t: Tables) -> DataFrame:
    run = lambda name, text: F.struct(F.lit(name).cast("string").alias("name"), text.alias("text"))
    items = F.array(run(None, F.col("p_brand")), run(None, F.lit(" ")), run("type", F.col("p_type")))
    return t.part.select("p_partkey", P.mixed_content(items, {"type": lambda x: F.concat(F.lit("<"), F.upper(x), F.lit(">"))}).alias("content"))


@query("SELECT p_partkey, p_type AS content, 2 AS n FROM part")
def p18_renamed_content(t: Tables) -> DataFrame:
    run = lambda name, text: F.struct(F.lit(name).cast("string").alias("name"), text.alias("text"))
    items = F.array(run(None, F.lit("")), run("type", F.col("p_type")), run("brand", F.col("p_brand")))
    return t.part.select("p_partkey", P.renamed_content(items, {"type": "kind"}).alias("r")).select("p_partkey", P.mixed_content("r").alias("content"), F.size("r").alias("n"))


@query("SELECT n_name, n_nationkey FROM nation")
def p19_project_group(t: Tables) -> DataFrame:
    return P.projected(t.nation, ["n_name", "missing", "n_nationkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def x1_filter(t: Tables) -> DataFrame:
    return P.surviving(t.orders, C.greater_than(F.col("o_totalprice"), 100000)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place % 2 = 1")
def x2_sort_then_filter(t: Tables) -> DataFrame:
    placed = t.orders.withColumn("place", position([F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"]))
    return placed.where("place % 2 = 1").select("o_orderkey", "o_custkey", "place")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F')")
def x3_any_member(t: Tables) -> DataFrame:
    from tessella.operators.grouping import any_member, item_count

    return any_member(t.orders, ["o_custkey"], C.equal(F.col("o_orderstatus"), "F"), {"n": item_count()})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('X') AND l_discount <> 0")
def x4_predicates(t: Tables) -> DataFrame:
    ok = C.all_of(C.between(F.col("l_quantity"), 10, 20), C.one_of(F.col("l_returnflag"), "A", "R"), C.none_of(F.col("l_linestatus"), "X"), C.not_equal(F.col("l_discount"), 0))
    return t.lineitem.where(ok).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def x7_is_null(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").where(~C.exists(F.col("o_orderkey"))).select("c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%a_d%' OR p_name ILIKE '%e%'")
def x8_like(t: Tables) -> DataFrame:
    return t.part.where(X.sql_like(F.col("p_type"), "%A_D%") | X.sql_like(F.col("p_name"), "%E%")).select("p_partkey", "p_type")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10")
def x9_correlated_query(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 10)).select("c_custkey", "o_orderkey")


@query("SELECT ord, segment, name FROM (SELECT row_number() OVER (ORDER BY segment, k) AS ord, segment, name FROM (SELECT 0 AS segment, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier))")
def u1_concatenate(t: Tables) -> DataFrame:
    parts = [t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))]
    return P.concatenated(parts, ["k"]).select("ord", "segment", "name")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS ord, event_id FROM events")
def w1_position(t: Tables) -> DataFrame:
    return with_ordinal(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("ord", "event_id")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT AS place FROM lineitem WHERE l_quantity > 25")
def w3_renumbered(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 25").withColumn("place", position(["l_linenumber"], ["l_orderkey"])).select("l_orderkey", "l_linenumber", "place")


@query("SELECT o_orderkey, (100 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 10)::INT AS number FROM orders")
def w5_auto_number(t: Tables) -> DataFrame:
    return t.orders.withColumn("number", O.auto_number(["o_orderkey"], 100, 10, ["o_custkey"])).select("o_orderkey", "number")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def o3_first_n(t: Tables) -> DataFrame:
    return O.select_rows(t.orders, [("first", 3)], [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, (r - 2)::INT AS number FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r BETWEEN 3 AND 5")
def o8_chained_windows(t: Tables) -> DataFrame:
    return O.select_rows(t.orders, [("skip", 2), ("first", 3)], ["o_orderkey"], ["o_custkey"], "number").select("o_custkey", "o_orderkey", F.col("number").cast("int").alias("number"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def o7_last_n(t: Tables) -> DataFrame:
    return O.select_rows(t.events, [("last", 2)], ["ts", "event_id"], ["user_id"]).select("user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def o10_top_rows(t: Tables) -> DataFrame:
    return O.top_rows(t.orders, [F.desc("o_totalprice"), "o_orderkey"], 10, 5).select("o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) AS place, c_custkey FROM customer")
def o1_sort(t: Tables) -> DataFrame:
    return with_ordinal(t.customer, [F.desc_nulls_last("c_mktsegment"), F.asc_nulls_first("c_acctbal"), "c_custkey"], "place").select("place", "c_custkey")
