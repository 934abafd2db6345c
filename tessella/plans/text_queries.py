"""Queries over text layouts, EDI, XML and rules. Their inputs are rendered from the tables, read back, and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import compare as C
from tessella.functions import numbers as N
from tessella.functions import text as X
from tessella.operators import checks as V
from tessella.operators import grouping as A
from tessella.operators import shape as P
from tessella.operators import windows as O
from tessella.operators.functions import UserFunction, table_function
from tessella.operators.totals import totals
from tessella.ordinal import position, with_ordinal
from tessella.plans.registry import Tables, query
from tessella.plans.shape_queries import orders_with_lines
from tessella.sources import edi as E
from tessella.sources import readers as S
from tessella.sources import text_layouts as L
from tessella.sources import writers as K


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS status FROM orders")
def s1_delimited_text(t: Tables) -> DataFrame:
    """Orders as one delimited text per customer, read back."""
    line = F.concat_ws(";", F.col("o_orderkey"), F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'")))
    texts = t.orders.groupBy("o_custkey").agg(A.string_join(line, ["o_orderkey"], "|").alias("text"))
    rows = L.delimited_records(texts, "text", "o_orderkey bigint, status string", "|", ";", "'")
    return rows.select("record.o_orderkey", "o_custkey", "record.status")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def s2_fixed_width_text(t: Tables) -> DataFrame:
    records = t.customer.select(K.fixed_record([("c_custkey", 8), ("c_mktsegment", 12)], "_").alias("r"))
    return records.select(*S.fixed_fields(F.col("r"), [("c_custkey", 8, "bigint"), ("segment", 12, "string")], "_"))


def order_messages(t: Tables) -> DataFrame:
    """One interchange text per order with lines: a message header, a line and a quantity segment per line, a trailer."""
    line = lambda x: F.concat(F.lit("LIN+"), x["l_linenumber"].cast("string"), F.lit("++"), x["l_partkey"].cast("string"), F.lit("'QTY+21:"), X.text(x["l_quantity"]), F.lit("'"))
    orders = orders_with_lines(t).where(F.size("lines") > 0)
    text = F.concat(F.lit("UNH+"), F.col("o_orderkey").cast("string"), F.lit("+ORDERS'"), F.array_join(F.transform("lines", line), ""), F.lit("UNT+0+"), F.col("o_orderkey").cast("string"), F.lit("'"))
    return E.dealt(orders.select("o_orderkey", text.alias("text")), ["o_orderkey"], t.orders.count())


@query("SELECT l_orderkey AS o_orderkey, l_linenumber::VARCHAR AS line, l_partkey::VARCHAR AS part, l_quantity::BIGINT AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def s13_edi_loops(t: Tables) -> DataFrame:
    segments = E.edi_segments(order_messages(t), "text", "edifact").drop("text")
    loops = E.edi_loops(segments, ["o_orderkey"], {"line_no": F.col("id") == "LIN"}, known=["UNH", "LIN", "QTY", "UNT"])
    fields = {"line": (F.col("id") == "LIN", E.element(1)), "part": (F.col("id") == "LIN", E.element(3)), "quantity": (F.col("id") == "QTY", E.element(1, 2))}
    rows = E.loop_fields(loops.where("line_no > 0"), ["o_orderkey", "line_no"], fields)
    return rows.select("o_orderkey", "line", "part", F.col("quantity").cast("bigint").alias("quantity"))


@query("SELECT l_orderkey AS o_orderkey, 2 * count(*) + 2 AS n, true AS same FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def k13_edi_control_counts(t: Tables) -> DataFrame:
    """Segments of each message counted for its trailer, and the text rendered again."""
    texts = order_messages(t)
    segments = E.edi_segments(texts, "text", "edifact").drop("text")
    counts = E.control_counts(segments, ["o_orderkey"], "UNH", "UNT")
    again = E.edi_render(segments, ["o_orderkey"]).withColumnRenamed("text", "again")
    out = counts.join(again, "o_orderkey").join(texts, "o_orderkey")
    return out.select("o_orderkey", "n", (F.col("text") == F.col("again")).alias("same"))


@query("SELECT n_nationkey::VARCHAR AS no, n_name AS name FROM nation")
def s14_records_by_prefix(t: Tables) -> DataFrame:
    lines = t.nation.select(F.concat(F.lit("NAT"), F.rpad(F.col("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 30, " ")).alias("line"))
    other = t.region.select(F.concat(F.lit("REG"), "r_name").alias("line"))
    return L.records_by_prefix(lines.unionByName(other), "line", {"NAT": [("no", 4, 4), ("name", 8, 30)]})["NAT"]


@query("SELECT c_custkey, 1 AS place, '20' AS tag, c_name AS value FROM customer UNION ALL SELECT c_custkey, 2, '50K', c_mktsegment || chr(10) || 'second line' FROM customer")
def s15_tagged_fields(t: Tables) -> DataFrame:
    text = F.concat(F.lit(":20:"), F.col("c_name"), F.lit("\n:50K:"), F.col("c_mktsegment"), F.lit("\nsecond line"))
    return L.tagged_fields(t.customer.select("c_custkey", text.alias("t")), "t").select("c_custkey", "place", "tag", "value")


@query("SELECT n_nationkey, n_name AS name FROM nation")
def p16_xml_text(t: Tables) -> DataFrame:
    """Rows as XML text, read back."""
    xml = P.xml_text(F.struct(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name")), rowTag="nation")
    back = t.nation.select(F.from_xml(xml, F.lit("_key INT, name STRING")).alias("x"))
    return back.select(F.col("x._key").alias("n_nationkey"), "x.name")


@query("SELECT o_orderkey, o_custkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def f1_outward_fields(t: Tables) -> DataFrame:
    """A field is found in the line, or else in the order around it."""
    flat = P.iterate(orders_with_lines(t), "lines", "line")
    found = [P.field(flat, n, ["line"]).alias(n) for n in ("o_orderkey", "o_custkey", "l_quantity")]
    return flat.select(*found)


@query("SELECT r_name AS outer_name, n_name AS inner_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def f2_pinned_fields(t: Tables) -> DataFrame:
    """The same field name at two levels."""
    regions = t.region.select("r_regionkey", F.struct(F.col("r_name").alias("name")).alias("region"))
    nations = t.nation.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("name"))
    flat = P.iterate(P.nest(regions, nations, ["r_regionkey"], "nations", ["name"], ["name"]), "nations", "nation")
    return flat.select(P.pinned_field(flat, "region", "name").alias("outer_name"), P.pinned_field(flat, "nation", "name").alias("inner_name"))


@query("SELECT user_id, count(*)::INT AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def p8_merged_fragments(t: Tables) -> DataFrame:
    """One object from one property per row."""
    pairs = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return P.dynamic_object(pairs, ["user_id"], F.col("event_type"), F.col("last")).select("user_id", F.size("object").alias("n"))


@query("SELECT c_custkey, count(o_orderkey)::INT AS n, max(o_totalprice) AS dearest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def p4_nested_child(t: Tables) -> DataFrame:
    nested = P.nest(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "orders", ["o_orderkey", "o_totalprice"], ["o_orderkey"])
    return nested.select("c_custkey", F.size("orders").alias("n"), F.array_max(F.transform("orders", lambda x: x["o_totalprice"])).alias("dearest"))


@query("SELECT l_orderkey, l_linenumber, order_place, line_place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount)::INT AS line_place FROM lineitem) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS order_place FROM orders) ON o_orderkey = l_orderkey")
def w2_positions_of_levels(t: Tables) -> DataFrame:
    orders = with_ordinal(orders_with_lines(t), ["o_orderkey"], "order_place")
    flat = P.iterate(orders, "lines", "line", "line_place")
    return flat.select(F.col("o_orderkey").alias("l_orderkey"), F.col("line.l_linenumber").alias("l_linenumber"), "order_place", "line_place")


@query("SELECT o_orderpriority, place FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) AS place FROM orders GROUP BY 1) WHERE place <= 2")
def o9_first_groups(t: Tables) -> DataFrame:
    groups = A.group_by(t.orders, ["o_orderpriority"], {"n": A.item_count()}, ["o_orderkey"])
    return O.select_rows(groups, [("first", 2)], ["first_seen"], number="place").select("o_orderpriority", "place")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r BETWEEN 2 AND 4")
def o6_from_to(t: Tables) -> DataFrame:
    return O.select_rows(t.orders, [("range", 2, 4)], ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > 2 AND r >= 4")
def o4_skip_and_from(t: Tables) -> DataFrame:
    return O.select_rows(t.orders, [("skip", 2), ("from", 2)], ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY CASE WHEN v IS NULL THEN 0 WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 2 ELSE 3 END, try_cast(v AS DOUBLE), CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END, p_partkey) AS place, p_partkey FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_size::VARCHAR ELSE p_brand END AS v FROM part)")
def o2_mixed_order(t: Tables) -> DataFrame:
    value = F.when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 2, F.col("p_brand"))
    mixed = t.part.select("p_partkey", value.alias("v"))
    return with_ordinal(mixed, [*O.mixed_order(F.col("v")), "p_partkey"], "place").select("place", "p_partkey")


@query("SELECT row_number() OVER (ORDER BY try_cast(v AS DECIMAL(38,0)) NULLS LAST, v) AS place, p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand || p_partkey ELSE (9007199254740992 + p_partkey)::VARCHAR END AS v FROM part)")
def o2_exact_order(t: Tables) -> DataFrame:
    """Whole numbers that no float tells apart are in order, before text; parts whose texts are equal follow their keys."""
    large = (F.col("p_partkey").cast("long") + 2**53).cast("string")
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat("p_brand", "p_partkey")).otherwise(large).alias("v"))
    return with_ordinal(rows, [*O.mixed_order(F.col("v")), "p_partkey"], "place").select("place", "p_partkey")


@query("SELECT l_orderkey, count(*) AS items, coalesce(sum(l_quantity), 0) AS total, count(*) FILTER (l_quantity > 25) AS large FROM lineitem GROUP BY 1")
def a2_numeric_text(t: Tables) -> DataFrame:
    """Text that reads as a number counts as one."""
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("string"))
    return totals(rows, ["l_orderkey"], {"items": ("rows", "q"), "total": ("sum", A.numeric(F.col("q"), "string")), "large": ("count", F.when(F.col("l_quantity") > 25, 1))})


@query("SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey)::INT AS place FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def j5_join_fields(t: Tables) -> DataFrame:
    left, right = t.customer.alias("c"), t.orders.alias("o")
    joined = left.join(right, F.col("c.c_custkey") == F.col("o.o_custkey")).where(C.equal(F.col("c.c_mktsegment"), "BUILDING"))
    return joined.select("c.c_custkey", "o.o_orderkey", position(["o.o_orderkey"], ["c.c_custkey"]).alias("place"))


@query("SELECT event_id, rule FROM (SELECT event_id, 'type' AS rule, false AS bad FROM events UNION ALL SELECT event_id, 'fixed', event_type <> 'click' FROM events UNION ALL SELECT event_id, 'value', NOT (value > 0) FROM events) WHERE bad")
def v_typed_checks(t: Tables) -> DataFrame:
    number = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    rules = {"type": (V.json_type(number, ("BIGINT",)), F.col("props")), "fixed": (V.fixed(F.col("event_type"), "click"), F.col("event_type")), "value": (V.in_range(F.col("value"), 0, open_low=True), F.col("value"))}
    return V.check(t.events, ["event_id"], rules).drop("detail")


@query("SELECT c_custkey, 'code of c_mktsegment' AS rule, c_mktsegment AS detail FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def v20_code_lists(t: Tables) -> DataFrame:
    return V.value_issues(t.customer, ["c_custkey"], {}, {"c_mktsegment": ["BUILDING", "MACHINERY"]})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem WHERE l_quantity > 10")
def d1_user_functions(t: Tables) -> DataFrame:
    """A scalar function that another one calls, and a table function in the chain."""
    net = UserFunction("net", {"price": "double", "discount": "double"}, "double", lambda p, d: p * (1 - d))
    gross = UserFunction("gross", {"price": "double", "discount": "double", "tax": "double"}, "double", lambda p, d, x: net(p, d) * (1 + x))
    large = table_function(t.lineitem, lambda df: df.where("l_quantity > 10"))
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return large.select("l_orderkey", "l_linenumber", net(price, discount).alias("net"), gross(price, discount, F.col("l_tax")).alias("gross"))


@query("SELECT p_partkey, CASE WHEN p_size::HUGEINT * 400000000000000000 > 9223372036854775807::HUGEINT THEN 1 ELSE 0 END AS wide, p_retailprice AS same FROM part")
def fn_lenient_numbers(t: Tables) -> DataFrame:
    product = N.lenient_multiply(F.col("p_size").cast("long"), F.lit(400000000000000000))
    return t.part.select("p_partkey", (product > float(2**63 - 1)).cast("int").alias("wide"), N.positive(F.col("p_retailprice")).alias("same"))


@query("SELECT s_suppkey, '978' || lpad((s_suppkey % 1000000000)::VARCHAR, 9, '0') AS body FROM supplier")
def fn_isbn(t: Tables) -> DataFrame:
    """Keys as ISBN-10 with their check digit, converted to 13 digits, without the last."""
    nine = F.lpad((F.col("s_suppkey") % 1000000000).cast("string"), 9, "0")
    rest = (11 - sum((11 - i) * F.substring(nine, i, 1).cast("int") for i in range(1, 10)) % 11) % 11
    isbn = F.concat(nine, F.when(rest == 10, "X").otherwise(rest.cast("string")))
    return t.supplier.select("s_suppkey", F.left(X.isbn10_to_isbn13(isbn), F.lit(12)).alias("body"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def x2_routed_rows(t: Tables) -> DataFrame:
    routed = L.switch_route(t.orders, F.col("o_orderstatus"), {"finished": ("prefix", "F"), "rest": ("regex", ".")}, "first")
    return routed.where(C.equal(F.col("route"), "finished")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus AS target, count(*) AS rows_written, count(*) AS rows_read FROM orders GROUP BY 1")
def k16_run_report(t: Tables) -> DataFrame:
    """Targets of one source that is made once: the rows that the run reports, and those that are there."""
    path, states = t.scratch("k16"), [r[0] for r in t.orders.select("o_orderstatus").distinct().limit(20).collect()]
    targets = {s: (lambda df, s=s: df.where(F.col("o_orderstatus") == s)) for s in states}
    report = K.run_outputs(targets, path, source=t.orders.select("o_orderkey", "o_orderstatus"))
    parts = [t.spark.read.parquet(f"{path}/{s}").agg(F.lit(s).alias("target"), F.lit(n).cast("long").alias("rows_written"), F.count(F.lit(1)).alias("rows_read")) for s, n in report.items()]
    return reduce(DataFrame.unionByName, parts)


CUSTOMERS = T.StructType().add("c_custkey", T.LongType()).add("c_name", T.StringType()).add("c_acctbal", T.DoubleType()).add("c_mktsegment", T.StringType())
SAME_CUSTOMERS = "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def customers(t: Tables) -> DataFrame:
    return t.customer.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CUSTOMERS])


@query(SAME_CUSTOMERS)
def s1_csv_written_and_read(t: Tables) -> DataFrame:
    path = t.scratch("csv")
    K.write_csv(customers(t), path, CUSTOMERS, ";", header=True)
    return S.read_csv(t.spark, path, CUSTOMERS, ";", header=True)


@query("SELECT doc_id, md5('He said \"' || text || '\";' || chr(10) || ' and left') AS text, length(text)::INT AS n FROM documents")
def s1_records_with_quotes_and_breaks(t: Tables) -> DataFrame:
    """Whole texts with quotes, separators and line breaks, written as cells and read back; a null text is an empty cell."""
    schema = T.StructType.fromDDL("doc_id bigint, said string, n int")
    path = t.scratch("quoted")
    said = F.concat(F.lit('He said "'), "text", F.lit('";\n and left'))
    K.write_csv(t.documents.select("doc_id", said.alias("said"), F.length("text").alias("n")), path, schema, ";", header=True)
    return S.read_csv(t.spark, path, schema, ";", header=True).select("doc_id", F.md5("said").alias("text"), "n")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_mktsegment FROM customer")
def s2_unbroken_records(t: Tables) -> DataFrame:
    """Records without line breaks, filled with a character of two bytes, cut by byte ranges."""
    path, fields = t.scratch("unbroken"), [("c_custkey", 10), ("c_mktsegment", 12)]
    t.customer.select(K.fixed_record(fields, "·").alias("value")).write.option("lineSep", "|").text(path)
    return S.read_fixed_width(t.spark, path, [("c_custkey", 10, "bigint"), ("c_mktsegment", 12, "string"), ("end", 1, "string")], "·", delimited=False).drop("end")


@query("SELECT c_custkey::BIGINT AS c_custkey, c_mktsegment FROM customer")
def s2_fixed_width_written_and_read(t: Tables) -> DataFrame:
    path = t.scratch("fixed")
    K.write_fixed_width(t.customer, path, [("c_custkey", 10), ("c_mktsegment", 12)])
    return S.read_fixed_width(t.spark, path, [("c_custkey", 10, "bigint"), ("c_mktsegment", 12, "string")])


@query(SAME_CUSTOMERS)
def s4_json_lines_written_and_read(t: Tables) -> DataFrame:
    path = t.scratch("jsonl")
    K.write_json(customers(t), path)
    return S.read_jsonl(t.spark, path, CUSTOMERS)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def s3_json_documents_written_and_read(t: Tables) -> DataFrame:
    """A document per nation, each at its own path; names hold spaces and folders."""
    path = t.scratch("documents")
    named = t.nation.select("n_nationkey", "n_name", F.concat(F.lit("region "), "n_regionkey", F.lit("/"), "n_name", F.lit(".json")).alias("name"))
    K.write_documents(named, path, "name")
    return S.read_json(t.spark, f"{path}/*/*.json", T.StructType.fromDDL("n_nationkey bigint, n_name string"))


@query("SELECT n_name AS name, n_nationkey::BIGINT AS n_nationkey, n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey % 5 <> 0")
def s11_documents_by_path(t: Tables) -> DataFrame:
    """Documents whose paths a column gives, with spaces and signs that mean something elsewhere; null paths are skipped."""
    path = t.scratch("by-path")
    at = F.concat(F.lit("a+b 100%/["), "n_name", F.lit("].json"))
    K.write_documents(t.nation.select(F.col("n_nationkey").alias("key"), at.alias("at")), path, "at")
    driver = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("n_nationkey"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit(f"{path}/"), at)).alias("path"))
    found = S.load_by_path(driver, "path", "text")
    return found.select("name", "n_nationkey", F.from_json("value", "key bigint")["key"].alias("key"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def s5_xml_written_and_read(t: Tables) -> DataFrame:
    path = t.scratch("xml")
    K.write_xml(t.nation.select(F.col("n_nationkey").alias("_key"), "n_name"), path, "nations", "nation")
    rows = S.read_xml(t.spark, path, "nation", T.StructType.fromDDL("_key bigint, n_name string"))
    return rows.select(F.col("_key").alias("n_nationkey"), "n_name")


@query("SELECT n_name AS value, n_name || '.json' AS file FROM nation")
def s6_file_set(t: Tables) -> DataFrame:
    """Files of a pattern, and the path of the document that a row comes from."""
    path = t.scratch("set")
    K.write_documents(t.nation.select(F.col("n_name").alias("v"), F.concat("n_name", F.lit(".json")).alias("at")), path, "at")
    rows = S.read_file_set(t.spark, f"{path}/*.json")
    return rows.select(F.from_json("value", "v string")["v"].alias("value"), F.regexp_extract(P.document_path(rows, []), "([^/]*)$", 1).alias("file"))


@query("SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders")
def k6_replaced_table(t: Tables) -> DataFrame:
    """A table that is replaced by one made from itself."""
    path = t.scratch("table")
    K.replace_table(t.orders.select("o_orderkey", "o_custkey"), path)
    old = t.spark.read.parquet(path)
    K.replace_table(old.withColumn("o_custkey", (F.col("o_custkey") + 1).cast(old.schema["o_custkey"].dataType)), path)
    return t.spark.read.schema(old.schema).parquet(path)


@query("SELECT o_orderkey, o_custkey + 2 AS o_custkey FROM orders")
def k6_committed_versions(t: Tables) -> DataFrame:
    """Versions of a table, each made from the one before and put in its place by one rename."""
    path = t.scratch("versions")
    K.commit_table(t.orders.select("o_orderkey", "o_custkey"), path)
    for _ in range(2):
        old = K.current_table(t.spark, path)
        K.commit_table(old.withColumn("o_custkey", (F.col("o_custkey") + 1).cast(old.schema["o_custkey"].dataType)), path)
    return K.current_table(t.spark, path)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def k11_selected_output(t: Tables) -> DataFrame:
    path = t.scratch("k11")
    targets = {"done": t.orders.where("o_orderstatus = 'F'"), "never": t.orders.where(F.raise_error(F.lit("never run")).cast("boolean"))}
    K.run_selected(targets, "done", path)
    return t.spark.read.parquet(f"{path}/done").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_custkey::BIGINT AS no, c_mktsegment AS segment FROM customer")
def fn_layout_field(t: Tables) -> DataFrame:
    """Scalars of a text that follows a layout: a head line, then records of fields."""
    text = F.concat(F.lit("HEAD\nno;"), F.col("c_custkey").cast("string"), F.lit("\nseg; "), F.col("c_mktsegment"), F.lit("\nend;"))
    no = L.layout_field(text, [("tail", "lines", 1), ("part", "delimiter", "\n", 1), ("field", ";", 2)], "bigint")
    segment = L.layout_field(text, [("part", "delimiter", "\n", 3), ("field", ";", 2), ("trim", "both", " ")])
    return t.customer.select("c_custkey", no.alias("no"), segment.alias("segment"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'constant' AS fixed, NULL::VARCHAR AS nothing FROM orders")
def f8_constants(t: Tables) -> DataFrame:
    return P.bind(t.orders, {"o_orderkey": F.col("o_orderkey"), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "fixed": F.lit("constant"), "nothing": F.lit(None).cast("string")})
