"""Round trips and errors of sources and sinks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import edi as E
from tessella.sources import readers as S
from tessella.sources import text_layouts as L
from tessella.sources import writers as K

PEOPLE = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("pay", T.DoubleType())])


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, newline="")
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", "name,age,pay\nAda,36,1.5\nBob,,\nCy,7\n")
    rows = [tuple(r) for r in S.read_csv(spark, path, PEOPLE, header=True).collect()]
    assert rows == [("Ada", 36, 1.5), ("Bob", None, None), ("Cy", 7, None)]
    with pytest.raises(Exception, match="too many columns"):
        S.read_csv(spark, put(tmp_path, "b.csv", "a,1,2,3\n"), PEOPLE).collect()
    with pytest.raises(Exception):
        S.read_csv(spark, put(tmp_path, "c.csv", "a,x,2\n"), PEOPLE).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1, None), (None, 2, 2.5)], PEOPLE)
    K.write_csv(df, str(tmp_path / "out"), PEOPLE)
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "out"), PEOPLE).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ValueError):
        K.write_csv(df.drop("pay"), str(tmp_path / "out2"), PEOPLE)


def test_fixed_width(spark, tmp_path):
    fields = [("code", 3, "string"), ("name", 6, "string"), ("flag", 5, "boolean")]
    want = [("007", "Ada", True), ("012", "Grace", False)]
    read = lambda text, delimited: [tuple(r) for r in S.read_fixed_width(spark, put(tmp_path, "f.txt", text), fields, "_", delimited).collect()]
    assert read("007Ada___true_\n012Grace_false\n", True) == want
    assert read("007Ada___true_012Grace_false", False) == want
    with pytest.raises(Exception, match="14 characters"):
        read("007Ada\n", True)
    df = spark.createDataFrame(want, "code string, name string, flag boolean")
    K.write_fixed_width(df, str(tmp_path / "fw"), [("code", 3), ("name", 6), ("flag", 5)], "_")
    assert sorted(tuple(r) for r in S.read_fixed_width(spark, str(tmp_path / "fw"), fields, "_").collect()) == want
    with pytest.raises(Exception, match="longer than 2"):
        K.write_fixed_width(df, str(tmp_path / "fw2"), [("code", 2)])


def test_json(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, tags array<string>")
    path = put(tmp_path, "a.json", '[{"id": 1, "tags": ["x"]}, {"id": 2}]')
    assert [tuple(r) for r in S.read_json(spark, path, schema).collect()] == [(1, ["x"]), (2, [])]
    assert S.read_jsonl(spark, put(tmp_path, "a.jsonl", '{"id": 1}\n\n{"id": 2}\n'), schema).count() == 2
    with pytest.raises(Exception):
        S.read_jsonl(spark, put(tmp_path, "b.jsonl", '{"id": "x"}\n'), schema).collect()


def test_xml(spark, tmp_path):
    xml = '<Orders><Order id="1"><Items><Item>a</Item><Item>b</Item></Items></Order><Order id="2"/></Orders>'
    schema = T.StructType.fromDDL("_id long, Items struct<Item: array<string>>")
    rows = S.read_xml(spark, put(tmp_path, "a.xml", xml), "Order", schema).select("_id", F.size(F.coalesce("Items.Item", F.array())).alias("n")).collect()
    assert sorted(map(tuple, rows)) == [(1, 2), (2, 0)]
    K.write_xml(spark.createDataFrame([(1, "x")], "_id long, v string"), str(tmp_path / "x"), "Rows", "Row")
    assert S.read_xml(spark, str(tmp_path / "x"), "Row", T.StructType.fromDDL("_id long, v string")).count() == 1


def test_file_sets_and_documents_by_path(spark, tmp_path):
    a, b = put(tmp_path, "a.txt", "one\ntwo\n"), put(tmp_path, "b.txt", "three\n")
    assert S.read_file_set(spark, str(tmp_path / "*.txt")).select("_doc_path").distinct().count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_file_set(spark, str(tmp_path / "*.none")).collect()
    driver = spark.createDataFrame([(1, a), (2, b), (3, None), (4, a)], "id int, path string")
    assert sorted((r["id"], r["value"]) for r in S.load_by_path(driver, "path").collect()) == [(1, "one"), (1, "two"), (2, "three"), (4, "one"), (4, "two")]


def test_relations():
    keys = [("p", "id", "c", "pid"), ("p", "id", "c", "other")]
    assert S.resolve_relation(keys, "p", "c", "pid") == ("id", "pid")
    for column in (None, "none"):
        with pytest.raises(ValueError):
            S.resolve_relation(keys, "p", "c", column)


def test_facts_twice_in_a_context(spark):
    facts = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "ctx int, concept string, v double")
    with pytest.raises(Exception, match="twice"):
        S.facts_by_context(facts, facts.select("ctx").distinct(), "ctx", "concept", "v", ["a"]).collect()


def test_text_layouts(spark):
    df = spark.createDataFrame([("a\nb\nKEY c\nd",), ("x",)], "t string")
    t = F.col("t")
    got = df.select(L.split_once(t, "lines", 2).alias("a"), L.split_once(t, "starting", "KEY").alias("b"), L.split_once(t, "columns", 3).alias("c"), L.split_many(t, "lines", 2).alias("d"), L.split_many(t, "starting", "KEY").alias("e")).collect()
    assert [tuple(x) for x in got[0][:3]] == [("a\nb\n", "KEY c\nd"), ("a\nb\n", "KEY c\nd"), ("a\nb", "\nKEY c\nd")]
    assert got[0]["d"] == ["a\nb", "KEY c\nd"] and got[0]["e"] == ["a\nb", "KEY c\nd"]
    assert [tuple(x) for x in got[1][:3]] == [("x", ""), ("x", ""), ("x", "")]
    rec = L.delimited_records(spark.createDataFrame([("1;'a;b'|2;c",)], "t string"), "t", "k int, v string", "|", ";", "'")
    assert [tuple(r["record"]) for r in rec.orderBy("record_number").collect()] == [(1, "a;b"), (2, "c")]
    tags = L.tagged_fields(spark.createDataFrame([(":20:REF\n:32A:one\ntwo\n:71:x",)], "t string"), "t")
    assert [(r["tag"], r["value"]) for r in tags.orderBy("place").collect()] == [("20", "REF"), ("32A", "one\ntwo"), ("71", "x")]
    routed = L.switch_route(spark.createDataFrame([("ab",), ("b",)], "t string"), t, {"a": ("prefix", "a"), "b": ("regex", "b")}, "all")
    assert sorted(r["route"] for r in routed.collect()) == ["a", "b", "b"]
    kinds = L.records_by_prefix(spark.createDataFrame([("HDR001x ",), ("LIN002y ",)], "t string"), "t", {"HDR": [("no", 4, 3), ("v", 7, 2)]})
    assert [tuple(r) for r in kinds["HDR"].collect()] == [("001", "x")]


def test_edifact_loops_rendering_and_counts(spark):
    text = "UNA:+.? 'UNB+UNOA:1+A+B'UNH+7+ORDERS:D'BGM+220+PO1'LIN+1'IMD+F++:::it?'s'QTY+21:5'LIN+2'QTY+21:3'UNT+8+7'UNZ+1+1'"
    seg = E.edi_segments(spark.createDataFrame([(1, text)], "doc int, t string"), "t", "edifact").drop("t")
    assert seg.count() == 10
    loops = E.edi_loops(seg, ["doc"], {"message": F.col("id") == "UNH", "line": F.col("id") == "LIN"})
    lines = E.loop_fields(loops.where("line > 0"), ["doc", "message", "line"], {"no": (F.col("id") == "LIN", E.element(1)), "qty": (F.col("id") == "QTY", E.element(1, 2)), "text": (F.col("id") == "IMD", E.element(3, 4))})
    assert [(r["no"], r["qty"], r["text"]) for r in lines.orderBy("line").collect()] == [("1", "5", "it's"), ("2", "3", None)]
    again = E.edi_render(seg, ["doc"]).first()["text"]
    assert again == text[9:]
    n = E.control_counts(seg, ["doc"], "UNH", "UNT").first()
    assert (n["n"], n["reference"]) == (8, "7")
    with pytest.raises(Exception, match="unknown segment"):
        E.edi_loops(seg, ["doc"], {"m": F.col("id") == "UNH"}, known=["UNB"]).collect()
    with pytest.raises(Exception, match="not opened"):
        E.control_counts(seg.where("id <> 'UNH'"), ["doc"], "UNH", "UNT").collect()


def test_x12_and_hl7_and_tradacoms(spark):
    isa = "ISA*00*          *00*          *ZZ*A              *ZZ*B              *240101*1200*U*00401*000000001*0*P*>~"
    x12 = isa + "GS*PO*A*B~ST*850*1~PO1*1*5*EA*2.5~PID*F****Desc~PO1*2*1*EA*3~SE*5*1~"
    seg = E.edi_segments(spark.createDataFrame([(1, x12)], "doc int, t string"), "t", "x12")
    loops = E.edi_loops(seg, ["doc"], {"line": F.col("id") == "PO1"})
    got = E.loop_fields(loops.where("line > 0"), ["doc", "line"], {"qty": (F.col("id") == "PO1", E.element(2)), "desc": (F.col("id") == "PID", E.element(5))})
    assert [(r["qty"], r["desc"]) for r in got.orderBy("line").collect()] == [("5", "Desc"), ("1", None)]
    hl7 = "MSH|^~\\&|A|B\rPID|1||123^^^X\r"
    seg = E.edi_segments(spark.createDataFrame([(1, hl7)], "doc int, t string"), "t", "hl7")
    assert [r["id"] for r in seg.orderBy("seg_no").collect()] == ["MSH", "PID"]
    assert seg.where("id = 'PID'").select(E.element(3, 1)).first()[0] == "123"
    trad = E.edi_segments(spark.createDataFrame([(1, "STX=ANA:1+X'MHD=1+ORDHDR:9'")], "doc int, t string"), "t", "tradacoms")
    assert [(r["id"], r["elements"][0]) for r in trad.orderBy("seg_no").collect()] == [("STX", ["ANA", "1"]), ("MHD", ["1"])]


def test_outputs(spark, tmp_path):
    targets = {"a": spark.range(3), "b": spark.range(5)}
    assert K.run_outputs(targets, str(tmp_path / "out")) == {"a": 3, "b": 5}
    K.replace_table(spark.range(2), str(tmp_path / "t"))
    K.replace_table(spark.range(4), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    with pytest.raises(ValueError):
        K.replace_table(spark.range(4).toDF("other"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="no path"):
        K.write_documents(spark.createDataFrame([("", 1)], "p string, v int"), str(tmp_path / "d"), "p")
    with pytest.raises(ValueError):
        K.generated_keys(spark.range(2).toDF("id"), "id", ["id"])


def test_documents_at_their_paths(spark, tmp_path):
    df = spark.createDataFrame([("x/y.json", 1, "a"), ("x y+z%.json", 2, None)], "p string, v int, t string")
    assert K.write_documents(df, str(tmp_path / "d"), "p") == 2
    assert (tmp_path / "d" / "x" / "y.json").read_text() == '{"v":1,"t":"a"}' and (tmp_path / "d" / "x y+z%.json").read_text() == '{"v":2}'
    assert K.write_documents(df.limit(0), str(tmp_path / "e"), "p") == 0
    driver = df.select("v", F.concat(F.lit(f"{tmp_path}/d/"), "p").alias("path"))
    assert sorted((r["v"], r["value"]) for r in S.load_by_path(driver, "path").collect()) == [(1, '{"v":1,"t":"a"}'), (2, '{"v":2}')]
    for bad in ("../x", "/x", "a/../b", None):
        with pytest.raises(ValueError):
            K.write_documents(spark.createDataFrame([(bad, 1)], "p string, v int"), str(tmp_path / "d"), "p")
    with pytest.raises(ValueError, match="two documents"):
        K.write_documents(df.unionByName(df), str(tmp_path / "d"), "p")


def test_a_table_replaced_by_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    K.replace_table(spark.range(3), path)
    K.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_a_shared_source_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    source = spark.range(10).mapInArrow(count, "id long")
    report = K.run_outputs({"a": lambda df: df.where("id < 3"), "b": lambda df: df}, str(tmp_path / "o"), source=source)
    assert report == {"a": 3, "b": 10} and made.value == 10


def test_layout_fields(spark):
    text = "head line\nA;1; x \nB;2; y "
    get = lambda steps, kind="string": spark.createDataFrame([(text,)], "t string").select(L.layout_field(F.col("t"), steps, kind)).first()[0]
    assert get([("tail", "lines", 1), ("part", "lines", 1, 2), ("field", ";", 2)], "int") == 2
    assert get([("head", "delimiter", " ")]) == "head" and get([("part", "delimiter", "\n", 2), ("field", ";", 3), ("trim", "both", " ")]) == "x"
    assert get([("cells", 6, 4)]) == "line"
    assert spark.range(1).select(L.layout_field(F.lit(None).cast("string"), [("field", ";", 9)])).first()[0] is None
    with pytest.raises(Exception, match="layout"):
        get([("field", ";", 9)])
