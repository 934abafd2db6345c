"""Exact sums, records of any content, byte ranges, documents by path, versions, range lookups, failure rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import compare as C
from tessella.functions import numbers as N
from tessella.operators import checks as V
from tessella.operators import joins as J
from tessella.operators import shape as P
from tessella.operators import windows as O
from tessella.operators.ranges import find_in_range
from tessella.operators.totals import totals
from tessella.ordinal import running_count
from tessella.sources import delimited, files, writers
from tessella.sources import readers as S


def floats(seed):
    """1000 groups of floats of all magnitudes, many of which cancel, and their exact sums."""
    rnd = random.Random(seed)

    def one():
        kind = rnd.random()
        if kind < 0.1:
            return rnd.choice([0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.0])
        return rnd.choice([-1, 1]) * math.ldexp(rnd.getrandbits(53), rnd.choice([rnd.randint(-1074, 900), rnd.randint(-90, 0), rnd.randint(-90, 0)]))

    for g in range(1000):
        items = [one() for _ in range(rnd.randint(1, 20))]
        items += [-x for x in items[: rnd.randint(0, len(items))]]
        rnd.shuffle(items)
        yield g, items, math.fsum(items)


def test_sums_are_exact(spark):
    groups = list(floats(1))
    df = spark.createDataFrame([(g, x) for g, items, _ in groups for x in items], "g int, x double")
    want = {g: s for g, _, s in groups}
    for parts in (1, 7):
        out = totals(df.repartition(parts), ["g"], {"s": ("sum", "x"), "a": ("avg", "x"), "n": ("rows", "x")}).collect()
        assert {r["g"]: r["s"] for r in out} == want
        assert all(math.isclose(r["a"], want[r["g"]] / r["n"], rel_tol=1e-15) for r in out)


@pytest.mark.parametrize("items, total", [([1e44, 1e15, -1e44], 1e15), ([1e30, 1e14, -1e30], 1e14), ([0.1] * 10, 1.0), ([1.7e308, 1.7e308, -1.7e308], 1.7e308), ([None, None], 0.0), ([], 0.0), ([1.0, None], 1.0)])
def test_a_total(spark, items, total):
    df = spark.createDataFrame([(x,) for x in items], "x double")
    assert totals(df, [], {"s": ("sum", "x")}).first()["s"] == total == totals(df.repartition(3), [], {"s": ("sum", "x")}).first()["s"]


@pytest.mark.parametrize("items", [[1.7e308, 1.7e308], [float("nan")], [1.0, float("inf")]])
def test_what_is_not_finite_is_an_error(spark, items):
    df = spark.createDataFrame([(x,) for x in items], "x double")
    with pytest.raises(Exception, match="not finite"):
        totals(df, [], {"s": ("sum", "x")}).collect()


def test_totals_of_all_kinds(spark):
    df = spark.createDataFrame([(None, 1.5, 2**62, "b"), (None, None, 2**61, "a"), (1, 2.5, 3, None)], "k int, x double, n long, t string")
    out = totals(df, ["k"], {"s": ("sum", "x"), "n": ("long_sum", "n"), "rows": ("rows", "x"), "there": ("count", "x"), "low": ("min", "t"), "high": ("max", "t"), "x": ("avg", "x")}).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 1.5, 2**62 + 2**61, 2, 1, "a", "b", 1.5), (1, 2.5, 3, 1, 1, None, None, 2.5)], key=str)
    with pytest.raises(Exception):
        totals(df.unionByName(df), ["k"], {"n": ("long_sum", "n")}).collect()
    assert totals(df.where("k = 7"), ["k"], {"s": ("sum", "x")}).collect() == []


ONE = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.IntegerType())])


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


@pytest.mark.parametrize("text", ["1,1\n2,2,\n", "a,1\nc,3,,x\n", "a,1,,\n", "a,x\n"])
def test_no_cell_is_lost(spark, tmp_path, text):
    df = S.read_csv(spark, put(tmp_path, "a.csv", text), ONE)
    for ask in (df.collect, df.select("s").collect, df.select("n").collect, df.count):
        with pytest.raises(Exception, match="too many columns|not a value of n"):
            ask()


def test_cells_hold_anything(spark, tmp_path):
    text = 's,n\r\n"a\nb",1\r\n"say ""so"", x",2\r\n\r\nplain "quote" inside,3\n"",\n"two\n\nbreaks"\nlast,"4"'
    rows = [(r["s"], r["n"]) for r in S.read_csv(spark, put(tmp_path, "a.csv", text), ONE, header=True).collect()]
    assert sorted(rows, key=str) == sorted([("a\nb", 1), ('say "so", x', 2), ('plain "quote" inside', 3), (None, None), ("two\n\nbreaks", None), ("last", 4)], key=str)
    many = put(tmp_path, "b.csv", "s;n\n" + "".join(f"x{i};{i}\n" for i in range(100)))
    assert S.read_csv(spark, many, ONE, ";", header=True).agg(F.sum("n")).first()[0] == 4950
    nan = put(tmp_path, "c.csv", "1.5\nNaN\n")
    with pytest.raises(Exception, match="not a value"):
        S.read_csv(spark, nan, T.StructType.fromDDL("x double")).collect()


def test_records_run_over_the_ends_of_splits(spark, tmp_path):
    rnd = random.Random(2)
    cells = [("".join(rnd.choice('ab,;"\n') for _ in range(rnd.randint(0, 400))), i) for i in range(300)]
    cells.append(("x" * 5000 + "\n" + "y" * 5000, 300))
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    for name in ("a.csv", "b.csv"):
        put(tmp_path, name, "s,n\n" + "".join(f"{quoted(s)},{n}\n" for s, n in cells))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = S.read_csv(spark, f"{tmp_path}/*.csv", ONE, header=True)
        assert delimited.lines_of(spark, f"{tmp_path}/*.csv").select("file", "split").distinct().count() > 20
        assert sorted((r["s"] or "", r["n"]) for r in df.collect()) == sorted(cells * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16-le"])
def test_an_unbroken_file_is_cut_by_bytes(spark, tmp_path, encoding):
    letters = "aé" if encoding == "latin-1" else "aé€\U0001f642" if encoding == "utf-8" else "aé€"
    rnd = random.Random(4)
    records = ["".join(rnd.choice(letters) for _ in range(7)) for _ in range(500)]
    (tmp_path / "f.bin").write_bytes("".join(records).encode(encoding))
    (tmp_path / "g.bin").write_bytes("".join(records[:3]).encode(encoding))
    (tmp_path / "h.bin").write_bytes(b"")
    df = files.fixed_records(spark, str(tmp_path), 7, encoding, size=40)
    assert sorted(r["_r"] for r in df.collect()) == sorted(records + records[:3])
    assert df.rdd.getNumPartitions() > 50
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "a").write_bytes("abcdefghi".encode(encoding))
    with pytest.raises(Exception, match="7 characters"):
        S.read_fixed_width(spark, str(tmp_path / "short"), [("x", 7, "string")], delimited=False, encoding=encoding).collect()


def test_many_documents_by_path(spark, tmp_path):
    n = 3000
    for i in range(n):
        (tmp_path / f"d{i}").write_text(f'[{{"v":{i}}},{{"v":{-i}}}]')
    driver = spark.range(2 * n).select("id", F.concat(F.lit(f"file:{tmp_path}/d"), F.col("id") % n).alias("path"))
    docs = S.load_by_path(driver, "path", "json", schema="v long")
    assert docs.count() == 4 * n and docs.where(F.abs("v") != F.col("id") % n).count() == 0
    lines = spark.createDataFrame([(f"{tmp_path}/d1",), (None,)], "path string")
    assert [r["value"] for r in S.load_by_path(lines, "path").collect()] == ['[{"v":1},{"v":-1}]']
    assert S.load_by_path(lines, "path", "binary").first()["content"] == b'[{"v":1},{"v":-1}]'
    with pytest.raises(Exception, match="No such file|Failed to open"):
        S.load_by_path(spark.createDataFrame([(f"{tmp_path}/none",)], "path string"), "path").collect()


def test_a_version_is_there_whenever_a_job_dies(spark, tmp_path, monkeypatch):
    path, ids = str(tmp_path / "t"), lambda: sorted(r["id"] for r in writers.current_table(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        writers.current_table(spark, path)
    writers.commit_table(spark.range(1), path)
    writers.commit_table(spark.range(2), path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(writers, "moved", dies)
        writers.commit_table(spark.range(3), path)
    assert ids() == [0, 1]
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(writers, "removed", dies)
        writers.commit_table(spark.range(4), path)
    assert ids() == [0, 1, 2, 3]
    with pytest.raises(Exception, match="stop"):
        writers.commit_table(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    writers.commit_table(writers.current_table(spark, path).where("id > 0"), path)
    assert ids() == [1, 2, 3] and len(writers.versions(spark, path)) == 2
    with pytest.raises(ValueError):
        writers.commit_table(spark.range(1).toDF("other"), path)


@pytest.mark.parametrize("closed", list(itertools.product((True, False), repeat=2)))
def test_first_matches_by_inequality(spark, closed):
    rnd = random.Random(6)
    bound = lambda: None if rnd.random() < 0.1 else rnd.randint(0, 60)
    rows = [(i, bound(), bound(), rnd.choice("xy")) for i in range(80)]
    asked = [(i, bound(), rnd.choice(["x", "y", None])) for i in range(100)] * 2
    df, table = spark.createDataFrame(asked, "q int, v int, k string"), spark.createDataFrame(rows, "i int, low int, high int, t string")
    holds = lambda v, low, high: v is not None and (low is None or low < v or (closed[0] and low == v)) and (high is None or v < high or (closed[1] and v == high))
    for keys in ([], [("k", "t")]):
        out = find_in_range(df, table, "v", "low", "high", ["i"], F.col("i"), "hit", keys, closed)
        want = [(q, v, k, min((i for i, a, b, t in rows if holds(v, a, b) and (not keys or t == k)), default=None)) for q, v, k in asked]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        J.find(df, table, [], F.col("v") > F.col("low"), F.col("i"), ["i"], "hit")


def test_mixed_numbers_are_in_exact_order(spark):
    values = ["9007199254740993", "9007199254740992", "9007199254740991.0", "9223372036854775807", "9223372036854775808.0", "1e3", "-5", "true", None, "x", "NaN"]
    want = [None, "true", "-5", "1e3", "9007199254740991.0", "9007199254740992", "9007199254740993", "9223372036854775807", "9223372036854775808.0", "NaN", "x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r["v"] for r in df.orderBy(*O.mixed_order(F.col("v"))).collect()] == want


def test_null_and_mixed_keys(spark):
    groups = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    rows = spark.createDataFrame([(None, 5), (None, 7), (1, 9)], "k int, v int")
    assert sorted(map(tuple, P.first_or_empty(groups, rows, ["k"], ["v"]).collect()), key=str) == [(1, 9), (2, None), (None, 5)]
    assert sorted(((r["k"], r["s"]) for r in P.mapped_sequence(groups, rows, ["k"], F.col("v"), ["v"], "s").collect()), key=str) == [(1, [9]), (2, []), (None, [5, 7])]
    assert sorted(map(tuple, J.join_totals(groups, ["k"], rows, {"t": F.sum("v")}, {"t": 0}).collect()), key=str) == [(1, 9), (2, 0), (None, 12)]
    words = spark.createDataFrame([("a", 1), ("1", 1), (None, 1)], "w string, x int")
    table = spark.createDataFrame([(1, "one"), (None, "none")], "n int, t string")
    assert sorted((str(r["w"]), r["t"]) for r in J.lookup(words, table, [("w", "n")], ["t"], {"t": "t"}).collect()) == [("1", None), ("None", "none"), ("a", None)]
    assert [r["t"] for r in J.lookup(words.select(F.lit(1).cast("long").alias("w")), table, [("w", "n")], ["t"], {"t": "t"}).collect()] == ["one"] * 3


def test_values_of_mixed_types(spark):
    row = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert [row(c) for c in (C.one_of(F.lit("abc"), 1), C.one_of(F.lit("1"), 1), C.one_of(F.lit(1), "1", 2.5), C.one_of(F.lit(None).cast("int"), 1), C.none_of(F.lit("abc"), 1), C.one_of(F.lit(1)))] == [False, True, True, False, True, False]
    assert [row(N.round_half_away(F.lit(x))) for x in (0.49999999999999994, 0.5, -0.5, 2.5, -2.5, 1.4, 4503599627370497.5)] == [0.0, 1.0, -1.0, 3.0, -3.0, 1.0, 4503599627370498.0]
    kinds = [("long", {1: "one", None: "null"}, [("1", "one"), (" 1 ", "one"), ("x", "?"), (1.0, "one"), (1.5, "?"), (True, "?"), (None, "null")]), ("string", {"1": "one", "true": "yes"}, [(1, "one"), (1.0, "one"), (True, "yes"), ("2", "?")]), ("boolean", {True: "yes", False: "no"}, [("1", "yes"), ("false", "no"), (1, "?"), (True, "yes")]), ("double", {1.5: "x"}, [("1.5", "x"), ("NaN", "?"), (1.5, "x"), (2, "?")])]
    for kind, entries, cases in kinds:
        for value, want in cases:
            lit = F.lit(value) if value is not None else F.lit(None).cast("string")
            assert row(C.value_map(lit, entries, "?", input_type=kind)) == want, (kind, value)


@pytest.mark.parametrize("array, unique", [('[{"a":1,"b":2},{"b":2.0,"a":1}]', False), ("[1, 1.0]", False), ("[1e2, 100]", False), ("[0, -0.0]", False), ('["1", 1]', True), ("[[1,2],[2,1]]", True), ("[true, 1]", True), ("[null, null]", False), ("[]", True), ("{}", True), (None, True), ("[9007199254740993, 9007199254740992]", True), ('[{"a":{"x":[1,{"y":2}]}},{"a":{"x":[1.0,{"y":2e0}]}}]', False)])
def test_items_are_unique_by_value(spark, array, unique):
    assert spark.createDataFrame([(array,)], "t string").select(V.unique_json_items(F.col("t"))).first()[0] == unique


def test_failure_rules_come_before_any_output(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "a"), (2, -1, "b"), (3, -2, "c"), (4, None, "d")], "i int, v int, t string")
    rule = lambda c, mode="true", order="i", d=df: V.FailureRule(d, c, F.col("t"), [order], mode)
    bad, fine = F.col("v") < 0, F.col("v") < 100
    for rules, message in (([rule(bad)], "rule 1: b"), ([rule(F.coalesce(fine, F.lit(True)), "false"), rule(F.coalesce(bad, F.lit(False)), order="v")], "rule 2: c"), ([rule(fine, "false")], "rule 1: the condition is null"), ([rule(None, "all", d=df.where("i > 2"))], "rule 1: c")):
        with pytest.raises(V.Violation) as e:
            writers.run_outputs({"x": df}, str(tmp_path / "o"), failures=rules)
        assert str(e.value) == message and not (tmp_path / "o").exists()
    assert writers.run_outputs({"x": df}, str(tmp_path / "o"), failures=[rule(None, "all", d=df.where("i > 9"))]) == {"x": 4}


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_running_counts_over_blocks_of_blocks(spark, block):
    df = spark.range(1, 101).select("id", (F.col("id") % 3 == 0).alias("f"))
    got = {r["id"]: r["n"] for r in running_count(df, "f", "id", "n", block).collect()}
    assert got == {i: i // 3 for i in range(1, 101)}


def test_a_deep_tree_takes_few_joins(spark, monkeypatch):
    from tessella.operators import trees

    rounds, kept = [], trees.checkpointed
    monkeypatch.setattr(trees, "checkpointed", lambda df: rounds.append(df.columns) or kept(df))
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)] + [(900, 901), (901, 900), (902, 950)], "k int, p int")
    tree = trees.adjacency_tree(rows, "k", "p", F.col("p").isNull()).collect()
    assert {r["key"]: (r["parent"], r["depth"], len(r["path"])) for r in tree} == {i: (i - 1 if i else None, i, i + 1) for i in range(200)}
    assert sum("depth" in c for c in rounds) - 1 <= 9
    with pytest.raises(ValueError, match="levels deep"):
        trees.adjacency_tree(spark.range(300).selectExpr("id k", "nullif(id - 1, -1) p"), "k", "p", F.col("p").isNull())
    with pytest.raises(ValueError, match="cycle"):
        trees.adjacency_tree(spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "k int, p int"), "k", "p", F.col("k") == 1)
