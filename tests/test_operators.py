"""Edge cases on tiny frames: nulls, ties, empties, order."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import checks as V
from tessella.operators import functions as D
from tessella.operators import grouping as A
from tessella.operators import joins as J
from tessella.operators import sequences as G
from tessella.operators import shape as P
from tessella.operators import trees as H
from tessella.operators import windows as O
from tessella.operators.totals import totals
from tessella.ordinal import with_ordinal


def test_ordinal_is_dense_whatever_the_partitions(spark):
    for parts in (1, 3, 7):
        df = spark.range(100).select((F.col("id") * 37 % 100).alias("k")).repartition(parts)
        assert sorted(tuple(r) for r in with_ordinal(df, ["k"]).collect()) == [(k, k + 1) for k in range(100)]


def test_join_drops_null_keys_and_reads_text_as_numbers(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id int, label string")
    b = spark.createDataFrame([("1", "p"), (None, "q")], "aid string, code string")
    assert sorted(r["label"] + r["code"] for r in J.inner_join(a, b, [("id", "aid")]).collect()) == ["xp", "yp"]


def test_lookup_takes_the_first_and_matches_null(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (None, 3, "none")], "k int, ord int, v string")
    out = J.lookup(a, b, [("id", "k")], ["ord"], {"v": "name"})
    assert {r["id"]: r["name"] for r in out.collect()} == {1: "early", 2: None, None: "none"}


def test_groups_keep_first_seen_order_and_null(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "ord int, k string")
    out = A.group_by(df, ["k"], {"n": A.item_count()}, ["ord"], "g").collect()
    assert sorted((r["g"], r["k"], r["n"]) for r in out) == [(1, "b", 2), (2, None, 1), (3, "a", 1)]


def test_group_boundaries(spark):
    df = spark.createDataFrame([(i, k, e) for i, (k, e) in enumerate([("a", False), ("a", True), ("b", False), ("a", True), ("c", False)])], "ord int, k string, e boolean").withColumn("one", F.lit(1))
    run = lambda f: [r["run"] for r in f.orderBy("ord").collect()]
    assert run(A.group_adjacent(df, "k", ["ord"], ["one"])) == [1, 1, 2, 3, 4]
    assert run(A.group_adjacent_global(df, "k", ["ord"])) == [1, 1, 2, 3, 4]
    assert run(A.group_starting_with(df, F.col("e"), ["ord"], ["one"])) == [0, 1, 1, 2, 2]
    assert run(A.group_ending_with(df, F.col("e"), ["ord"], ["one"])) == [0, 0, 1, 1, 2]
    assert [r["block"] for r in A.group_into_blocks(df, 2, ["ord"]).orderBy("ord").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        A.group_into_blocks(df, 0, ["ord"])
    with pytest.raises(ValueError):
        A.one_mode(by="k", blocks=2)


@pytest.mark.parametrize("large", [0, 80, 1000])
def test_groups_of_any_size(spark, monkeypatch, large):
    """All groups spread over tasks, one of them, or none: with the same results."""
    monkeypatch.setattr(A, "LARGE_GROUP", large)
    r = random.Random(5)
    data = [(i, r.choice(["hot", "hot", "hot", "cold", None]), r.choice(["a", "b", None]), r.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(data, "i int, u string, k string, e boolean").repartition(5)
    want = {m: {} for m in ("adjacent", "starting", "ending", "block", "last")}
    for u in ("hot", "cold", None):
        rows, run, starts, ends = [x for x in data if x[1] == u], 0, 0, 0
        for at, (i, _, k, e) in enumerate(rows):
            run += at == 0 or rows[at - 1][2] != k
            starts += bool(e)
            want["adjacent"][i], want["starting"][i], want["ending"][i], want["block"][i] = run, starts, ends, at // 7
            ends += bool(e)
        want["last"] |= {x[0]: n for n, x in enumerate(rows[2:][-4:], 1)}
    made = {
        "adjacent": A.group_adjacent(df, "k", ["i"], ["u"], "n"),
        "starting": A.group_starting_with(df, F.col("e"), ["i"], ["u"], "n"),
        "ending": A.group_ending_with(df, F.col("e"), ["i"], ["u"], "n"),
        "block": A.group_into_blocks(df, 7, ["i"], ["u"], "n"),
        "last": O.select_rows(df, [("skip", 2), ("last", 4)], ["i"], ["u"], "n"),
    }
    for mode, out in made.items():
        assert out.columns == [*df.columns, "n"]
        got = {x["i"]: x["n"] for x in out.collect()}
        assert got == want[mode], mode
        assert ("Union" in out._jdf.queryExecution().analyzed().toString()) == (large < 1000), mode
    empty = A.group_adjacent(df.where("false"), "k", ["i"], ["u"])
    assert empty.count() == 0


def test_distinct_values_keep_the_first_and_a_missing_key(spark):
    df = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, None, "m"), (4, "A", "x")], "ord int, k string, v string")
    assert sorted(r["v"] for r in A.distinct_values(df, ["k"], ["ord"]).collect()) == ["a", "b", "m"]


def test_empty_reducers(spark):
    df = spark.createDataFrame([], "k int, v double, ord int")
    assert totals(df, [], {"s": ("sum", "v"), "a": ("avg", "v")}).first() == (0.0, None)
    assert df.agg(A.string_join("v", ["ord"]).alias("j")).first()["j"] == ""


@pytest.mark.parametrize("steps, want", [([("skip", 2), ("first", 3)], [3, 4, 5]), ([("first", 4), ("from", 3)], [3, 4]), ([("range", 2, 3)], [2, 3]), ([("last", 2)], [9, 10]), ([("first", -1)], []), ([("first", 5), ("last", 2)], [4, 5])])
def test_chained_selections(spark, steps, want):
    df = spark.range(1, 11).withColumn("g", F.lit(1))
    for within in (None, ["g"]):
        out = O.select_rows(df, steps, ["id"], within, "n").orderBy("id").collect()
        assert [r["id"] for r in out] == want
        assert [r["n"] for r in out] == list(range(1, len(want) + 1))


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, float("nan")), (4, 0.0)], "ord int, v double")
    assert [r["ord"] for r in O.sorted_by(df, [("v", True)], "ord").collect()] == [1, 4, 2, 3]
    assert [r["ord"] for r in O.sorted_by(df, [("v", False)], "ord").collect()] == [3, 2, 4, 1]


def test_mixed_order(spark):
    df = spark.createDataFrame([("b",), ("10",), (None,), ("9",), ("true",)], "v string")
    assert [r["v"] for r in df.orderBy(*O.mixed_order(F.col("v"))).collect()] == [None, "true", "9", "10", "b"]


def test_sequences(spark):
    df = spark.createDataFrame([(" alpha, beta,gamma", "Aé🙂Z"), ("", ""), (None, None)], "w string, c string")
    got = df.select(G.tokenize(F.col("w"), ",").alias("w"), G.tokenize_by_length(F.col("c"), 2).alias("c"), G.tokenize_regex(F.col("w"), ", ?").alias("r")).collect()
    assert [list(r) for r in got] == [[[" alpha", " beta", "gamma"], ["Aé", "🙂Z"], [" alpha", "beta", "gamma"]], [[""], [], []], [[], [], []]]
    r = spark.range(1).select(G.generate(5, 1).alias("a"), G.generate(1, 3).alias("b"), G.sequence_aggregate("avg", G.generate(1, 4)).alias("m")).first()
    assert (r["a"], r["b"], r["m"]) == ([], [1, 2, 3], 2.5)
    for bad in (lambda: G.tokenize("x", ""), lambda: G.tokenize_by_length("x", 0), lambda: G.tokenize_regex("x", "a*")):
        with pytest.raises(ValueError):
            bad()


def test_nesting_keeps_parents_without_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, ord int, v string")
    out = {r["k"]: [x["v"] for x in r["items"]] for r in P.nest(parents, children, ["k"], "items", ["v"], ["ord"]).collect()}
    assert out == {1: ["a", "b"], 2: []}
    assert P.iterate(P.nest(parents, children, ["k"], "items", ["v"], ["ord"]), "items", "x", "n").count() == 2


def test_dynamic_object_refuses_a_name_that_comes_twice(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="(?i)duplicat"):
        P.dynamic_object(df, [], F.col("k"), F.col("v")).collect()


def test_single_group(spark):
    with pytest.raises(Exception, match="single group"):
        P.single_group(spark.range(2), {"id": F.col("id")}).collect()


def test_adjacency_tree(spark):
    df = spark.createDataFrame([("Root", None), ("Beta", "Root"), ("Alpha", "Root"), ("Leaf", "Beta"), ("Lost", "Lost")], "name string, base string")
    tree = H.adjacency_tree(df, "name", "base", F.col("base").isNull())
    assert {r["key"]: r["depth"] for r in tree.collect()} == {"Root": 0, "Beta": 1, "Alpha": 1, "Leaf": 2}
    with pytest.raises(ValueError, match="twice"):
        H.adjacency_tree(df.union(df), "name", "base", F.col("base").isNull())
    with pytest.raises(ValueError, match="one root"):
        H.adjacency_tree(df, "name", "base", F.lit(False))


def test_path_hierarchy_counts_duplicates_and_wants_one_root(spark):
    df = spark.createDataFrame([("a/b/x",), ("a/b/x",), ("a/y",), ("",), ("z",)], "p string")
    folders, files = H.path_hierarchy(df, "p")
    assert sorted(r["path"] for r in folders.collect()) == ["a", "a/b"]
    assert sorted((r["parent"], r["name"], r["n"]) for r in files.collect()) == [("a", "y", 1), ("a/b", "x", 2)]
    with pytest.raises(ValueError):
        H.path_hierarchy(spark.createDataFrame([("a/x",), ("b/y",)], "p string"), "p")


def test_enforce_and_failure_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "id int, v int")
    with pytest.raises(V.Violation, match="positive"):
        V.enforce(df, ["id"], {"positive": (F.col("v") > 0, F.col("v"))})
    with pytest.raises(V.Violation, match="bad 2"):
        V.fail_when(df, F.col("v") < 0, F.concat(F.lit("bad "), "id"), ["id"])
    assert V.enforce(df.where("v > 0"), ["id"], {"positive": (F.col("v") > 0, F.col("v"))}).count() == 1


def test_singleton_with_two_records_is_an_error(spark):
    with pytest.raises(ValueError):
        J.with_singleton(spark.range(3), spark.range(2).toDF("x"))


def test_totals_of_null_keys_stay(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, None, 9), (3, None, 9)], "i int, k string, n int")
    rows = sorted(tuple(r) for r in A.with_group_total(df, ["k"], {"n": A.item_count()}).select("i", "k", "n").collect())
    assert rows == [(1, "a", 1), (2, None, 2), (3, None, 2)]


def test_sums_keep_small_items(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1e100, 1.0, -1e100)] + [(None,)], "x double")
    total = lambda d, kind="sum": totals(d, [], {"t": (kind, "x")}).first()["t"]
    assert total(df) == 2.0
    assert (total(df.where("x > 1e200")), total(df.where("x > 1e200"), "avg")) == (0.0, None)
    big = spark.createDataFrame([(1.7e308,), (1.7e308,)], "x double")
    assert total(big, "avg") == 1.7e308
    assert total(spark.createDataFrame([(0.1,)] * 10, "x double")) == 1.0
    longs = spark.createDataFrame([(2**62,), (2**61 + 1,)], "x long")
    assert longs.agg(A.item_sum("x")).first()[0] == 2**62 + 2**61 + 1
    with pytest.raises(Exception):
        longs.unionByName(longs).agg(A.item_sum("x")).collect()


def test_equal_rows_are_each_found(spark):
    df, table = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(1, 5), (1, 4)], "t int, v int")
    got = sorted((r["k"] or 0, r["hit"]) for r in J.find(df, table, [("k", "t")], F.col("v") > 4, F.col("v"), ["v"], "hit").collect())
    assert got == [(0, None), (1, 5), (1, 5)]


def test_item_at_reads_no_more_than_it_needs(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 7), (None, 2), (None, 4)], "k string, v int")
    rows = sorted(((r["k"] or ""), r["x"]) for r in A.item_at(df, ["k"], "v", ["v"], 2, "x").collect())
    assert rows == [("", 4), ("a", 3), ("b", None)]
    assert "WindowGroupLimit" in A.item_at(df, ["k"], "v", ["v"], 2, "x")._jdf.queryExecution().toString()


def test_one_grouping_mode(spark):
    df = spark.createDataFrame([(i, i // 2 % 2) for i in range(6)], "i int, k int").withColumn("u", F.lit(1))
    groups = lambda **mode: [r["group"] for r in A.group_rows(df, ["i"], ["u"], **mode).orderBy("i").collect()]
    assert groups(by=["k"]) == [1, 1, 2, 2, 1, 1] and groups(adjacent="k") == [1, 1, 2, 2, 3, 3]
    assert groups(starting=F.col("i") == 2) == [0, 0, 1, 1, 1, 1] and groups(ending=F.col("i") == 2) == [0, 0, 0, 1, 1, 1] and groups(block=4) == [0, 0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        groups(by=["k"], block=2)


def test_targets_adapt_numbers(spark):
    adapted = lambda c, t: spark.range(1).select(F.to_json(F.struct(P.adapted_number(c, t).alias("v")))).first()[0]
    assert adapted(F.lit(float(2**60)), "long") == '{"v":1152921504606846976}' and adapted(F.lit(1.5), "long") == '{"v":1.5}' and adapted(F.lit(1e19), "long") == '{"v":1.0E19}'
    assert adapted(F.lit(7), "double") in ('{"v":7.0}', '{"v":7}') and adapted(F.lit(2**53 + 1), "double") == '{"v":9007199254740993}'
    kind = lambda c, *t: spark.range(1).select(F.schema_of_variant(P.adapted_union(c.cast("variant"), list(t)))).first()[0]
    assert kind(F.lit(2.0), "long", "string") == "BIGINT" and kind(F.lit(2.0), "long", "double") == "DOUBLE"
    assert kind(F.lit(2.5), "long", "string") == "DOUBLE" and kind(F.lit(3), "double") == "DOUBLE" and kind(F.lit("x"), "long") == "STRING"
    assert [spark.range(1).select(P.whole_number(F.lit(x))).first()[0] for x in (float(2**60), 9.3e18, 0.5, float("nan"), float("-inf"))] == [2**60, None, None, None, None]


def test_trees_are_filtered_at_every_depth(spark):
    leaf = "struct<items array<int>>"
    kind = f"struct<items array<int>, nodes array<struct<items array<int>, nodes array<{leaf}>>>>"
    df = spark.createDataFrame([(([1, 5], [([2], [([9, 3],)]), ([], None)]),)], f"tree {kind.replace('struct<items', 'struct<items:').replace(', nodes', ', nodes:')}")
    got = df.select(H.recursive_filter(F.col("tree"), df.schema["tree"].dataType, "items", "nodes", lambda x: x > 4)).first()[0]
    assert got["items"] == [5] and [n["items"] for n in got["nodes"]] == [[], []] and got["nodes"][0]["nodes"][0]["items"] == [9] and got["nodes"][1]["nodes"] is None


def test_errors_that_a_job_must_see(spark):
    with pytest.raises(ValueError):
        H.path_hierarchy(spark.createDataFrame([("",)], "p string"), "p")
    with pytest.raises(Exception):
        P.surviving(spark.range(1), F.lit(None).cast("boolean")).collect()
    with pytest.raises(ValueError):
        P.bind(spark.range(1), [("a", F.col("id")), ("a", F.col("id"))])
    with pytest.raises(KeyError):
        D.parameter({}, "x", "int")
    assert spark.range(1).select(D.parameter({"x": "7"}, "x", "int"), D.runtime_value("mapping_path", "/jobs/a")).first() == (7, "/jobs/a")
