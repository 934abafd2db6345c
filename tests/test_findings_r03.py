"""What the findings of round 3 were about."""

import math
import os
from decimal import Decimal

from compare import SMALL, assert_same, connection
from pyspark.sql import functions as F

from tessella.functions import dates as D
from tessella.functions import numbers as N
from tessella.operators import trees
from tessella.operators.ranges import find_in_range
from tessella.operators.totals import totals
from tessella.plans import catalog, text_queries
from tessella.plans.registry import Tables
from tessella.sources import edi as E


def test_f1_a_tree_without_paths_keeps_one_small_table(spark):
    """Chains of 150 below one root: what stays on disk does not hold the paths, nor the tables of earlier rounds."""
    n = 60000
    rows = spark.range(n).selectExpr("id + 1 AS k", "if(id % 150 = 0, 0L, id) AS p").unionByName(spark.sql("SELECT 0L AS k, CAST(NULL AS BIGINT) AS p"))
    spark.range(1).checkpoint() if spark.sparkContext.getCheckpointDir() else spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before = size()
    tree = trees.adjacency_tree(rows, "k", "p", F.col("p").isNull(), paths=False)
    assert size() - before < 40 * n
    assert tree.columns == ["key", "parent", "depth"]
    assert tree.where("depth <> if(key = 0, 0, 1 + (key - 1) % 150)").count() == 0 and tree.count() == n + 1


def test_f2_equal_texts_follow_their_keys(spark, tmp_path):
    """Brand#1 and part 13536, Brand#11 and part 3536 give one text."""
    parts = [(n, f"Brand#{b}") for b, n in ((1, 13536), (11, 3536), (1, 17120), (11, 7120), (1, 12544), (11, 2544))]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.queries()["o2_exact_order"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["p_partkey"] for r in got] == [2544, 12544, 3536, 13536, 7120, 17120]


def test_f3_tasks_of_messages_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(E, "DOCUMENTS", 50)
    sizes = [r["count"] for r in text_queries.order_messages(Tables(spark, SMALL)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) > 1000
    assert max(sizes) < 100


def test_f8_separators_are_no_patterns_of_each_row(spark):
    texts = ["UNA|^,? ~AB^x|y^w~ CD^^z~", "AB+x:y?:z+?+'CD'", "UNA:+.? 'AB+1'", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    seg = E.edi_segments(df, "t", "edifact").drop("t")
    assert "\\Q" not in seg._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in seg.orderBy("i", "seg_no").collect()] == [(0, 1, "AB", [["x", "y"], ["w"]]), (0, 2, "CD", [[""], ["z"]]), (1, 1, "AB", [["x", "y:z"], ["+"]]), (1, 2, "CD", []), (2, 1, "AB", [["1"]])]


def test_f6_f11_pictures_of_digits_are_one_pattern(spark):
    df = spark.sql("SELECT timestamp'2024-02-09 03:04:05' AS ts, '9.2.2024' AS d")
    shown = df.select(D.format_datetime(F.col("ts"), "[D01]/[M01] o'clock [Y] [H01]:[m01]:[s01]").alias("a"), D.parse_date(F.col("d"), "[D].[M].[Y]").alias("b"))
    assert tuple(shown.first()) == ("09/02 o'clock 2024 03:04:05", "2024-02-09")
    plan = df.select(D.format_datetime(F.col("ts"), "[D01]/[M01]/[Y] [H01]:[m01]:[s01]").alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("date_format(") == 1


def test_f9_short_products_need_no_texts(spark):
    values = [0.1, -0.1, 0.3, 1.005, 0.0, -0.0, 123456.7891, 12345.67891, 1e-5, 1e10, 99999999999.9, 1e300, float("inf"), 3.3333]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    product = N.multiply(F.col("a"), F.col("b"))
    assert "rint" in df.select(product)._jdf.queryExecution().analyzed().toString().lower()
    for r in df.select("a", "b", product.alias("p")).collect():
        want = r["a"] * r["b"] if math.inf in (r["a"], r["b"]) else float(Decimal(repr(r["a"])) * Decimal(repr(r["b"])))
        assert r["p"] == want or math.isnan(want) and math.isnan(r["p"]), r


def test_f7_f10_equal_ranges_are_one(spark):
    table = spark.createDataFrame([(3, 1, 5), (2, 1, 5), (1, 4, 9), (0, None, 0)], "i int, low int, high int")
    out = find_in_range(spark.createDataFrame([(v,) for v in (0, 1, 4, 9, 10, None)], "v int"), table, "v", "low", "high", ["i"], F.col("i"), "hit")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(0, 0), (1, 2), (4, 1), (9, 1), (10, None), (None, None)], key=str)
    assert "Aggregate [_low" in out._jdf.queryExecution().analyzed().toString()


def test_f4_f5_a_sum_and_an_average_share_windows(spark):
    items = spark.createDataFrame([("a", x) for x in (1e100, 0.1, -1e100, 0.2)] + [("b", x) for x in (5e-324, -5e-324)] + [("c", -1.5), ("d", None)], "k string, x double")
    out = totals(items, ["k"], {"s": ("sum", "x"), "m": ("avg", "x")})
    got = {r["k"]: (r["s"], r["m"]) for r in out.collect()}
    assert got == {"a": (math.fsum([0.1, 0.2]), math.fsum([0.1, 0.2]) / 4), "b": (0.0, 0.0), "c": (-1.5, -1.5), "d": (0.0, None)}
    assert "_x1" not in out._jdf.queryExecution().analyzed().toString()
