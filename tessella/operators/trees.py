"""Trees from rows: adjacency pairs, path strings, and walks over edge tables. Walks are doubled: what is reached grows by
twice as many levels with each join, so a tree of depth d takes about log2(d) joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.ordinal import checkpointed, discard, stored

#: Deepest tree.
DEPTH = 256


def reached(start: DataFrame, edges: DataFrame, arrays: list[str]) -> DataFrame:
    """(node, depth, arrays) of all walks from the start along edges (top, bottom, arrays); arrays are joined on the way. A walk
    of DEPTH edges is an error."""
    found = checkpointed(start.withColumn("depth", F.lit(0)))
    # Walks of exactly `length` edges; those found so far have fewer.
    steps, length = checkpointed(edges), 1
    joined = lambda a, b: [F.concat(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c) for c in arrays]
    while True:
        new = found.alias("f").join(steps.alias("s"), F.col("node") == F.col("top")).select(F.col("bottom").alias("node"), (F.col("depth") + length).alias("depth"), *joined("f", "s"))
        new = checkpointed(new)
        if new.isEmpty():
            return found
        if length >= DEPTH:
            raise ValueError(f"the tree is {DEPTH} levels deep")
        found = found.unionByName(new)
        twice = steps.alias("a").join(steps.alias("b"), F.col("a.bottom") == F.col("b.top"))
        steps, length = checkpointed(twice.select("a.top", "b.bottom", *joined("a", "b"))), length * 2


def adjacency_tree(rows: DataFrame, key: str, parent: str, roots: Column, paths: bool = True) -> DataFrame:
    """(key, parent, depth, path) of all rows that the root reaches; rows that it does not reach are dropped. Without `paths`
    there is no path, which takes as much room as all depths together.

    A key that comes twice, none or several roots, a cycle that is reached and a depth of DEPTH are errors.
    """
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0][key]} comes twice")
    names = F.array(F.col(key).cast("string"))
    root = rows.where(roots).select(F.col(key).alias("node"), F.col(parent).alias("parent"), names.alias("path"))
    found = root.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a tree has one root")
    spark, top = rows.sparkSession, F.lit(found[0]["node"])
    carried = ["path"] if paths else []
    # Each row points to the node `depth` edges above it, and is done when that is the root. A round lets it point to where
    # that node points; one table holds all rows, so that the round before can go.
    first = rows.where(F.col(parent).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("parent"), F.col(parent).alias("top"), F.lit(1).alias("depth"), *([names.alias("path")] if paths else []))
    (steps, path), before = stored(first), 0
    while True:
        done = F.col("top") == top
        state = steps.agg(F.count_if(done).alias("done"), F.count_if(~done).alias("open"), F.max(F.when(done, F.col("depth"))).alias("depth"), F.count_if(done & (F.col("node") == top)).alias("cycle")).first()
        if state["cycle"]:
            raise ValueError("the tree has a cycle")
        if state["done"] and state["depth"] >= DEPTH:
            raise ValueError(f"the tree is {DEPTH} levels deep")
        # Without a row at the next depths there is none below them: what is open hangs on other cycles.
        if not state["open"] or state["done"] == before:
            break
        before = state["done"]
        low, up = steps.where(~done).alias("a"), steps.alias("b")
        joined = low.join(up, F.col("a.top") == F.col("b.node")).select("a.node", "a.parent", "b.top", (F.col("a.depth") + F.col("b.depth")).alias("depth"), *[F.concat(f"b.{c}", f"a.{c}").alias(c) for c in carried])
        old = path
        steps, path = stored(steps.where(done).unionByName(joined))
        discard(spark, old)
    tree = steps.where(F.col("top") == top).select(F.col("node").alias("key"), "parent", "depth", *[F.concat(F.array(top.cast("string")), c).alias(c) for c in carried])
    return root.select(F.col("node").alias("key"), "parent", F.lit(0).alias("depth"), *carried).unionByName(tree)


def path_hierarchy(df: DataFrame, path: str, sep: str = "/", order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(directories, files) of path strings: directory (path, parent, name, first_seen), file (parent, name, n). Empty paths
    and files without a directory are skipped, duplicate files are counted, and there is exactly one root or an error."""
    order = F.col(order_by) if order_by else F.col(path)
    split = df.where(F.coalesce(F.col(path), F.lit("")) != "").select(F.split(path, f"\\Q{sep}\\E").alias("_p"), order.alias("_ord")).where(F.size("_p") > 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.struct(F.array_join(F.slice("_p", 1, i), sep).alias("path"), F.when(i > 1, F.array_join(F.slice("_p", 1, i - 1), sep)).alias("parent"), F.get("_p", i - 1).alias("name")))
    folders = split.select("_ord", F.explode(prefixes).alias("d")).groupBy("d.path", "d.parent", "d.name").agg(F.min("_ord").alias("first_seen"))
    files = split.groupBy(F.array_join(F.slice("_p", 1, F.size("_p") - 1), sep).alias("parent"), F.element_at("_p", -1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    roots = folders.where("parent is null").limit(2).count()
    if roots != 1:
        raise ValueError("several roots" if roots else "no root")
    return folders, files.where("name <> ''")


def recursive_filter(node: Column, kind: T.StructType, items: str, children: str, keep: Callable[[Column], Column]) -> Column:
    """A tree node (struct of type kind with an array of items and an array of child nodes) with the items filtered at every
    depth that its type has; branches stay, even when they are empty."""
    out = node.withField(items, F.filter(node[items], keep)) if items in kind.names else node
    if children in kind.names:
        inner = kind[children].dataType.elementType
        out = out.withField(children, F.transform(node[children], lambda c: recursive_filter(c, inner, items, children, keep)))
    return out


def recursive_collect(edges: DataFrame, leaves: DataFrame, root: str, sep: str = "/", prefix: str = "") -> DataFrame:
    """(path, value, place) of every leaf below the root, with the names on the way joined; `place` (an array of the
    children's ordinals) sorts depth first. edges: parent, child, name, ord; leaves: node, value, ord."""
    start = edges.sparkSession.range(1).select(F.lit(root).alias("node"), F.array().cast("array<string>").alias("names"), F.array().cast("array<bigint>").alias("place"))
    steps = edges.select(F.col("parent").alias("top"), F.col("child").alias("bottom"), F.array("name").alias("names"), F.array(F.col("ord").cast("long")).alias("place"))
    found = reached(start, steps, ["names", "place"])
    path = F.aggregate("names", F.lit(prefix), lambda path, name: F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit(sep))), name))
    return leaves.join(found, "node").select(path.alias("path"), "value", F.concat("place", F.array(F.col("ord").cast("long"))).alias("place"))
