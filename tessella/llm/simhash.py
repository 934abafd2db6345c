"""Operator 6. SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints, so links within 3 bits lie within Manhattan distance 3. Six groups of
segments: a distance of at most 3 leaves at least three groups equal, so vectors that share a grid cell of three groups
(20 choices) are all the candidates there are. In a cell, a search from fingerprint to fingerprint verifies exactly and
gives a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import stored, table
from tessella.llm.components import connected_components

EVEN = 0x5555555555555555
#: First and last segment (two bits each) of the groups.
GROUPS = [(0, 6), (6, 11), (11, 16), (16, 22), (22, 27), (27, 32)]
SPAN = 1 << 15


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text: bit b is set if it is in over half the XXH64 hashes of its word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, SPAN):
        j = min(n, i + SPAN)
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist(), strict=True)], np.uint64, j - i)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) and columns to carry: fp is the fingerprint as a signed long."""
    names = ["doc_id", *(carry or [])]
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fp = np.fromiter((simhash(t) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.select(*names, "text").mapInArrow(run, f"{kinds}fp long")


def embedded(fp: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 segments, two bits each, packed in a word."""
    fp = fp.astype(np.uint64)
    return fp - ((fp >> np.uint64(1)) & np.uint64(EVEN))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the segments' differences. With counts in unary (0: 00, 1: 01, 2: 11) it is the number of differing bits."""
    unary = lambda v: (v & np.uint64(EVEN)) | (v >> np.uint64(1) & np.uint64(EVEN)) | (v & np.uint64(EVEN << 1))
    return np.bitwise_count(unary(x) ^ unary(y))


def forest(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all fingerprints of a cell which links within `distance` bits connect."""
    out, left, packed = [], fp[1:], embedded(fp)
    left_at, queue = packed[1:], [(fp[0], packed[0])]
    while len(left):
        if not queue:
            queue, left, left_at = [(left[0], left_at[0])], left[1:], left_at[1:]
            continue
        a, at = queue.pop()
        near = manhattan(at, left_at) <= distance
        near[near] = np.bitwise_count(a ^ left[near]) <= distance
        if near.any():
            hit = left[near]
            out.append((np.full(len(hit), a, np.uint64), hit))
            queue += zip(hit, left_at[near], strict=True)
            left, left_at = left[~near], left_at[~near]
    return out


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def links(fps: DataFrame, distance: int = 3, big: int = 4096) -> DataFrame:
    """Edges (a, b) between different fingerprints of `fps` (fp, each once) whose components are those of all links
    within `distance` (3 at most: more would need more groups).

    A cell of more than `big` fingerprints is dealt once more, by each quarter of the fingerprint: at most 3 differing bits
    leave one of four quarters equal, so no link is lost and no task searches a crowded cell as a whole.
    """
    if distance > 3:
        raise ValueError("six groups, and four quarters, serve distances up to 3")
    low, high = F.col("fp").bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    twos = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    masks = [sum(((1 << 2 * (hi - lo)) - 1) << 2 * lo for lo, hi in chosen) for chosen in combinations(GROUPS, 3)]
    cells = F.array(*[F.struct(F.lit(k).cast("byte").alias("grid"), F.col("_e").bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(masks)])
    keyed = fps.select("fp", twos.alias("_e")).select("fp", F.explode(cells).alias("c")).select("c.grid", "c.cell", "fp")
    crowded = stored(keyed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > big).select("grid", "cell"))
    quarter = F.lit(None).cast("long")
    if not crowded.isEmpty():
        keyed = keyed.join(crowded.withColumn("_big", F.lit(True)), ["grid", "cell"], "left")
        quarters = F.array(*[F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) + (k << 16) for k in range(4)])
        keyed = keyed.withColumn("quarter", F.explode(F.when(F.col("_big"), quarters).otherwise(F.array(quarter))))
    else:
        keyed = keyed.withColumn("quarter", quarter)
    keyed = keyed.select("grid", "cell", F.coalesce("quarter", F.lit(-1)).cast("int").alias("quarter"), "fp")
    keyed = keyed.repartition("grid", "cell", "quarter").sortWithinPartitions("grid", "cell", "quarter")

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        *key, fp = cols
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        first, last = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
        pairs = first[last - first == 2]
        a, b = fp[pairs], fp[pairs + 1]
        near = (manhattan(embedded(a), embedded(b)) <= distance) & (np.bitwise_count(a ^ b) <= distance)
        found = [(a[near], b[near])]
        for i, j in zip(*(x[last - first > 2].tolist() for x in (first, last)), strict=True):
            found += forest(fp[i:j], distance)
        made = [np.concatenate(x).view(np.int64) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of a run whose last cell may go on; joined once, when it ends
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[3] = cols[3].view(np.uint64)
            if last is not None and last == tuple(int(c[-1]) for c in cols[:3]):
                held.append(cols)
                continue
            last = tuple(int(c[-1]) for c in cols[:3])
            at = int(np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols[:3]]))[-1]) + 1 if any(c[0] != c[-1] for c in cols[:3]) else 0
            held.append([c[:at] for c in cols])
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(whole[3]):
                yield edges(whole)
            held = [[c[at:] for c in cols]]
        if held:
            yield edges([np.concatenate(x) for x in zip(*held, strict=True)])

    return keyed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs. Texts without words (null ones too) have fingerprint 0 and link like any
    other; a text is hashed whole, however long; repeated rows and equal fingerprints are compared once and are rows of
    one component each; component_id is the smallest doc_id of the component (null doc_ids don't count). With columns to
    carry, these follow (a name of the result can't be carried), and root, which tells components of the same smallest
    doc_id apart; other columns of docs are not read."""
    if clash := {"doc_id", "fp", "component_id", "root"} & set(carry or []):
        raise ValueError(f"these names are the result's: {sorted(clash)}")
    fps = stored(fingerprints(docs, carry))
    each = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(each.select("fp")))
    each = each.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    more = [*carry, "root"] if carry else []
    return fps.join(each.join(least, "root").select("fp", "component_id", *more[-1:]), "fp").select("doc_id", "fp", "component_id", *more)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
