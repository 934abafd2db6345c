"""Operator 5. Best-fit packing by a grouping genetic algorithm on islands.

Documents become token counts inside Arrow batches. Pieces are dealt by a hash into blocks of bounded size; every block
is evolved on several islands, whose elites migrate between epochs; the best packing of each block is kept. Islands start
from random orders. A crossover injects the whole well-filled bins of one parent, drops the other's bins that hold a
duplicate and those that are not well filled, and best-fits the displaced pieces. What the blocks leave is packed again.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import stored, table

#: How the tokenizer file splits a normalised text (fixed value from that file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with these go to the tokenizer as they are: its special tokens, and separators that it counts as no white space.
ODD = regex.compile(r"<\||[\x1c-\x1f]")
#: The byte-level alphabet by rule: a printable byte stands for itself, the others follow from U+0100 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
OTHERS = [b for b in range(256) if b not in PRINTED]
ALPHABET = [chr(b) if b in PRINTED else chr(256 + OTHERS.index(b)) for b in range(256)]


class TokenIds:
    """ids of a text, as little-endian uint32 bytes. White space is no token and never joins two, so a Latin-1 text's ids
    are those of its lower-case, space-separated units in order, and a unit's are those of its pieces. Both are remembered,
    up to `most` entries; any other text is encoded whole."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            mapped = piece if piece.isascii() and piece.isprintable() else "".join([ALPHABET[b] for b in piece.encode()])
            found = self.known[piece] = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return found

    def unit(self, unit: str) -> None:
        if unit.isalpha():
            self.piece(unit)
        elif unit[-1] in ".," and unit[:-1].isalpha():
            self.known[unit] = self.piece(unit[:-1]) + self.piece(unit[-1])
        else:
            self.known[unit] = b"".join([self.piece(p) for p in PIECES.findall(unit)])

    def of(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if ODD.search(text):
            return self.whole(text)
        units = text.lower().split()
        try:
            return b"".join(map(self.known.__getitem__, units))
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            for u in set(units).difference(self.known):
                self.unit(u)
            return b"".join(map(self.known.__getitem__, units))


#: What a worker process has learnt about each tokenizer file; it outlives the task.
_LEARNT: dict[str, TokenIds] = {}

#: Tasks that islands are dealt to at most; beyond it a task takes several.
MOST_TASKS = 50_000


def token_ids(path: str) -> TokenIds:
    if path not in _LEARNT:
        _LEARNT[path] = TokenIds(path)
    return _LEARNT[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of each row's ids, id 0 last. A null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = token_ids(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    b = ids.of(text or "") + bytes(4)
                    rows += [(doc, k, s // 4, len(c := b[s : s + 4 * capacity]) // 4, zlib.crc32(c)) for k, s in enumerate(range(0, len(b), 4 * capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("doc_id").type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, items: list[int], room: list[int], bins: np.ndarray, capacity: int) -> list[int]:
    """Put items (in the given order) each into the bin with the least sufficient room, or a new one. room: by bin."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in items:
        s = int(sizes[i])
        k = bisect_left(free, (s, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = r - s
        if r > s:
            insort(free, (r - s, b))
    return room


def fresh(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """A packing that takes the items in the given order."""
    bins = np.full(len(sizes), -1, np.int32)
    best_fit(sizes, order.tolist(), [], bins, capacity)
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(bins, sizes) / capacity
    return -len(fill), float((fill**2).mean())


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.3, full: float = 0.999) -> np.ndarray:
    """A child of two packings: a random share of b's well-filled bins goes in whole; a's bins that share an item with them
    go, and so do those of a that are not well filled; the items displaced are best-fitted, large ones first."""
    of_b, of_a = np.bincount(b, sizes), np.bincount(a, sizes)
    moved = ((of_b >= full * capacity) & (rng.random(len(of_b)) < share))[b]
    gone = of_a < full * capacity
    gone[a[moved]] = True
    stay = ~gone[a]
    child = np.full(len(sizes), -1, np.int32)
    n = 0
    for chosen, parent in ((stay, a), (moved, b)):
        if chosen.any():
            child[chosen] = np.unique(parent[chosen], return_inverse=True)[1] + n
            n = int(child.max()) + 1
    placed = child >= 0
    room = (capacity - np.bincount(child[placed], sizes[placed], n)).astype(int).tolist()
    out = np.flatnonzero(~placed)
    # Large ones first, in an order that differs a little from child to child.
    best_fit(sizes, out[np.argsort(-sizes[out] * rng.uniform(0.98, 1.02, len(out)), kind="stable")].tolist(), room, child, capacity)
    return child


#: How many times its generations an island may take to reach best-fit decreasing.
PATIENCE = 16


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int, children: int = 4, population: int = 6) -> tuple[np.ndarray, int]:
    """The best packing of an island after some generations, and how many crossovers it took. An island without elites
    starts from random orders; it stops at the lower bound on bins. Best-fit decreasing is the mark to reach: an island that
    is worse goes on, up to PATIENCE times as long, with that packing as one parent of its crossovers."""
    rng, least, crossed = np.random.default_rng(seed), -(-int(sizes.sum()) // capacity), 0
    key = lambda x: fitness(sizes, x, capacity)
    pool = list(elites)
    while len(pool) < 2 or (not elites and len(pool) < population):
        pool.append(fresh(sizes, rng.permutation(len(sizes)), capacity))
    pool.sort(key=key, reverse=True)
    mark = fresh(sizes, np.argsort(-sizes, kind="stable"), capacity)
    enough = -key(mark)[0]
    for g in range(PATIENCE * generations):
        bins = -key(pool[0])[0]
        if bins <= least or (g >= generations and bins <= enough):
            break
        for _ in range(children):
            i, j = rng.choice(len(pool), 2, replace=False)
            late = g >= generations
            pool.append(crossover(sizes, pool[i], mark if late else pool[j], capacity, rng, 0.95 if late else 0.3))
            crossed += 1
        pool = sorted(pool, key=key, reverse=True)[:population]
    return pool[0], crossed


def evolved_blocks(rows: DataFrame, capacity: int, block_items: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(block, uids, lengths, elite, bins, bound, crossovers) per block of rows (uid, length): elite is the bin of each item
    in the best packing of all islands, bound the least number of bins that the lengths allow."""
    n_blocks = max(1, -(-rows.count() // block_items))
    blocks = rows.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block"))
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    state = stored(blocks.select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")))
    elites = state.select("block", "lengths", F.array().cast("array<array<int>>").alias("elites"), F.lit(0).alias("crossovers"))
    fields = [("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("fill", pa.float64()), ("crossovers", pa.int32()), ("elite", pa.list_(pa.int32()))]

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes, seed = np.asarray(row["lengths"], np.int64), (row["block"] * islands + row["island"]) * epochs + number
                    best, crossed = evolve(sizes, [np.asarray(e, np.int32) for e in row["elites"]], capacity, seed, generations)
                    bins, fill = fitness(sizes, best, capacity)
                    made = {"block": row["block"], "island": row["island"], "bins": -bins, "fill": fill, "crossovers": crossed + row["crossovers"], "elite": best.tolist()}
                    yield pa.RecordBatch.from_pylist([made], schema=pa.schema(fields))

        return run

    for e in range(epochs):
        # As many tasks as islands: their rows are few and their work is not, so the tasks are not merged by size.
        dealt = elites.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).repartition(min(n_blocks * islands, MOST_TASKS), "block", "island")
        ran = dealt.mapInArrow(epoch(e), "block long, island int, bins int, fill double, crossovers int, elite array<int>")
        if e + 1 < epochs:  # migration: each island of a block starts the next epoch from the elites of all of them
            met = ran.groupBy("block").agg(F.collect_list("elite").alias("elites"), F.sum("crossovers").cast("int").alias("crossovers"))
            elites = stored(state.select("block", "lengths").join(met, "block").select("block", "lengths", "elites", F.col("crossovers")))
    best = ran.groupBy("block").agg(F.max_by("elite", F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("elite"), F.min("bins").alias("bins"), F.max("crossovers").alias("crossovers"))
    bound = F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) / capacity).alias("bound")
    return stored(state.join(best, "block").select("block", "uids", "lengths", "elite", "bins", bound, "crossovers"))


def placed_items(blocks: DataFrame, block_items: int, number: int) -> DataFrame:
    """(uid, length, block, seq, at) of the items of evolved_blocks(): the sequence of each, and where in it it begins.
    number: that of the round; sequences of different rounds have different numbers."""
    each = blocks.select("block", F.explode(F.arrays_zip("uids", "lengths", "elite")).alias("p"))
    each = each.groupBy("block", F.col("p.elite").alias("bin")).agg(F.sort_array(F.collect_list(F.struct(F.col("p.uids").alias("uid"), F.col("p.lengths").alias("length")))).alias("in_bin"))
    before = F.transform("in_bin", lambda x, i: F.struct(x["uid"].alias("uid"), x["length"].alias("length"), F.aggregate(F.slice("in_bin", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("at")))
    seq = (F.lit(number << 56) + F.col("block") * 2 * block_items + F.col("bin")).alias("seq")
    return each.select("block", seq, F.explode(before).alias("x")).select("x.uid", "x.length", "block", "seq", "x.at")


def pack(pieces: DataFrame, capacity: int, block_items: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 8) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with a `length` of 1 to capacity.

    A piece of full length is a sequence of its own. Blocks are dealt by a hash of the row, so no key can make one large.
    The least filled sequence of each block is a piece of a second round, and so on until one block is left: blocks leave
    one partly filled sequence in all where they reach their bounds. Order of rows with equal lengths is of no weight; an
    empty table gives an empty table; other columns pass through (those of the result are replaced).
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = stored(pieces.select(*names, F.monotonically_increasing_id().alias("_uid")))
    todo, found = rows.where(F.col("length") < capacity).select(F.col("_uid").alias("uid"), "length"), None
    for number in count():
        blocks = evolved_blocks(todo, capacity, block_items, islands, epochs, generations)
        here = placed_items(blocks, block_items, number)
        if found is None:
            found = here.select("uid", "seq", "at")
        else:  # what was a sequence of the round before is an item of this one: its items move along with it
            moved = here.select(F.col("uid").alias("_old"), F.col("seq").alias("_new"), F.col("at").alias("_by"))
            found = found.join(moved, F.col("seq") == F.col("_old"), "left").select("uid", F.coalesce("_new", "seq").alias("seq"), (F.col("at") + F.coalesce("_by", F.lit(0))).alias("at"))
        if blocks.limit(2).count() < 2:
            break
        fill = here.groupBy("block", "seq").agg(F.sum("length").alias("fill")).groupBy("block").agg(F.min_by(F.struct("seq", "fill"), F.struct("fill", "seq")).alias("x"))
        todo = stored(fill.select(F.col("x.seq").alias("uid"), F.col("x.fill").alias("length")))
        found = stored(found)
    placed = found.select(F.col("uid").alias("_uid"), F.col("seq").alias("_seq"), F.col("at").alias("_at"))
    out = rows.join(placed, "_uid", "left")
    return out.select(*names, F.coalesce("_seq", -1 - F.col("_uid")).alias("sequence_id"), F.coalesce("_at", F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty documents of
    the one id 0; repeated rows are packed once each; columns of docs other than doc_id and text are not read."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
