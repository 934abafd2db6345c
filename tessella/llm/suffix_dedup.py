"""Operator 8. Suffix-array dedup: every byte covered by a 200-byte string that starts anywhere else is removed.

Content-defined sampling with exact hash grouping stands in place of the suffix array: no suffix is ranked or ordered.
Positions are sampled by content - that with the least hash of 32 bytes in every stretch of 200 bytes, which equal
strings share by construction - and the tuple of 32 bytes fixes the group in which a stretch can have its like.
README.md says why a suffix array by difference cover is out of reach.

1. Every document lists its sampled positions; tuples that occur once are dropped in one pass sorted by tuple hash.
2. What is left is cut out with its surroundings and dealt by its tuple; a group's windows are grouped by a 64-bit hash.
3. Windows of equal hash are compared byte by byte over 200 bytes; matches become spans of their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import stored, table

#: Bytes of a sampled tuple.
TUPLE = 32
#: Multiplier of the rolling hash; any odd number serves.
MUL = 0x9E3779B97F4A7C15
#: Bytes whose windows a task compares at once, and bytes of a group beyond which it is dealt as single windows.
CHUNK, HOT = 1 << 20, 6 << 20
#: Bytes of bodies, and number of samples, among which a task looks for equal ones before they are dealt.
MEET, MEET_SAMPLES = 16 << 20, 1 << 19
#: Bytes that are hashed at a time.
SPAN = 1 << 17


class Hasher:
    """64-bit hashes of substrings of a byte array of at most SPAN + 4096 bytes; equal strings have equal hashes wherever
    they stand. One per task: its tables are made there and don't travel."""

    def __init__(self) -> None:
        up, down = np.full(SPAN + 4096, MUL, np.uint64), np.full(SPAN + 4096, pow(MUL, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)
        self.code = np.random.default_rng(8).integers(1, 1 << 63, 256).astype(np.uint64)

    def of(self, b: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[b] * self.up[: len(b)])])
        h = (sums[start + length] - sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def sampled(hasher: Hasher, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, first window, tuple hash): of every `window` bytes of b the tuple with the least hash, leftmost on a tie,
    is sampled. first[i] is the first window start that takes positions[i]; both increase. A long text goes span by span."""
    found = []
    for i in range(0, len(b) - window + 1, SPAN):
        at, first, h = sampled_span(hasher, b[i : i + SPAN + window - 1], window)
        if found and found[-1][0][-1] == at[0] + i:  # the span before has it already
            at, first, h = at[1:], first[1:], h[1:]
        if len(at):
            found.append((at + i, first + i, h))
    none = np.zeros(0, np.int64)
    at, first, h = map(np.concatenate, zip(*found, strict=True)) if found else (none, none, none.astype(np.uint64))
    return at, first, h


def sampled_span(hasher: Hasher, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = hasher.of(b, np.arange(len(b) - TUPLE + 1), TUPLE)
    m = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, size = window - TUPLE + 1, 1
    while size * 2 <= width:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, h[at[first]]


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def repeated_samples(docs: DataFrame, window: int) -> DataFrame:
    """(_k, sample, name): numbers of the sampled positions, by document key, whose tuple occurs twice or more. Rows with a
    name and nulls besides tell tuples that occur so often that their surroundings may hold more than HOT bytes.

    Rows of a tuple that meet in a task are known to be repeated; one of them, with their number, goes to the tuple's own
    partition (n above 1), the others (n = 0) anywhere, so a tuple costs its partition one row per MEET_SAMPLES samples.
    """
    most = HOT // (2 * window - TUPLE)

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def met() -> pa.RecordBatch:
            name, key, at = map(np.concatenate, zip(*held, strict=True))
            _, first, inverse, counts = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            n = (counts[inverse] == 1).astype(np.int64)
            n[first] = counts
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(key), pa.array(at), pa.array(n)], ["name", "_k", "sample", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                names = [sampled(hasher, np.frombuffer(as_bytes(t), np.uint8), window)[2] for t in part.column("text").to_pylist()]
                n = [len(x) for x in names]
                held.append((np.concatenate(names), np.repeat(part.column("_k").to_numpy(), n), np.concatenate([np.arange(x, dtype=np.int32) for x in n])))
                size += sum(n)
                if size > MEET_SAMPLES:
                    yield met()
                    held, size = [], 0
        if size:
            yield met()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, at: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.nulls(len(key), pa.int64())]
            more = [pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.int32()), pa.array(often, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(cols, more, strict=True)], ["_k", "sample", "name"])

        none = np.zeros(0, np.int64)
        name, key, at, n = last = [none] * 4  # of the batches before: the last row, with the number of its tuple so far
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            sent = cols[3] > 0
            yield found(cols[1][~sent], cols[2][~sent], none)
            name, key, at, n = (np.concatenate([x, y[sent]]) for x, y in zip(last, cols, strict=True))
            if not len(name):
                continue
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            total = np.add.reduceat(n, starts)
            keep = np.repeat(total > 1, np.diff(np.append(starts, len(name))))
            keep[-1] = False
            yield found(key[keep], at[keep], name[starts[:-1]][total[:-1] > most])
            last = [name[-1:], key[-1:], at[-1:], total[-1:]]
        name, key, at, n = last
        yield found(key[n > 1], at[n > 1], name[n > most])

    rows = docs.where(F.octet_length("text") >= window).select("_k", "text").mapInArrow(tuples, "name long, _k long, sample int, n long")
    place = F.when(F.col("n") > 0, F.col("name")).otherwise(F.xxhash64("_k", "sample"))
    return rows.repartition(place).sortWithinPartitions("name").mapInArrow(twice, "_k long, sample int, name long")


def surroundings(docs: DataFrame, samples: DataFrame, window: int) -> DataFrame:
    """(name, doc_id, _h, start, stop, known, body): for each sample, the bytes of all windows that take it, from stored
    rows of repeated_samples().

    Equal bodies that meet in a task are covered: each leaves as a span without a body, and one body goes to its tuple's
    group, known to be covered. Tuples that repeated_samples() tells to be frequent have no group: their bodies leave as
    windows, each a digest that stands for its own group, and windows that meet in a task are treated as bodies are.
    """
    lists = samples.where("_k is not null").groupBy("_k").agg(F.collect_set("sample").alias("samples"))
    often = np.array([r["name"] for r in samples.where("name is not null").select("name").collect()], np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["name", "doc_id", "_h", "start", "stop", "known", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held, names, starts, bodies, size = [], [], [], [], 0

        def out(rows: pa.RecordBatch, of: np.ndarray, name: np.ndarray, start: np.ndarray, length: np.ndarray, known: np.ndarray, body: pa.Array) -> pa.RecordBatch:
            took = rows.take(pa.array(of, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), took.column("doc_id"), took.column("_h"), pa.array(start, pa.int32()), pa.array(start + length, pa.int32()), pa.array(known), body], fields)

        def spans(rows: pa.RecordBatch, of: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
            return out(rows, of, np.zeros(len(of), np.int64), start, length, np.ones(len(of), bool), pa.nulls(len(of), pa.binary()))

        def met() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name, start, length = np.array(names, np.uint64).view(np.int64), np.array(starts, np.int64), np.array([len(x) for x in bodies])
            seen: dict[tuple[int, bytes], int] = {}
            first = np.array([seen.setdefault(x, i) for i, x in enumerate(zip(names, bodies, strict=True))])
            known = np.bincount(first, minlength=len(first))[first] > 1
            yield spans(rows, np.flatnonzero(known), start[known], length[known])
            one, hot = first == np.arange(len(first)), np.isin(name, often)
            of = np.flatnonzero(one & ~hot)
            yield out(rows, of, name[of], start[of], length[of], known[of], pa.array([bodies[i] for i in of], pa.binary()))
            of = np.flatnonzero(one & hot)
            cuts = np.flatnonzero(np.diff(np.cumsum(length[of]) // CHUNK)) + 1
            for part in np.split(of, cuts):
                yield from windows(rows, part, start, known) if len(part) else ()

        def windows(rows: pa.RecordBatch, of: np.ndarray, start: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = np.array([len(bodies[i]) - window + 1 for i in of])
            digests = [hashlib.blake2b(bodies[i][k : k + window], digest_size=24).digest() for i in of for k in range(len(bodies[i]) - window + 1)]
            seen: dict[bytes, int] = {}
            group = np.array([seen.setdefault(x, len(seen)) for x in digests])
            body = np.repeat(np.arange(len(of)), n)
            place = np.arange(len(body)) - np.repeat(np.cumsum(n) - n, n)
            covered = np.bincount(group) > 1
            covered[group[known[of][body]]] = True
            hit = covered[group] & ~known[of][body]  # bodies that are known have left as spans
            begins = hit & ~(np.append(False, hit[:-1]) & (place > 0))
            ends = hit & ~(np.append(hit[1:], False) & (np.append(place[1:], 0) > 0))
            a, z = np.flatnonzero(begins), np.flatnonzero(ends)
            yield spans(rows, of[body[a]], start[of[body[a]]] + place[a], place[z] - place[a] + window)
            _, lead = np.unique(group, return_index=True)
            sent = [digests[i] for i in lead]
            at = of[body[lead]]
            yield out(rows, at, np.frombuffer(b"".join(x[:8] for x in sent), np.int64), start[at] + place[lead], np.full(len(lead), window), covered[group[lead]], pa.array(sent, pa.binary()))

        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                of = []
                for r, (text, chosen) in enumerate(zip(part.column("text").to_pylist(), part.column("samples").to_pylist(), strict=True)):
                    b = as_bytes(text)
                    _, first, name = sampled(hasher, np.frombuffer(b, np.uint8), window)
                    ends = np.append(first[1:], len(b) - window + 1) - 1 + window
                    for s in sorted(c for c in chosen if c < len(first)):
                        of.append(r)
                        names.append(int(name[s]))
                        starts.append(int(first[s]))
                        bodies.append(b[first[s] : ends[s]])
                        size += len(bodies[-1])
                held.append(part.select(["doc_id", "_h"]).take(pa.array(of, pa.int64())))
                if size > MEET:
                    yield from met()
                    for x in (held, names, starts, bodies):
                        x.clear()
                    size = 0
        if bodies:
            yield from met()

    return docs.join(lists, "_k").select("doc_id", "_h", "text", "samples").mapInArrow(run, f"name long, doc_id {kind}, _h long, start int, stop int, known boolean, body binary")


def same_windows(hasher: Hasher, bodies: list[bytes], window: int) -> list[np.ndarray]:
    """For each body, which of its windows occur elsewhere in the bodies: windows are grouped by their hash, and
    those of equal hashes are compared byte by byte."""
    sizes = np.array([len(x) for x in bodies])
    b = np.frombuffer(b"".join(bodies), np.uint8)
    at = np.cumsum(sizes) - sizes
    n = sizes - window + 1
    starts = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    whole, hashes = np.append(at, len(b)), []
    i = 0
    while i < len(bodies):
        j = max(i + 1, int(np.searchsorted(whole, whole[i] + SPAN, "right")) - 1)
        inside = starts[(np.cumsum(n) - n)[i] : np.cumsum(n)[j - 1]] - whole[i]
        hashes.append(hasher.of(b[whole[i] : whole[j]], inside, window))
        i = j
    h = np.concatenate(hashes)
    order = np.argsort(h)
    pair = np.flatnonzero(h[order][1:] == h[order][:-1])
    hit = np.zeros(len(starts), bool)
    rows = np.lib.stride_tricks.sliding_window_view(b, window)
    for i in range(0, len(pair), 8192):
        p = pair[i : i + 8192]
        x, y = order[p], order[p + 1]
        ok = (rows[starts[x]] == rows[starts[y]]).all(axis=1)
        hit[x[ok]] = hit[y[ok]] = True
    return np.split(hit, np.cumsum(n)[:-1])


def matched_spans(bodies: DataFrame, window: int) -> DataFrame:
    """(doc_id, _h, start, stop) of bytes that are covered, from rows of surroundings().

    Rows without a body are spans already and go anywhere. The others arrive sorted by tuple and body. Equal bodies are covered and leave at once but for one, so no task holds all rows
    that share one; the different bodies of a tuple hold HOT bytes at most. A digest matches equal digests only.
    """
    kind = bodies.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "_h", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_type, hasher = None, Hasher()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], fields)

        def resolve(groups: list[list]) -> pa.RecordBatch:
            rows = []
            for (_, known, (doc, h, start, _)), hit in zip(groups, same_windows(hasher, [g[0] for g in groups], window), strict=True):
                if not known:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    rows += [(doc, h, start + int(a), start + int(z) - 1 + window) for a, z in zip(edge[::2], edge[1::2], strict=True)]
            return out(rows)

        done: list[list] = []  # [body, whether its span has left, span] of groups that are complete
        group: list[list] = []  # those of the group that rows still arrive for
        done_size = group_size = 0
        name, last = None, None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            bare = pc.is_null(batch.column("body"))
            yield batch.filter(bare).select(fields)
            rest, spans = batch.filter(pc.invert(bare)), []
            for key, doc, h, start, stop, known, body in zip(*(rest.column(i).to_pylist() for i in range(7)), strict=True):
                if key != name:
                    done += group
                    done_size += group_size
                    name, group, group_size, last = key, [], 0, None
                    if done_size > CHUNK:
                        yield resolve(done)
                        done, done_size = [], 0
                if last and last[0] == body:
                    spans += [(doc, h, start, stop)] * (not known) + [last[2]] * (not last[1])
                    last[1] = True
                    continue
                last = [body, known, (doc, h, start, stop)]
                if len(body) >= window:
                    group.append(last)
                    group_size += len(body)
            yield out(spans)
        done += group
        if done:
            yield resolve(done)

    place = F.when(F.col("body").isNull(), F.xxhash64("doc_id", "_h", "start")).otherwise(F.col("name"))
    return bodies.repartition(place).sortWithinPartitions("name", "body").mapInArrow(run, f"doc_id {kind}, _h long, start int, stop int")


def remove_repeats(docs: DataFrame, window: int = 200, with_text: bool = True) -> DataFrame:
    """Columns of docs plus n_bytes, n_removed, n_spans, kept_sha256, and kept: the remaining text, if it is asked for,
    where a character that was cut in two is gone (the hash is that of the remaining bytes).

    A null text is empty; a text of fewer bytes than `window` is kept whole; two equal rows count as two documents, so both
    lose all their text. Matches do not cross rows and are judged on the input. Other columns pass through; columns of the
    result replace those of the same name, and names with a leading underscore are reserved.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    keyed = docs.withColumns({"_h": F.xxhash64("text"), "_k": F.xxhash64("doc_id", "text")})
    few = keyed.select("doc_id", "_h", "_k", "text")
    spans = matched_spans(surroundings(few, stored(repeated_samples(few, window)), window), window)
    spans = spans.groupBy(F.col("doc_id").alias("_d2"), F.col("_h").alias("_h2")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left").select(*names, "_spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def cut_out(text: str | None, spans: list[dict] | None) -> tuple[int, int, int, str, str | None]:
        b, parts, end, removed, runs = as_bytes(text), [], 0, 0, 0
        for s in spans or []:
            start, stop = s["start"], s["stop"]
            if start > end or runs == 0:
                parts.append(b[end:start])
                runs += 1
            removed += max(0, stop - max(start, end))
            end = max(end, stop)
        parts.append(b[end:])
        kept = b"".join(parts)
        return len(b), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = [cut_out(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist(), strict=True)]
                cols = list(zip(*rows, strict=True))
                made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *made], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
