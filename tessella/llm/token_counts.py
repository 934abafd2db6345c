"""Operator 12. Token counts by distinct pre-tokens.

A byte-level tokenizer cuts a text into pre-tokens and each pre-token into pieces, whatever stands around it. So the pieces
of each distinct pre-token are counted once, and a text has the sum of its pre-tokens' frequencies times their pieces. No
ids are made for a text.

Tasks turn runs of documents into blocks: the block's distinct pre-tokens, and for each document the places of its
pre-tokens in that list with their frequencies. Blocks are written once. A pre-token has one row for each block that holds
it, however often it comes there; these rows meet, it is counted once, and the count goes back to its place in each block.
Then each block sums its documents.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.common import stored, table
from tessella.llm.packing import ALPHABET

#: How a byte-level tokenizer cuts a text (fixed value of the tokenizer library).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of a block hold about so many characters; a longer text is a block of its own.
BLOCK = 16_000_000


class PreTokens:
    """The pre-tokens of a text, and the pieces of a pre-token, as the tokenizer file has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        cut = kind["pre_tokenizer"] or {}
        added = kind["added_tokens"]
        if kind["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} has no plain byte-level pre-tokens")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError(f"{path} has added tokens that take their surroundings with them")
        self.special = regex.compile("(" + "|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"]))) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        # Two libraries may disagree about characters that are newer than Python's table; such texts are cut by the tokenizer.
        new = "".join(f"\\u{c:04x}" for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cn")
        self.maybe_new = re.compile(f"[{new}\U00010000-\U0010ffff]")
        self.added = {a["content"] for a in added}
        self.alphabet = dict(enumerate(ALPHABET))

    def plain(self, text: str) -> list[str]:
        if text.isascii() or all(unicodedata.category(c) != "Cn" for c in set(self.maybe_new.findall(text))):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def cut(self, text: str) -> list[str]:
        """Added tokens stand for themselves, the text around them is cut."""
        if self.special is None or self.special.search(text) is None:
            return self.plain(text)
        return [p for i, part in enumerate(self.special.split(text)) for p in ([part] if i % 2 else self.plain(part))]

    def pieces(self, words: list[str]) -> np.ndarray:
        """Pieces of each pre-token, whose bytes are written in the tokenizer's alphabet; an added token is one."""
        model = self.tokenizer.model
        return np.array([1 if w in self.added else len(model.tokenize(w.encode().decode("latin-1").translate(self.alphabet))) for w in words], np.int64)


_LOADED: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


class Block:
    """Documents whose pre-tokens share one list."""

    def __init__(self, cutter: PreTokens):
        self.cutter, self.chars = cutter, 0
        self.places: dict[str, int] = {}
        self.found: list[np.ndarray] = []
        self.rows: list[pa.Array] = []

    def add(self, text: str) -> None:
        count = Counter(self.cutter.cut(text))
        at = np.fromiter((self.places.setdefault(w, len(self.places)) for w in count), np.uint32, len(count))
        order = np.argsort(at)
        self.found.append(np.stack([np.diff(at[order], prepend=np.uint32(0)), np.fromiter(count.values(), np.uint32, len(count))[order]]))
        self.chars += len(text)

    def packed(self) -> bytes:
        """Numbers of pre-tokens of each document, then their places (as differences), then their frequencies: first the lowest
        bytes of all, then the next, as most are small."""
        sizes = np.array([f.shape[1] for f in self.found], np.uint32)
        numbers = np.concatenate([sizes, np.concatenate(self.found, axis=1).ravel()]).astype("<u4")
        return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def sums(packed: bytes, n: int, pieces: np.ndarray) -> np.ndarray:
    """Tokens of each of the n documents of a block."""
    numbers = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    sizes, (steps, times) = numbers[:n], numbers[n:].reshape(2, -1)
    ends = np.cumsum(sizes)
    # A document's places are the running sum of its steps.
    run = np.concatenate([[0], np.cumsum(steps)])
    places = run[1:] - np.repeat(run[ends - sizes], sizes)
    total = np.concatenate([[0], np.cumsum(pieces[places] * times)])
    return total[ends] - total[ends - sizes]


def token_counts(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """(carry, n_bytes, n_tokens, over_limit) of every row's whole text, as the tokenizer file at `path` counts without begin
    and end tokens.

    A null text is empty and has no tokens; equal rows and rows without an id are counted like any other; an empty table
    gives none. Other columns of docs don't matter, whatever their names. The pre-tokens of a text are held once in a task.
    """
    kept = T.StructType([docs.schema[c] for c in carry])
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.StructType([*kept, T.StructField("n_bytes", T.LongType())]))), T.StructField("packed", T.BinaryType())])
    out = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    kind_arrow, out_arrow = to_arrow_schema(kind), to_arrow_schema(out)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter, number = pre_tokens(path), TaskContext.get().partitionId() << 33

        def row(block: Block) -> pa.RecordBatch:
            rows = pa.concat_arrays(block.rows).cast(kind_arrow.field("rows").type.value_type)
            made = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([list(block.places)], pa.list_(pa.string())), made, pa.array([block.packed()], pa.binary())], schema=kind_arrow)

        block = Block(cutter)
        for batch in batches:
            rows = pa.StructArray.from_arrays([batch.column(i) for i in range(len(kept) + 1)], names=[*kept.names, "n_bytes"])
            begun = 0
            for i, text in enumerate(batch.column(len(kept) + 1)):
                text = text.as_py()
                if block.found and block.chars + len(text) > BLOCK:
                    block.rows.append(rows[begun:i])
                    yield row(block)
                    block, begun, number = Block(cutter), i, number + 1
                block.add(text)
            block.rows.append(rows[begun:])
        if block.found:
            yield row(block)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, known = pre_tokens(path), None, 0
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            new = words.dictionary.to_pylist()
            if new:
                # In order, so that only the first can be the last one of the batch before.
                n = cutter.pieces(new) if new[0] != last else np.concatenate([[known], cutter.pieces(new[1:])]).astype(np.int64)
                last, known = new[-1], int(n[-1])
                pieces = n[words.indices.to_numpy()]
                # One piece is what a block takes for granted.
                more = pa.array(pieces > 1)
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(more), batch.column(2).filter(more), pa.array(pieces.astype(np.int32)).filter(more)], ["block", "place", "pieces"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, rows, n, places, pieces in zip(*(batch.column(c) for c in ("packed", "rows", "n", "places", "pieces")), strict=True):
                more = np.ones(n.as_py(), np.int64)
                if places.is_valid:
                    more[places.values.to_numpy()] = pieces.values.to_numpy()
                rows = rows.values
                n_tokens = sums(packed.as_py(), len(rows), more)
                columns = [rows.field(c) for c in [*kept.names, "n_bytes"]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array(n_tokens), pa.array(n_tokens > limit)], out_arrow, strict=True)], schema=out_arrow)

    text = F.coalesce("text", F.lit(""))
    made = stored(docs.select(*carry, F.octet_length(text).cast("long").alias("_n_bytes"), text.alias("_text")).mapInArrow(blocks, kind))
    listed = made.select("block", F.posexplode("words").alias("place", "word")).select("word", "block", "place")
    pieces = listed.repartition("word").sortWithinPartitions("word").mapInArrow(counted, "block long, place int, pieces int")
    more = pieces.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("pieces").alias("pieces"))
    return made.select("block", F.size("words").alias("n"), "rows", "packed").join(more, "block", "left").select("packed", "rows", "n", "places", "pieces").mapInArrow(summed, out)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
