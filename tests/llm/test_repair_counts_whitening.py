"""Conversation repair, token counts and whitening against brute force, and their edges."""

import hashlib
import re
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from compare import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import conversation_repair, queries, token_counts, whitening

WORD_END = re.compile(r"[^\x20\x09-\x0D]")
EMPTY = hashlib.sha256(b"").hexdigest()


# Conversation repair


def edits_of(lines):
    """(cost, audit, repaired lines) by trying every edit of every row, the best of each state kept with its whole audit."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", [])}

    def put(to, q, value):
        if q not in to or value[:2] < to[q][:2]:
            to[q] = value

    def with_inserts(best):
        for _ in range(4):
            for q, (cost, audit, out) in list(best.items()):
                role = wanted[q]
                put(best, role[0], (cost + 3, audit + "I", [*out, f"{role}:"]))
        return best

    for role, text, fault in lines:
        after = {}
        for q, (cost, audit, out) in with_inserts(best).items():
            put(after, q, (cost + 4, audit + "D", out))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if role[:1] in step[q]:
                    put(after, step[q][role[:1]], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
                put(after, wanted[q][0], (cost + 3 + more, audit + "R", [*out, f"{wanted[q]}:{text}"]))
        best = after
    return min(v for q, v in with_inserts(best).items() if q in ("", "a"))


def expected(rows):
    """The query's row for each conversation, worked out row by row."""
    out = {}
    key = lambda r: (r[0] is not None, r[0])
    for conv, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        lines = []
        for _, turn, role, text in group:
            shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
            case = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
            role, text = "user" if case == 4 else shown[2], "" if case == 1 else re.sub("[.!?]", "", shown[3]) if case == 2 else shown[3]
            lines += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], hashlib.sha256(x[2].encode()).digest()))
        turns, seen, marked = [t for t, _, _ in lines if t is not None], set(), []
        for _, role, text in lines:
            shown = WORD_END.findall(text)
            marked.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, repaired = edits_of(marked)
        faults = [f for _, _, f in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_query(df):
    each, rows = conversation_repair.repair_conversations(conversation_repair.damaged(df))
    out = conversation_repair.beside(each, ["conv_id"], conversation_repair.digests(rows)).fillna({"repaired_sha256": EMPTY})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_op11_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.queries()["op11_conversation_repair"](spark, folder).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == expected(rows)


ODD = [
    (1, 0, "system", "Be brief."),
    (1, None, None, None),
    (1, None, "user", "One?"),
    (1, 1, "user", "One?"),
    (1, 3, "tool", "No full stop"),
    (1, 3, "tool", "No full stop"),
    (1, 9, "", "No role."),
    (None, None, "assistant", " \t\x0b"),
    (None, 4, "assistant", "x" * 200000),
    (2, -5, "user", "é\n!  \n"),
    (2, 7, "assistant", " "),
    (3, None, None, None),
]


def test_op11_edges(spark):
    schema = "conv_id long, turn long, role string, text string, part string, kind int"
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], schema)
    assert repair_query(df) == expected(ODD)
    assert repair_query(spark.createDataFrame([], schema)) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repair_query(spark.createDataFrame([(dropped, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")) == {dropped: (0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_a_long_conversation_runs_through_several_parts(spark):
    random = np.random.default_rng(3)
    texts = ["Yes.", "No", "", "Why?", *[f"Text {i}{'.' if i % 3 else ''}" for i in range(40)]]
    rows = [(7, int(random.integers(0, 300)), str(random.choice(["user", "assistant", "system", "tool"])), str(random.choice(texts))) for _ in range(600)]
    rows += [(8, 1, "user", "The same.")] * 300 + [(9, i, "user" if i % 2 else "assistant", "Well.") for i in range(3)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        lines = conversation_repair.ordered(conversation_repair.damaged(df))
        parts = {r["conv_id"]: r["n"] for r in lines.selectExpr("conv_id", "part").distinct().groupBy("conv_id").count().withColumnRenamed("count", "n").collect()}
        assert parts[7] > 1 and parts[8] > 1
        assert repair_query(df) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("-bdt")), max_size=9), st.lists(st.integers(0, 9), max_size=3))
def test_parts_join_to_the_lightest_derivation(codes, cuts):
    roles, faults = {"s": "system", "u": "user", "a": "assistant", "x": "x"}, {"-": "", "b": "blank", "d": "duplicate", "t": "truncated"}
    cost, audit, _ = edits_of([(roles[k], "", faults[f]) for k, f in codes])
    codes, at = [k + f for k, f in codes], sorted({0, len(codes), *[c for c in cuts if c < len(codes)]})
    pieces = [codes[a:b] for a, b in zip(at, at[1:])]
    made = []
    for piece in pieces:
        found = conversation_repair.between(piece)
        ranks = [0] * 16
        for q in range(4):
            for r, (_, end) in enumerate(sorted((x[1], end) for end, x in enumerate(found[q]) if x)):
                ranks[4 * q + end] = r
        made.append(([x[0] if x else -1 for row in found for x in row], ranks, found))
    total, states = conversation_repair.through([m[:2] for m in made])
    text = "".join(m[2][a][b][1] for m, a, b in zip(made, states, states[1:])) + conversation_repair.CLOSING[states[-1]][1]
    assert (total, text) == (cost, audit)


# Token counts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def n_tokens(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_op12_is_what_the_library_counts(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.queries()["op12_token_counts"](spark, SMALL).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {i: (len((t or "").encode()), n := n_tokens(tokenizer, t), n > 1024) for i, t in texts.items()}


def test_op12_edges(spark, tokenizer, monkeypatch):
    texts = [None, "", " ", "\n\n\n", "a  b   c\t\n d", "it's we'll 'S ''s", " <|endoftext|><|endoftext|>  x<|endoftext", "՘a֋ \U000323b0 new", "\U0001f642\U0001f642 ok  　x", "word " * 50000, "é \u0000 ①½ ٣٤"]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_tokens int")
    for size in (10, 8_000_000):
        monkeypatch.setattr(token_counts, "BLOCK", size)
        got = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
        want = [(i, len((t or "").encode()), n_tokens(tokenizer, t)) for i, t, _, _ in rows]
        assert sorted((r[0] or 0, *r[1:3]) for r in got) == sorted((i or 0, b, n) for i, b, n in want)
    assert token_counts.token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from(" \n\t'sStrl19a.é<|endoftx>"), max_size=60))
def test_pre_tokens_have_the_pieces_of_the_text(tokenizer, text):
    cutter = token_counts.pre_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert int(cutter.pieces(cutter.cut(text)).sum()) == n_tokens(tokenizer, text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PreTokens(public_tokenizers.path("word_bpe_49k.json"))


# Whitening


def whole(vectors):
    return np.floor(256 * np.asarray(vectors, float)).astype(np.int64)


def check_whitened(rows, ids, x, k=4):
    """rows of the operator for whole vectors x of ids, against an eigendecomposition of the covariance."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    k = int(np.sum(values > 1e-9 * values[0]))
    assert len(rows) == len(ids) * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(k):
        mine = [got[i, c + 1] for i in ids]
        z = (x - s / n) @ vectors[:, c] / np.sqrt(values[c])
        found = np.array([r["whitened"] for r in mine])
        gap = min([abs(values[c] - v) for j, v in enumerate(values) if j != c] + [values[c]]) / values[0]
        if gap > 1e-6:
            assert min(np.abs(found - z).max(), np.abs(found + z).max()) < 1e-8
        assert np.allclose([r["explained"] for r in mine], values[c] * n / (centred**2).sum(), rtol=1e-9)
        assert [r["deviation"] for r in mine] == [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))) for v in x]
        assert {r["n"] for r in mine} == {n} and len({r["identity_error"] for r in mine}) == 1 and max(r["identity_error"] for r in mine) < 1e-9


def test_op13_against_an_eigendecomposition(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = queries.queries()["op13_embedding_whitening"](spark, SMALL).collect()
    check_whitened(rows, [r["vec_id"] for r in table], whole([r["embedding"] for r in table]))


@pytest.mark.parametrize("kind", ["gap", "copies", "rank", "narrow"])
def test_op13_spectra(spark, kind):
    random = np.random.default_rng(5)
    x = {
        "gap": random.standard_normal((80, 40)) * 2.0 ** -np.arange(40),
        "copies": np.concatenate([np.eye(12) * v for v in (3, -3, 1, -1)]) * np.array([1, 1, 1, 1, 1, 1, 0.25, 0.25, 0.25, 0.1, 0.1, 0.1]),
        "rank": np.outer(random.standard_normal(50), np.ones(20)) + np.outer(random.standard_normal(50), np.arange(20)),
        "narrow": random.standard_normal((30, 2)),
    }[kind]
    if kind == "rank":
        x = np.round(x) * 1.0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    check_whitened(whitening.whitened(df).collect(), list(range(len(x))), whole(x))


def test_op13_edges(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (None, [0.1, 0.2, 0.3]), (2, [1.0, 0.0]), (3, [])]
    rows = [*fine, (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 2.0]), (7, [1.0, inf, 2.0]), (8, [1.0, -inf, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string")
    got = whitening.whitened(df).collect()
    x = whole([[*np.float32(v).tolist(), 0.0, 0.0, 0.0][:3] for _, v in fine])
    assert len(got) == 3 * len(fine) and {r["vec_id"] for r in got} == {1, 2, 3, None}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, int(((4 * v - np.unique(x, axis=0).sum(axis=0)) ** 2).sum())) for (i, _), v in zip(fine, x)}
    schema = "vec_id long, embedding array<float>"
    for few in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(few, schema)).collect() == []
