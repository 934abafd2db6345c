"""Nulls, empty and odd texts, ties, repeated rows, empty tables and clashing columns."""

import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import common, decontamination, html_blocks, html_extraction, packing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, text_stats, tool_calls, toxicity
from tessella.llm.components import connected_components

SCHEMA = "doc_id long, text string, n_words string, _h string"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ROWS = [(1, None, "x", None), (2, "", "x", "y"), (3, "One two", "x", "y"), (4, LONG, None, None), (5, "tie words here and there " * 20, "x", "y"), (5, "tie words here and there " * 20, "x", "y"), (None, "no id at all", "x", "y"), (6, "é\u0000\U0001f642 <|endoftext|>\n\n\t.", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 7)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")


def test_sharding(spark, odd, empty):
    out = sharding.hilbert_shards(odd, ["n_words", "doc_id", "_h"], ["doc_id", "text"], 3, bits=2, rows_per_run=2).collect()
    assert sorted(r["shard"] for r in out) == [0, 0, 0, 1, 1, 1, 2, 2]
    assert sharding.hilbert_shards(empty, ["n_words", "doc_id"], ["doc_id"], 8).count() == 0


def test_texts_are_cut_by_their_whole_length(spark):
    df = spark.createDataFrame([(f"https://an.example.org/a/long/shared/beginning/site{i % 5}.org", i) for i in range(500)] + [(None, 1)], "source string, k int")
    rows = sharding.quantised(df, ["source"], 3)[0].select("source", "_q0").distinct().collect()
    assert len(rows) == 6 and len({r["_q0"] for r in rows if r["source"]}) == 5
    assert [r["source"] for r in sorted(rows, key=lambda r: r["_q0"]) if r["source"]] == sorted(r["source"] for r in rows if r["source"])


def test_hilbert_curve_visits_neighbours(spark):
    side = range(8)
    df = spark.createDataFrame([(a, b, c) for a in side for b in side for c in side], "a int, b int, c int")
    rows = sorted(sharding.with_hilbert_index(df, ["a", "b", "c"], 3, "h").collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[:3], q[:3])) == 1 for p, q in zip(rows, rows[1:]))


def test_stats_and_rules(odd, empty):
    got = {(r["doc_id"], r["n_words"]) for r in text_stats.with_text_stats(odd.select("doc_id", "text")).collect()}
    assert {(1, 0), (2, 0), (3, 2), (4, 18000), (6, 3)} <= got
    rows = quality_rules.rule_verdicts(odd, carry=odd.columns).collect()
    assert len(rows) == len(ROWS) and {tuple(r["row"]) for r in rows} == set(ROWS)
    assert not any(r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_rules.rule_verdicts(empty).count() == 0


def test_em_ignores_rules_that_never_vote_and_finds_the_rare_class():
    odds, add = quality_rules.fit_votes([((1, 1, 1, 0), 900), ((1, -1, -1, 0), 60), ((1, -1, 0, 0), 40)])
    assert abs(add[3][1]) + abs(add[3][-1]) < abs(add[2][-1])
    assert odds + add[0][1] + add[1][1] + add[2][1] > 0 > odds + add[0][1] + add[1][-1] + add[2][-1]
    assert quality_rules.fit_votes([])[1] == []


def test_em_learns_which_rules_to_trust():
    """Rules 0 and 1 agree on who is bad; rule 2 votes bad at random, on a third of both. Belief alone would believe it."""
    patterns = [((1, 1, 1, 1), 560), ((1, 1, -1, 1), 290), ((-1, -1, 1, 1), 100), ((-1, -1, -1, 1), 50)]
    verdict = lambda odds, add, votes: odds + sum(a[v] for a, v in zip(add, votes))
    learnt, believed = quality_rules.fit_votes(patterns), quality_rules.fit_votes(patterns, rounds=0)
    assert verdict(*learnt, (1, 1, -1, 1)) > 2 and verdict(*learnt, (-1, -1, 1, 1)) < -2
    assert abs(learnt[1][2][-1]) < 0.2 < abs(believed[1][2][-1])
    assert verdict(*learnt, (1, 1, -1, 1)) > verdict(*believed, (1, 1, -1, 1))


def test_posterior_is_that_of_the_fitted_votes(spark):
    df = spark.createDataFrame([(i, (i % 7 > 1) * 2 - 1, (i % 7 > 2) * 2 - 1, None if i % 2 else 1) for i in range(70)], "k int, a int, b int, c int")
    rows = quality_rules.judge_quality(df, {x: F.col(x) for x in "abc"}).collect()
    counted = {}
    for r in rows:
        v = (r["a"], r["b"], r["c"] or 0)
        counted[v] = counted.get(v, 0) + 1
    odds, add = quality_rules.fit_votes(sorted(counted.items()))
    for r in rows:
        z = odds + sum(w[v] for w, v in zip(add, (r["a"], r["b"], r["c"] or 0)))
        assert abs(r["quality_probability"] - 1 / (1 + np.exp(-z))) < 1e-9


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers(odd, empty, labels, module, label):
    rows = module.score(odd, module.train(odd, labels, label, 5, 0)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    none = module.train(odd, labels.where("doc_id > 100"), label, 5, 0)
    assert {r["score"] for r in module.score(odd, none).collect()} == {0.5}
    assert module.score(empty, none).count() == 0


def test_long_texts_have_the_same_grams_in_spans(monkeypatch):
    texts = ["abcabcabd" * 30, None, "", "xyz", "ab", "é" * 40]
    whole = [toxicity.gram_counts(t) for t in texts]
    assert whole[0][1].sum() == sum(270 - n + 1 for n in toxicity.NGRAMS) and len(whole[3][0]) == 1 and not len(whole[4][0])
    monkeypatch.setattr(toxicity, "SPAN", 17)
    for (a, n), (b, m) in zip(whole, map(toxicity.gram_counts, texts)):
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_scores_are_the_linear_form_of_scaled_counts(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, ("you utter fool " if i % 3 == 0 else "a pleasant walk ") * 3 + f"number {i}") for i in range(40)], "doc_id long, text string")
    model = toxicity.train(docs, labels, "toxic", 5, 0)
    for r in toxicity.score(odd, model).join(odd.select("doc_id", "text"), "doc_id").collect():
        counts = {}
        low = (r["text"] or "").lower()
        for n in toxicity.NGRAMS:
            for i in range(len(low) - n + 1):
                b = int(toxicity.gram_counts(low[i : i + n])[0][-1]) if n == 3 else int(toxicity.buckets(np.array([ord(c) for c in low[i : i + n]], np.uint32))[-1])
                counts[b] = counts.get(b, 0) + 1
        v = {b: float(model["ratio"][b]) * k for b, k in counts.items() if model["ratio"][b] != 0}
        z = model["intercept"] + sum(float(model["weight"][b]) * x for b, x in v.items()) / max(1e-12, sum(x * x for x in v.values()) ** 0.5)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6
    assert (model["ratio"] != 0).sum() > 100


def test_training_rows_of_a_repeated_doc_id_are_defined(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = {tuple(sorted((r["doc_id"], r["text"], r["label"]) for r in common.labelled_sample(docs.repartition(n), labels, "toxic", 1000003, 0, 10).collect())) for n in (1, 3)}
    assert len(got) == 1 and {r[0] for r in got.pop()} == {1, 3}


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    rules, b = quality_classifier.fit_rules(x, y, ["p", "q"])
    by_hand = 1 / (1 + np.exp(-(b + sum(w * quality_classifier.covers(r, x, ["p", "q"]) for r, w in rules))))
    df = spark.createDataFrame(x.tolist(), "p double, q double").withColumn("s", quality_classifier.compiled(rules, b))
    assert np.allclose([r["s"] for r in df.collect()], by_hand)
    assert ((by_hand > 0.5) == (y == 1)).mean() > 0.97


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "TIE words here and there tie words here and there tie!"), (2, "one, two"), (3, None), (4, "???"), (5, "not in the corpus")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.contamination(odd.drop("n_words"), items).collect()}
    assert (5, 100, 1, True) in rows and (3, 2, 1, True) in rows and (1, 0, 0, False) in rows
    assert decontamination.contamination(empty.drop("n_words"), items).count() == 0
    twice = decontamination.contamination(odd.drop("n_words"), items).where("doc_id = 5").collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["hits"][0] == (0, 10)
    assert not decontamination.contamination(odd.drop("n_words"), items.limit(0)).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b y a"), (2, "b a"), (3, "a x x x x x b")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    index = decontamination.positional_index(decontamination.tokens_of(docs), terms)
    pairs = spark.createDataFrame([("a", "b")], "term_a string, term_b string")
    got = sorted((r["doc_id"], r["place_a"], r["place_b"]) for r in decontamination.near_matches(index, pairs, 3).collect())
    assert got == [(1, 0, 3), (1, 5, 3), (2, 1, 0)]


def test_packing(spark, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path, capacity=64).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 64
    assert packing.pack_documents(empty, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_unit_tokens_are_the_tokenizers_own(text):
    import public_tokenizers

    ids = packing.token_ids(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.of(text) == ids.whole(text)


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 300)
    a, b = (packing.fresh(sizes, rng.permutation(300), 100) for _ in range(2))
    child = packing.crossover(sizes, a, b, 100, rng)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= 100
    best, crossed = packing.evolve(sizes, [a, b], 100, 3, 10)
    assert crossed and best.max() < min(a.max(), b.max())


def test_the_genetic_algorithm_packs(spark, monkeypatch):
    sizes = np.random.default_rng(1).integers(600, 1100, 2500)
    down = packing.fresh(sizes, np.argsort(-sizes, kind="stable"), 2048).max() + 1
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "doc_id long, length long").withColumn("offset", F.lit("old"))

    def packed():
        rows = packing.pack(df, 2048, block_items=1000).collect()
        places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
        assert len(rows) == 2500 and all(o == (p + n if q == s else 0) for (q, p, n), (s, o, _) in zip([(None, 0, 0), *places], places))
        assert all(o + n <= 2048 for _, o, n in places)
        return len({s for s, _, _ in places})

    assert packed() < down
    blocks = packing.evolved_blocks(df.select(F.col("doc_id").alias("uid"), "length"), 2048, 1000, 2, 2, 4).collect()
    assert len(blocks) == 3 and all(r["crossovers"] >= 16 and r["bins"] >= r["bound"] for r in blocks)
    monkeypatch.setattr(packing, "crossover", lambda sizes, a, b, *_: a)
    assert packed() > down


def test_simhash(odd, empty):
    rows = {(r["doc_id"], r["component_id"], r["fp"] == 0) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 1, True), (5, 5, False), (None, None, False)} <= rows
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(odd, carry=["n_words"]).columns == ["doc_id", "fp", "component_id", "n_words", "root"]
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd.withColumnRenamed("n_words", "root"), carry=["root"])


def test_near_dedup_keeps_one_text_of_each_component(spark):
    import corpus_pipeline

    one, other = "one text about rivers and the mills that stand along them " * 4, "quite different words on ships, harbours and their cranes " * 4
    docs = spark.createDataFrame([(1, one), (1, other), (2, one), (3, other), (1, one), (None, one)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([(0, one), (1, one), (1, other)])


@pytest.mark.parametrize("big", [4096, 3])
def test_links_connect_all_that_3_bits_connect(spark, big):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        at = int(s)
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["v"]: r["root"] for r in connected_components(simhash.links(df, big=big)).collect()}
    group = lambda key: sorted(sorted(f for f in fps if key(f) == k) for k in {key(f) for f in fps})
    assert group(find) == group(lambda f: got.get(signed(f), signed(f)))


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    segments = lambda v: [(int(v) >> 2 * i & 3).bit_count() for i in range(32)]
    for x, y in zip(a, b, strict=True):
        d = sum(abs(p - q) for p, q in zip(segments(x), segments(y), strict=True))
        assert simhash.manhattan(simhash.embedded(np.array([x])), simhash.embedded(np.array([y])))[0] == d <= (int(x) ^ int(y)).bit_count()


def brute_removed(docs, window):
    seen, cover = {}, [np.zeros(len((t or "").encode()), bool) for _, t in docs]
    for k, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                e, j = seen[w]
                cover[e][j : j + window] = cover[k][i : i + window] = True
            else:
                seen[w] = (k, i)
    return sorted((d or -1, int(m.sum())) for (d, _), m in zip(docs, cover, strict=True))


@pytest.mark.parametrize("hot, span", [(6 << 20, 1 << 19), (2000, 1 << 19), (6 << 20, 300)])
def test_repeats(spark, monkeypatch, hot, span):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SPAN", span)
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefgh é"), 3000))
    docs = [(i, base[rng.integers(0, 1500) :][: rng.integers(150, 1400)] + "".join(rng.choice(list("xyz"), rng.integers(0, 80))) + base[700 : 700 + rng.integers(0, 500)]) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "a" * 900), (103, base * 2), (None, base[:400]), (104, "twice " * 50), (104, "twice " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == brute_removed(docs, 200)
    assert all(len(r["kept"].encode()) <= r["n_bytes"] - r["n_removed"] for r in got)


def test_no_task_gets_all_rows_of_a_passage(spark, monkeypatch):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    page, line = noise(400), noise(210)
    docs = [(i, page if i % 3 == 0 else noise(90) + line + noise(90) if i % 3 == 1 else noise(300)) for i in range(900)]
    monkeypatch.setattr(suffix_dedup, "HOT", 20000)
    few = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"_h": F.xxhash64("text"), "_k": F.xxhash64("doc_id", "text")})
    bodies = suffix_dedup.surroundings(few, suffix_dedup.stored(suffix_dedup.repeated_samples(few, 200)), 200)
    assert bodies.where("body is not null").groupBy("name").count().agg(F.max("count")).first()[0] <= 3
    got = suffix_dedup.remove_repeats(few.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == brute_removed(docs, 200)


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "x", "old", "s"), (2, None, "old", None)], "doc_id long, text string, n_bytes string, shard string")
    assert {r["n_bytes"] for r in suffix_dedup.remove_repeats(df).collect()} == {0, 1}
    assert {r["shard"] for r in sharding.hilbert_shards(df, ["shard"], ["doc_id"], 2).collect()} == {0, 1}
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert {r["n_words"] for r in decontamination.contamination(df.withColumnRenamed("shard", "n_words"), items).collect()} == {0, 1}


def test_repeats_of_an_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_pages(spark):
    blocks = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert blocks("<p>a &amp; b<br>c<p>d<script>x</script><div>e<b>f</b>\n g") == ["a & b c", "d", "ef g"]
    assert blocks("<ul><li>a<li>b</ul>text</p>more<") == ["a", "b", "text", "more<"]
    assert blocks(None) == blocks("") == blocks("<!-- c -->") == []
    page = "<html><body><div class='menu'><a href='/'>home</a></div><article><h1>T</h1><p>Long enough text of the article, here.</p></article><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page) for i in range(5)] + [(6, None, None), (7, "u", ""), (None, "u", "plain")], "page_id long, url string, html string")
    model = html_extraction.train(pages)
    rows = {r["page_id"]: r["text"] for r in html_extraction.extract(pages, model).collect()}
    assert rows[0] == "T\n\nLong enough text of the article, here." and rows[6] == rows[7] == ""
    assert html_extraction.extract(pages.limit(0), html_extraction.train(pages.limit(0))).count() == 0


def test_hidden_elements_do_not_break_a_block():
    blocks = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert blocks("<p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x</annotation></math> holds, as <svg><text>no</text></svg>all know.") == ["Here x=1 holds, as all know."]
    assert blocks("<p>a <script>if (1) {}</script>b <button><div>x</div></button>c</p>") == ["a b c"]


PART = "<p>The council met on Monday to discuss the plan, and most members spoke for it.</p>"
REST = "<p>Work is to begin in March. The cost is not yet known, but it will be high.</p>"
TEXT = [re.sub("<.*?>", "", x) for x in (PART, REST)]
#: Layouts that training doesn't hold, without <article> or <main> or with comments inside: (page, blocks of its main text).
LAYOUTS = [
    (f"<html><body><div class='top menu'><a href='/'>Start</a> <a href='/n'>News</a></div><div class='c1'><h1>Plan agreed</h1>{PART}{REST}<ul><li>First, the road is closed.</li><li>Then the bridge is built.</li></ul></div><div class='bottom footer'><p>Copyright 2024 by the paper.</p></div></body></html>", ["Plan agreed", *TEXT, "First, the road is closed.", "Then the bridge is built."]),
    (f"<html><body><article><h1>Plan agreed</h1>{PART}{REST}<section class='comments'><h2>Comments</h2><p>I think this is a bad idea, and so does my neighbour.</p><p>Well, I like it.</p></section></article></body></html>", ["Plan agreed", *TEXT]),
    (f"<html><body><table><tr><td class='nav'><a href=1>One</a><br><a href=2>Two</a></td><td><h2>Plan agreed</h2>{PART}{REST}{PART}</td><td class='sidebar'><p>Read also our other stories, they are good.</p></td></tr></table></body></html>", ["Plan agreed", *TEXT, TEXT[0]]),
    (f"<html><body><div class='cookie-banner'><p>We use cookies to make this site better, please accept them.</p><button>OK</button></div><div id='content'>{PART}{REST}{PART}</div><form><p>Sign up for our letter.</p><input></form></body></html>", [*TEXT, TEXT[0]]),
    (f"<html><body><nav><a href='/'>Home</a></nav>{PART}<footer>Foot</footer></body></html>", TEXT[:1]),
    ("<html><body><nav><a href='/'>Home</a></nav><div>" + PART * 500 + "</div><footer>Foot</footer></body></html>", TEXT[:1] * 500),
]


def test_layouts_that_training_does_not_hold(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(i, page, "x") for i, (page, _) in enumerate(LAYOUTS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("url", F.lit("u"))
    got = html_extraction.extract(pages, html_extraction.train(table)).collect()
    assert len(got) == 2 * len(LAYOUTS)
    for r in got:
        assert r["text"].split("\n\n") == LAYOUTS[r["page_id"]][1]


def test_article_tags_are_no_features():
    block = lambda t: html_blocks.leaf_blocks(f"<{t}><p>some words here</p></{t}>")[0]
    assert html_extraction.block_features(block("article"), 1, 3) == html_extraction.block_features(block("main"), 1, 3) == html_extraction.block_features(block("div"), 1, 3)


def test_pages_without_end_tags_keep_their_text():
    blocks = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert blocks("<html><head><title>t</title><meta charset=utf-8><body><p>a</html>") == ["a"]
    assert blocks("<head><title>t</title><p>a<p>b") == ["a", "b"] and blocks("<head><title>t</title>a") == ["a"]
    assert blocks("<head><title>t</title></head><body>a") == ["a"]
    for tag in ("button", "select", "object", "video", "noscript", "template"):
        assert blocks(f"<body><div><{tag}>x<section><p>a</p></section></div><p>b") == ["a", "b"], tag
        assert blocks(f"<body><div><{tag}><section><p>x</p></section></{tag}>a</div>") == ["a"], tag
    assert blocks("<div><select><option>x<option>y<p>a</p><template><p>z</p></template><p>b") == ["a", "b"]
    assert blocks("<div><button>x<template><p>z</p></template><p>a") == ["a"]


def test_blocks_with_many_names_keep_all_features(spark):
    many = " ".join("".join(x) for x in zip("abcdefghijklmnopqrst" * 2, "b" * 20 + "c" * 20))
    block = lambda names: html_blocks.leaf_blocks(f"<body class='{many}'><div class='{names}'><p>some words here</p></div>")[0]
    one, other = (set(html_extraction.block_features(block(x), 1, 3)) for x in ("sidebar", "widget"))
    assert len(one) > 45 and one - other and other - one
    page = "<html><body class='{}'><div class='menu'><a href='/'>home</a></div><article><h1>T</h1><p>Long enough text of the article, here.</p></article><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page.format(many)) for i in range(5)], "page_id long, url string, html string")
    got = html_extraction.extract(pages, html_extraction.train(pages)).select("text").distinct().collect()
    assert [r["text"] for r in got] == ["T\n\nLong enough text of the article, here."]


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        emit, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(emit[t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
        assert tuple(html_extraction.viterbi(emit, move)) == max(product((0, 1), repeat=n), key=value)


def test_tool_calls(spark):
    calls = [("a", None, "add", '{"y": 2, "x": 1}'), ("b", "a", "add", '{"x": "1"}'), ("c", "b", "sub", "{}"), ("d", "gone", "add", "nonsense"), ("e", "f", "add", None), ("f", "e", "add", '{"x":1,"y":2,"z":3}'), ("a", None, "add", '{"y": 2, "x": 1}'), (None, None, "add", "{}")]
    df = spark.createDataFrame(calls, "call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([("a", "3"), ("a", "3"), ("zz", "lost"), (None, "x")], "call_id string, content string")
    number = {"type": "integer"}
    schemas = {"add": {"type": "object", "properties": {"x": number, "y": number}, "required": ["x", "y"], "additionalProperties": False}}
    out = {r["call_id"]: r for r in tool_calls.link_calls(df, results, schemas).collect()}
    assert set(out) == {"a", "b", "c", "d", "e", "f", "zz"}
    assert [(out[k]["depth"], out[k]["status"]) for k in "abcdef"] == [(0, "answered"), (1, "unanswered"), (2, "unanswered"), (0, "unanswered"), (None, "unanswered"), (None, "unanswered")]
    assert (out["a"]["n_calls"], out["a"]["n_results"], out["a"]["errors"]) == (2, 2, [])
    assert out["b"]["errors"] == ["missing y", "type of x"] and out["c"]["errors"] == ["no such tool"]
    assert out["d"]["errors"] == out["e"]["errors"] == ["not a JSON object"] and out["f"]["errors"] == ["unknown z"]
    assert out["zz"]["status"] == "orphan"
    assert out["a"]["json"] == '{"arguments":{"x":1,"y":2},"call":"a","depth":0,"name":"add","result":"3","status":"answered"}'
    assert json.loads(out["f"]["json"])["arguments"] == {"x": 1, "y": 2, "z": 3}
    assert tool_calls.link_calls(df.limit(0), results.limit(0), schemas).count() == 0


def test_different_calls_and_results_are_all_kept(spark):
    odd = 'line\n"quoted" \\ é\u2028'
    calls = [("a", None, "say", '{"t": "x"}'), ("b", "a", "say", '{"t": "x"}'), ("b", "a", "say", '{"t": 1}'), ("c", "a", "say", json.dumps({"t": odd})), ("c", "b", "say", "{}")]
    results = [("a", odd), ("a", "2"), ("a", "2"), ("b", "3"), ("c", "4"), ("c", "5"), ("z", "6"), ("z", "7")]
    df = spark.createDataFrame(calls, "call_id string, after string, name string, arguments string")
    out = tool_calls.link_calls(df, spark.createDataFrame(results, "call_id string, content string"), {"say": {"type": "object", "properties": {"t": {"type": "string"}}, "required": ["t"]}}).collect()
    rows = [(r["call_id"], r["depth"], r["status"], r["n_calls"], r["n_results"], tuple(r["errors"]), json.loads(r["json"]).get("arguments", {}).get("t"), json.loads(r["json"]).get("result")) for r in out]
    want = [("a", 0, "answered", 1, 3, (), "x", odd), ("a", 0, "answered", 1, 3, (), "x", "2"), ("b", 1, "answered", 2, 1, (), "x", "3"), ("b", 1, "answered", 2, 1, ("type of t",), 1, "3")]
    want += [("c", 2, "ambiguous", 2, 2, (), odd, None), ("c", 2, "ambiguous", 2, 2, ("missing t",), None, None), ("c", 2, "ambiguous", 2, 2, (), None, "4"), ("c", 2, "ambiguous", 2, 2, (), None, "5"), ("z", None, "orphan", 0, 2, (), None, "6"), ("z", None, "orphan", 0, 2, (), None, "7")]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_depth_by_several_predecessors(spark):
    edges = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("d", "c"), ("e", "d"), ("f", "e"), ("f", "b"), ("g", "f"), ("g", "x"), ("x", "y"), ("y", "x"), ("h", "g")]
    got = tool_calls.topological_depth(spark.createDataFrame(edges, "call_id string, after string")).collect()
    assert {r["call_id"]: r["depth"] for r in got} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5, "g": None, "x": None, "y": None, "h": None}


def test_turns_are_linked_with_their_whole_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", "hi")], "conv_id long, turn int, role string, text string")
    calls, results, edges = tool_calls.conversation_calls(turns)
    row = tool_calls.link_calls(calls, results, tool_calls.TURN_SCHEMAS, edges).first()
    assert row["errors"] == [] and row["json"] == '{"arguments":{"meta":{"chars":9,"role":"user"},"text":"say \\"hi\\"\\n","turn":0},"call":"1:0","depth":0,"name":"open","result":"hi","status":"answered"}'


def test_schemas_reach_into_values(spark):
    point = {"type": "object", "properties": {"x": {"type": "number", "minimum": 0, "maximum": 10}, "tag": {"type": "string", "enum": ["a", "b"], "maxLength": 1}}, "required": ["x"], "additionalProperties": False}
    schemas = {"draw": {"type": "object", "properties": {"at": point, "path": {"type": "array", "items": {"type": "integer"}, "minItems": 1, "maxItems": 3}, "on": {"type": "boolean"}}, "required": ["at"]}}
    cases = {
        '{"at":{"x":1.5,"tag":"a"},"path":[1,2],"on":true,"more":1}': [],
        '{"at":{"x":11,"tag":"cc"}}': ["length of at.tag", "range of at.x", "value of at.tag"],
        '{"at":{"tag":"a","z":1},"path":[]}': ["items of path", "missing at.x", "unknown at.z"],
        '{"at":[],"path":[1,"2"],"on":null}': ["an item of path", "type of at", "type of on"],
        "{}": ["missing at"],
        "[]": ["not a JSON object"],
        "{": ["not a JSON object"],
    }
    df = spark.createDataFrame([(str(i), None, "draw", a) for i, a in enumerate(cases)], "call_id string, after string, name string, arguments string")
    got = {int(r["call_id"]): r["errors"] for r in tool_calls.link_calls(df, spark.createDataFrame([], "call_id string, content string"), schemas).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_calls_and_results_meet_in_a_hash_join(spark):
    df = spark.createDataFrame([("a", None, "say", "{}")], "call_id string, after string, name string, arguments string")
    one, got = tool_calls.summed(df, ["name", "arguments"], "calls"), tool_calls.summed(df.withColumnRenamed("name", "content"), ["content"], "results")
    plan = one.join(got.hint("shuffle_hash"), "call_id", "full")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_deep_chain(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"))
    assert tool_calls.topological_depth(df).where("depth <> cast(call_id as long)").count() == 0


@pytest.mark.parametrize("low, high, seed", [(1, 2047, 1), (1, 2047, 2), (600, 1100, 3), (200, 900, 4), (30, 400, 5)])
def test_islands_are_at_most_one_sequence_behind_best_fit_decreasing(low, high, seed):
    sizes = np.random.default_rng(seed).integers(low, high + 1, 2000)
    down = packing.fresh(sizes, np.argsort(-sizes, kind="stable"), 2048).max() + 1
    best, _ = packing.evolve(sizes, [], 2048, seed, 8)
    assert best.max() + 1 <= down + 1 and np.bincount(best, sizes).max() <= 2048
