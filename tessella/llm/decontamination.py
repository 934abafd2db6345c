"""Operator 4. Benchmark decontamination with a distributed positional inverted index.

Each benchmark window picks its rarest corpus terms; only the postings (term, document, place) of such terms are stored;
the lists of a window's two rarest terms are intersected after their offsets in the window are taken off; what is left is
compared with the whole window. The same lists give proximity matches. Everything is DataFrame work: no Python runs on the
executors. Small tables are written first, so that Spark knows their size and broadcasts them only below its threshold;
beyond it they are joined by a shuffle, where adaptive execution splits terms that are frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, stored, table

#: A word of benchmark and corpus: digits, lower-case letters, and anything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def match_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words, phrase) for each run of `size` consecutive words of an item; an item of fewer words, but not none, is
    one window. Words hold no space, so the space-joined phrase stands for its words."""
    w = items.select("item_id", match_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    w = w.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words"))
    return w.withColumn("phrase", F.array_join("words", " "))


def tokens_of(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, _h, _w): the words of each row, made once for all that follows. _h tells rows with the same doc_id
    and another text apart."""
    return stored(docs.select("doc_id", F.xxhash64("text").alias("_h"), match_words(F.col("text")).alias("_w")))


def corpus_terms(tokens: DataFrame) -> DataFrame:
    """(doc_id, _h, term, place): one row per word."""
    return tokens.select("doc_id", "_h", F.posexplode("_w").alias("place", "term"))


def rarest_terms(windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Stored windows (phrase, words) with `rare`, their words as (n, term, offset) from the rarest in the corpus on. The
    counts run over the whole corpus; a window with a word that the corpus lacks can't occur and is left out."""
    terms = stored(windows.select(F.explode("words").alias("term")).distinct())
    counts = tokens.select(F.explode("_w").alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select("phrase", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    ranked = each.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("rare"))
    return stored(windows.join(ranked, "phrase").where(F.size("rare") == F.size("words")))


def positional_index(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, _h, place) of the given terms."""
    return stored(corpus_terms(tokens).join(terms, "term", "left_semi").select("term", "doc_id", "_h", "place"))


def phrase_candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, _h, start, len, phrase): where the offset-adjusted lists of a window's two rarest terms meet."""
    first, second = F.get("rare", F.lit(0)), F.get("rare", F.lit(1))
    keyed = rare.select("phrase", F.size("words").alias("len"), first["term"].alias("term"), first["offset"].alias("_o"), second["term"].alias("_t2"), second["offset"].alias("_o2"))
    led = index.join(stored(keyed), "term").withColumn("start", F.col("place") - F.col("_o")).where("start >= 0").drop("term", "place", "_o")
    alone, rest = led.where(F.col("_t2").isNull()).drop("_t2", "_o2"), led.where(F.col("_t2").isNotNull())
    other = index.select(F.col("doc_id").alias("_d2"), F.col("_h").alias("_h2"), F.col("term").alias("_term2"), F.col("place").alias("_p2"))
    on = F.col("doc_id").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")) & (F.col("_t2") == F.col("_term2")) & (F.col("start") + F.col("_o2") == F.col("_p2"))
    met = rest.join(other, on, "left_semi").drop("_t2", "_o2")
    return alone.unionByName(met)


def near_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Proximity search: (pair columns, doc_id, _h, place_a, place_b) where term_a and term_b of a row of `pairs` stand
    at most `within` words apart, in either order. Places are dealt into blocks of within + 1 words, and each place of
    term_a looks into three blocks, so the join is by equality and nothing is compared all to all."""
    block = lambda c: F.floor(F.col(c) / (within + 1))
    a = pairs.join(index.select(F.col("term").alias("term_a"), "doc_id", "_h", F.col("place").alias("place_a")), "term_a")
    a = a.withColumn("_b", F.explode(F.array(block("place_a") - 1, block("place_a"), block("place_a") + 1)))
    b = index.select(F.col("term").alias("_tb"), F.col("doc_id").alias("_d2"), F.col("_h").alias("_h2"), F.col("place").alias("place_b")).withColumn("_b2", block("place_b"))
    joined = a.join(b, (F.col("term_b") == F.col("_tb")) & F.col("doc_id").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")) & (F.col("_b") == F.col("_b2")))
    return joined.where(F.abs(F.col("place_a") - F.col("place_b")) <= within).where((F.col("term_a") != F.col("term_b")) | (F.col("place_a") < F.col("place_b"))).drop("_tb", "_d2", "_h2", "_b", "_b2")


def by_row(df: DataFrame, more: DataFrame) -> DataFrame:
    """df with the columns of `more`, a row per (doc_id, _h)."""
    keyed = more.withColumnsRenamed({"doc_id": "_d2", "_h": "_h2"})
    return df.join(keyed, F.col("doc_id").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left").drop("_d2", "_h2")


def rows_in(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df whose (doc_id, _h) is in keys. The keys alone are written first: two numbers for each row that matters,
    so while they are few the rows of df stay where they are."""
    keyed = stored(keys.select(F.col("doc_id").alias("_d2"), F.col("_h").alias("_h2")))
    return df.join(keyed, F.col("doc_id").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")), "left_semi")


def matched_rows(tokens: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Stored (doc_id, _h, n_hit, hits, ids, n_near) of rows in which a window occurs, or its two rarest words come near
    each other (at most `size` words apart)."""
    windows = stored(benchmark_windows(items, size))
    rare = rarest_terms(windows.groupBy("phrase").agg(F.first("words").alias("words")), tokens)
    index = positional_index(tokens, stored(rare.select(F.explode(F.slice("rare", 1, 2)).alias("r")).select("r.term").distinct()))
    found = stored(phrase_candidates(index, rare).groupBy("doc_id", "_h").agg(F.collect_set(F.struct("start", "len", "phrase")).alias("_c")))
    same = lambda c: F.array_join(F.slice("_w", c["start"] + 1, c["len"]), " ") == c["phrase"]
    checked = by_row(rows_in(tokens, found), found).where(F.col("_c").isNotNull()).select("doc_id", "_h", F.sort_array(F.filter("_c", same)).alias("_c")).where(F.size("_c") > 0).distinct()
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    end = lambda c: c["start"] + c["len"]
    union = F.aggregate("_c", begin, lambda a, c: F.struct(F.greatest(a["end"], end(c)).alias("end"), (a["n"] + F.greatest(end(c) - F.greatest(a["end"], c["start"]), F.lit(0))).alias("n")))
    hits = F.array_distinct(F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"))))
    checked = stored(checked.select("doc_id", "_h", union["n"].cast("long").alias("n_hit"), hits.alias("hits"), F.array_distinct(F.transform("_c", lambda c: c["phrase"])).alias("phrases")))
    # Which items a window belongs to is looked up at the end, for windows that occur; however many there are, none is
    # carried through the joins before.
    ids = checked.select("doc_id", "_h", F.explode("phrases").alias("phrase")).join(windows.select("phrase", "item_id"), "phrase")
    ids = ids.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    pairs = stored(rare.where(F.size("rare") > 1).select(F.get("rare", F.lit(0))["term"].alias("term_a"), F.get("rare", F.lit(1))["term"].alias("term_b")).distinct())
    near = near_matches(index, pairs, size).distinct().groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("n_near"))
    exact = by_row(checked.drop("phrases"), ids).withColumn("n_near", F.lit(0).cast("long"))
    none = near.select("doc_id", "_h", F.lit(0).cast("long").alias("n_hit"), F.array().cast(checked.schema["hits"].dataType).alias("hits"), F.array().cast("array<string>").alias("ids"), "n_near")
    both = exact.unionByName(none).groupBy("doc_id", "_h")
    return stored(both.agg(F.max("n_hit").alias("n_hit"), F.max_by("hits", "n_hit").alias("hits"), F.max_by("ids", "n_hit").alias("ids"), F.max("n_near").alias("n_near")))


def with_verdict(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """rows with _h and _w become rows with the columns of a verdict."""
    out = by_row(rows.withColumn("n_words", F.size("_w").cast("long")).drop("_w"), matched)
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_near": F.coalesce("n_near", F.lit(0).cast("long")), "_i": F.coalesce("ids", F.array().cast("array<string>")), "hits": F.coalesce("hits", F.array().cast(matched.schema["hits"].dataType))})
    out = out.withColumn("n_items", F.size("_i").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("_i", ","), 256))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("_i", "ids", "_h")


#: Columns that a verdict adds.
VERDICT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "hits"]


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Columns of docs plus VERDICT: n_words, n_hit, n_items, items_sha256, contaminated, n_near (how often the two rarest
    words of a window stand at most `size` words apart, a place each), hits (start and length of each match).

    A document word inside any occurrence of a benchmark window is hit. Null and empty texts have no words; a repeated
    row gets the same result each time; an empty benchmark contaminates nothing; other columns pass through (columns of
    the result replace those of the same name, and columns with a leading underscore are left out).
    """
    rows = docs.select(*[c for c in docs.columns if not c.startswith("_") and c not in VERDICT])
    matched = matched_rows(tokens_of(docs), items, size)
    return with_verdict(rows.withColumns({"_h": F.xxhash64("text"), "_w": match_words(F.col("text"))}), matched).select(*rows.columns, *VERDICT)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination(), with the verdict taken from the stored words: nothing of a text but its words is asked for."""
    tokens = tokens_of(table(spark, sf_dir, "documents"))
    out = with_verdict(tokens, matched_rows(tokens, table(spark, sf_dir, "benchmark"), 10))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")
