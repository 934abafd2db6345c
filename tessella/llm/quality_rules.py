"""Operator 10. Quality rules by weak supervision: each rule votes good (1), bad (-1) or abstains (0); expectation-
maximisation estimates how far each rule can be trusted; the posterior probability of "good" replaces all-must-pass."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import stored, table
from tessella.llm.text_stats import with_text_stats


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes over the counts of with_text_stats, each from one statistic alone: good, bad, or neither in between.
    Thresholds are round numbers set by hand, not fitted."""
    mean, symbols, other = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_other", "word_chars")
    lines, repeats = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    upper, exclaim, stops, digits = share("n_upper", "word_chars"), share("n_exclaim", "n_words"), share("n_stops", "n_words"), share("n_digits", "word_chars")
    return {
        "length": vote(F.col("n_words") < 50, F.col("n_words") >= 100),
        "word_length": vote((mean < 3) | (mean > 10), mean.between(4, 7)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "letters": vote(other > 0.1, other < 0.06),
        "dup_lines": vote((lines > 0.3) & (F.col("n_lines") >= 10), lines < 0.05),
        "repeats": vote(repeats > 0.3, repeats < 0.1),
        "upper": vote(upper > 0.3, upper < 0.1),
        "exclaim": vote(exclaim > 0.2, exclaim < 0.02),
        "sentences": vote(stops < 0.01, stops.between(0.03, 0.3)),
        "digits": vote(digits > 0.3, digits < 0.05),
    }


#: Belief about a rule before any row is seen: how often it votes so on (good, bad) texts. Bad texts show one or two signs
#: of junk and are faultless otherwise, so a bad vote says much and a good vote little.
BELIEF = {-1: (0.05, 0.25), 0: (0.1, 0.1), 1: (0.85, 0.65)}


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.85, smooth: float = 5.0) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over counted vote patterns: (log prior odds, per rule the log odds that a vote adds).

    Classes are conditionally independent (Dawid and Skene). Start: every rule is as BELIEF says, and `smooth` pseudo-rows
    of each class hold that belief against few rows. A vote's sign can't turn: its log odds are held at the side that the
    rule names, so that "good" stays the class that the rules call good.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    odds = math.log(prior / (1 - prior))
    add = [{v: math.log(g / b) for v, (g, b) in BELIEF.items()} for _ in range(n_rules)]
    for _ in range(rounds):
        good_all, bad_all = smooth * prior, smooth * (1 - prior)
        tally = [{v: [smooth * g, smooth * b] for v, (g, b) in BELIEF.items()} for _ in range(n_rules)]
        for votes, n in patterns:
            z = odds + sum(a[v] for a, v in zip(add, votes, strict=True))
            g = n / (1 + math.exp(-max(-60.0, min(60.0, z))))
            good_all, bad_all = good_all + g, bad_all + n - g
            for t, v in zip(tally, votes, strict=True):
                t[v][0] += g
                t[v][1] += n - g
        odds = math.log(good_all / bad_all)
        ratio = lambda t, v: math.log(t[v][0] / sum(x[0] for x in t.values())) - math.log(t[v][1] / sum(x[1] for x in t.values()))
        add = [{-1: min(0.0, ratio(t, -1)), 0: 0.0, 1: max(0.0, ratio(t, 1))} for t in tally]
    return odds, add


def judge_quality(df: DataFrame, rules: dict[str, Column], learn_from: Column | None = None) -> DataFrame:
    """Adds vote_<rule> columns and quality_probability. `rules` are columns over `df`, valued -1, 0 or 1.

    The vote patterns of the rows that `learn_from` holds for (all by default) are counted in one aggregation (at most
    3^rules rows, whatever the input) and the model is fitted on those counts; scoring is a sum of column expressions.
    Null votes abstain; an empty table gives an empty table.
    """
    names = [f"vote_{k}" for k in rules]
    voted = df.withColumns({f"vote_{k}": F.coalesce(v, F.lit(0)) for k, v in rules.items()})
    counted = voted.where(learn_from if learn_from is not None else F.lit(True)).groupBy(*names).count().collect()
    odds, add = fit_votes(sorted((tuple(r[:-1]), r[-1]) for r in counted))
    terms = [F.when(F.col(n) == -1, a[-1]).when(F.col(n) == 1, a[1]).otherwise(0.0) for n, a in zip(names, add, strict=False)]
    return voted.withColumn("quality_probability", 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(odds)))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_verdicts(docs: DataFrame, keep_at: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the posterior of each row of docs (doc_id, text). Accuracies are
    estimated from the rows that the base rules let pass, which are those the posterior decides. Null texts have no words
    and fail; repeated rows are judged alike. `carry`: these columns of docs pass through in a struct `row`, so that no
    name of theirs clashes."""
    row = [F.struct(*carry).alias("row")] if carry else []
    # Counts are written once and serve both the fit, which reads no more than them, and the scores.
    stats = stored(with_text_stats(docs.select("doc_id", "text", *row)).withColumn("base_failed", base_failed()))
    judged = judge_quality(stats, default_rules(), ~F.col("base_failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= keep_at))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")
