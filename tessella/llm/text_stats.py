"""Counts over a whole text as column expressions: shared by the quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import words_of

#: Counts that with_text_stats adds.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_stops", "n_digits", "n_other"]


def kept_chars(keep: str, of: str = "_rest"):
    """How many characters of a text are in a set."""
    return F.length(F.regexp_replace(of, f"[^{keep}]+", "")).cast("long")


def with_text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (longs) to each row. Null and empty texts have zeros. `text` itself is dropped.

    A word in a repeated 3-word window is found in the row itself: windows are hashed (64 bits), and only a text that
    has a repeated hash sorts its (hash, place) pairs, so the work is n log n for the longest text and nothing is shuffled.
    """
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).drop(text)
    df = df.withColumn("_w", words_of(F.col("_text"))).withColumn("n_words", F.size("_w").cast("long"))
    # Letters and white space go first: what is left is short, and the other counts are taken from it.
    df = df.withColumn("_rest", F.regexp_replace("_text", r"[\p{L}\x20\x09-\x0D]+", ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": kept_chars("#*$%&|<>"),
            "n_other": F.length("_rest").cast("long"),
            "n_upper": kept_chars(r"\p{Lu}", "_text"),
            "n_exclaim": kept_chars("!"),
            "n_stops": kept_chars(".?"),
            "n_digits": kept_chars("0-9"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_g": F.when(F.col("n_words") >= 3, F.transform(F.expr("sequence(0, cast(n_words as int) - 3)"), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<long>")),
        }
    ).drop("_text", "_rest", "_w", "_lines")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    again = lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"])
    places = F.transform("_s", lambda x, i: F.when(F.coalesce(again(x, i), F.get("_s", i - 1)["h"] == x["h"], F.get("_s", i + 1)["h"] == x["h"], F.lit(False)), x["i"]))
    df = df.withColumn("_p", F.sort_array(F.array_compact(places))).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
