"""Statistics of whole texts as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Ratios that models may use; each is made of the counts below.
FEATURES = ("symbols", "repeats", "copied_lines", "word_length", "capitals", "marks", "digits", "line_words", "variety", "length")


def _windows(words: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: make(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), i))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words that the text has twice or more.

    Most texts have no such window; this is seen from their hashes: equal windows have equal hashes. Else the windows themselves
    are sorted with their places, so that equal ones are neighbours.
    """

    def exact(w: Column) -> Column:
        windows = F.sort_array(_windows(w, lambda a, b, c, i: F.struct(F.concat_ws(" ", a, b, c).alias("s"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twice = lambda x, k: F.coalesce(x["s"] == F.get(s, k - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(s, k + 1)["s"], F.lit(False))
            places = F.transform(F.filter(s, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(places)))

        return let(windows, marked)

    some = let(_windows(words, lambda a, b, c, i: F.xxhash64(a, b, c)), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 3, 0).when(some, exact(words)).otherwise(0)


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (contract) and more counts, all long.

    A null text counts as empty: all counts are 0 but n_lines, which is 1. n_dup_lines counts lines that have a word and equal an
    earlier line of the text.
    """
    text = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = text.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    lines = F.split("_text", "\n", -1)
    copied = let(F.filter(lines, lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    made = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": copied,
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": F.size(lines),
        "n_capitals": count("[A-Z]"),
        "n_marks": count("[!?]"),
        "n_digits": count("[0-9]"),
        "n_kinds": F.size(F.array_distinct("_words")),
    }
    return text.select(*keep, *[c.cast("long").alias(k) for k, c in made.items()])


def features() -> dict[str, Column]:
    """Of a frame with text_counts columns."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    out = {
        "symbols": F.col("n_symbols") / chars,
        "repeats": F.col("n_repeat_words") / words,
        "copied_lines": F.col("n_dup_lines") / F.col("n_lines"),
        "word_length": F.col("word_chars") / words,
        "capitals": F.col("n_capitals") / chars,
        "marks": F.col("n_marks") / chars,
        "digits": F.col("n_digits") / chars,
        "line_words": F.log1p(F.col("n_words") / F.col("n_lines")),
        "variety": F.col("n_kinds") / words,
        "length": F.log1p("n_words"),
    }
    return {k: out[k].cast("double") for k in FEATURES}
