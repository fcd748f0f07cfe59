"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, window_hashes, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by", "are", "this", "from", "or", "an", "at",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au",
    "el", "los", "se", "del", "las", "con", "no", "por", "para", "su", "y", "al",
)


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= measure <= high``, or if it has fewer than ``from_words`` words."""

    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The threshold table. Shares are of the words, or of the lines with a word.
RULES = (
    Rule("n_words", 10, None),
    Rule("repeat_share", None, 0.2),
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_share", None, 0.1),
    Rule("exclamation_share", None, 0.2),
    Rule("upper_share", None, 0.4),
    Rule("letter_word_share", 0.6, None),
    Rule("stop_word_share", 0.03, None, from_words=20),
    Rule("distinct_share", 0.35, None, from_words=10),
    Rule("dup_line_share", None, 0.6, from_words=20),
)


def repeated_words(ws: Column, n: int = 5) -> Column:
    """The number of words in windows of ``n`` words found twice or more in the text."""

    def covered(hs: Column) -> Column:
        tagged = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(n), i - acc["last"])).alias("total"))
        return F.aggregate(let(tagged, twice), start, step, lambda acc: acc["total"])

    return let(window_hashes(ws, n), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def _verdict(rules: Sequence[Rule], measures: dict[str, Column]) -> Column:
    passes = F.lit(True)
    for rule in rules:
        value = measures[rule.measure]
        held = F.lit(True)
        if rule.low is not None:
            held = held & (value >= F.lit(rule.low))
        if rule.high is not None:
            held = held & (value <= F.lit(rule.high))
        passes = passes & ((measures["n_words"] < F.lit(rule.from_words)) | held)
    return passes


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The measures of every whole text, and whether all rules hold.

    ``docs`` keeps the columns ``keep`` alone, so that others may have any
    name. A null text counts as one without words: its measures are 0, it
    fails. Repeated rows give repeated results. An empty table gives no rows.

    Returns ``keep``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed and kept (boolean). ``base_failed`` is
    true with fewer than 10 words, or more than a fifth of the words in
    repeated windows of five.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ws = F.col("_words")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern)).cast("long")
    base = docs.select(*keep, body.alias("_text"), words(F.col(text)).alias("_words"), lines.alias("_lines")).select(
        *keep,
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct(ws)).alias("_distinct"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("_stop"),
        count("!").alias("_exclaim"),
        count(r"\p{Lu}").alias("_upper"),
        count(r"(?<![^ \t-\r])[^ \t-\r\p{L}]*+\p{L}").alias("_with_letter"),
    )
    per = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words").cast("double")), F.lit(0.0))
    measures = {
        "n_words": F.col("n_words"),
        "repeat_share": per("n_repeat_words"),
        "mean_word_chars": per("word_chars"),
        "symbol_share": per("n_symbols"),
        "exclamation_share": per("_exclaim"),
        "upper_share": F.coalesce(F.try_divide(F.col("_upper").cast("double"), F.col("word_chars").cast("double")), F.lit(0.0)),
        "letter_word_share": per("_with_letter"),
        "stop_word_share": per("_stop"),
        "distinct_share": per("_distinct"),
        "dup_line_share": F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("_n_lines").cast("double")), F.lit(0.0)),
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & _verdict(rules, measures)).alias("kept"))
