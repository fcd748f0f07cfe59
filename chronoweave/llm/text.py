"""Column helpers on text that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words: \x20 and \x09 to \x0D.
SPACE = r"[ \t-\r]+"
#: A word.
WORD = r"[^ \t-\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def window_hashes(ws: Column, n: int) -> Column:
    """A 64-bit hash of each window of ``n`` words; none if there are fewer words."""
    return F.when(
        F.size(ws) >= n,
        F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))
