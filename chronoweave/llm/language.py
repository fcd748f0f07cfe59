"""Language identification: known words first, shorter and shorter n-grams for others."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import hash_share, remainder

#: Bound of the training sample, in documents.
MAX_TRAINING_DOCS = 5_000
#: Longest n-gram, and the least count in the sample of a word and of an n-gram.
LONGEST, MIN_WORD, MIN_GRAM = 5, 2, 2
#: Words from which on a text's score is as sure as its mean score lets it be.
SURE = 20
#: Unseen words whose scores a worker remembers.
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """Log frequencies by language of words and of n-grams, each a row of ``table``."""

    languages: list[str]
    rows: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    unseen: dict[str, np.ndarray] = field(default_factory=dict)

    def word_score(self, word: str) -> np.ndarray:
        """The mean of the longest n-grams of the word, padded with spaces, of which any is known; zeros if none is."""
        found = self.unseen.get(word)
        if found is None:
            padded = f" {word} "
            found = np.zeros(len(self.languages))
            for n in range(min(LONGEST, len(padded)), 0, -1):
                own = [k for i in range(len(padded) - n + 1) if (k := self.grams.get(padded[i : i + n])) is not None]
                if own:
                    found = self.table[own].mean(axis=0)
                    break
            if len(self.unseen) >= CACHE:
                self.unseen.clear()
            self.unseen[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the total, by mean scores of the words; ``und`` without a letter."""
        ws = _WORD.findall(text.lower()) if text else []
        if not ws or not (ws[0].isalpha() or any(c.isalpha() for w in ws for c in w)):
            return UNDETERMINED, 0.0
        if not self.languages:
            return UNDETERMINED, 0.0
        ids = list(map(self.rows.get, ws))
        known = [k for k in ids if k is not None]
        total = self.table[known].sum(axis=0) if known else np.zeros(len(self.languages))
        if len(known) < len(ws):
            for word, k in zip(ws, ids):
                if k is None:
                    total = total + self.word_score(word)
        mean = total / len(ws) * min(len(ws), SURE)
        share = np.exp(mean - mean.max())
        best = int(mean.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _log_table(counts: list[tuple[str, str, int]], languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows of log frequency by language; what a language lacks has half a count there."""
    where = {name: i for i, name in enumerate(languages)}
    rows: dict[str, int] = {}
    for item, _, _ in counts:
        rows.setdefault(item, len(rows))
    table = np.full((len(rows), len(languages)), 0.5)
    for item, lang, n in counts:
        table[rows[item], where[lang]] = n
    return rows, np.log(table / np.maximum(table.sum(axis=0), 1.0)) if rows else table


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ws = _WORD.findall((text.as_py() or "").lower())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ws), pa.string()), pa.array(ws, pa.string())], ["lang", "word"])


def fit_languages(docs: DataFrame, folds: int = 5, max_docs: int = MAX_TRAINING_DOCS) -> LanguageModel:
    """Counts from documents with a language whose crc32 modulo ``folds`` is not 0.

    The sample is bounded to about ``max_docs`` documents, by a hash, each
    with its whole text; languages share it equally, and one that has fewer
    documents gives all of them. The counts are made in Spark. Items that
    occur once in the sample (MIN_WORD, MIN_GRAM) are left out. Without such
    documents the model knows no language and predicts ``und``.
    """
    rows = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), folds) != 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / len(sizes) / n))).otherwise(share)
    chosen = rows.where(hash_share(21, "doc_id", "text") < share)
    counts = chosen.select("lang", "text").mapInArrow(_word_batches, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = counts.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    of_length = lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    counts = counts.persist()
    grams = counts.select("lang", "n", F.explode(F.concat(*[of_length(n) for n in range(1, LONGEST + 1)])).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_GRAM)
    gram_rows = [(r["gram"], r["lang"], r["n"]) for r in grams.collect()]
    word_rows = [(r["word"], r["lang"], r["n"]) for r in counts.where(F.col("n") >= MIN_WORD).collect()]
    counts.unpersist()
    languages = sorted({lang for _, lang, _ in gram_rows})
    by_length: dict[int, list] = {}
    for row in sorted(gram_rows):
        by_length.setdefault(len(row[0]), []).append(row)
    words, table = _log_table(sorted(word_rows), languages)
    grams_at, tables = {}, [table]
    for own in by_length.values():  # frequencies are among n-grams of one length
        rows_of, part = _log_table(own, languages)
        base = sum(map(len, tables))
        grams_at.update({g: base + k for g, k in rows_of.items()})
        tables.append(part)
    return LanguageModel(languages, words, grams_at, np.concatenate(tables) if languages else np.zeros((0, 0)))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (from 0 to 1) of every row by its whole text.

    A text that is null or has no letter is ``und`` with score 0. Ties go to
    the first language in order. Repeated rows get equal results, an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(predict, f"doc_id {ids}, lang_pred string, score double")
