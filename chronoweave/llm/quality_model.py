"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on the
non-negative unbiased risk: prior * E_P[loss(f)] + max(0, E_U[loss(-f)] -
prior * E_P[loss(-f)]). When the part in the maximum falls below zero, a step
goes against it, so that the network does not fit the unlabelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import STOP_WORDS
from .splits import bounded_sample, remainder

#: Bound of the training sample: rows with a label, and rows of unlabelled text.
MAX_TRAINING_ROWS = 20_000
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER = slice(ord("A"), ord("Z") + 1)
_DIGIT = slice(ord("0"), ord("9") + 1)
_PUNCTUATION = [ord(c) for c in ".,;:?'\"()-"]
_SYMBOLS = [ord(c) for c in "#*$%&<>"]
N_FEATURES = 19


def features(text: str | None) -> list[float]:
    """Measures of a whole text; a null text is an empty one."""
    b = (text or "").encode("utf-8", "replace")
    ws = b.lower().split()
    n, size = max(len(ws), 1), max(len(b), 1)
    byte = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    lines = [x for x in b.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    runs = sum(map(bytes.__eq__, ws, ws[1:]))
    ends = sum(x.rstrip()[-1:] in b".!?\"" for x in lines)
    return [
        np.log1p(len(ws)), sum(map(len, ws)) / n, len(set(ws)) / n, len(set(zip(ws, ws[1:]))) / n, runs / n,
        float(byte[_SYMBOLS].sum()) / n, float(byte[ord("|")]) / n, float(byte[ord("!")]) / n, float(byte[_UPPER].sum()) / size, float(byte[_DIGIT].sum()) / size,
        sum(map(_STOP.__contains__, ws)) / n, np.log1p(m), 1 - len(set(lines)) / m if lines else 0.0, ends / m, float(byte[_PUNCTUATION].sum()) / n,
        float(byte[128:].sum()) / size, np.log1p(size / m), max(map(len, ws), default=0) ** 0.5, float(len(ws) > 0),
    ]


@dataclass(frozen=True)
class QualityModel:
    """A network of one hidden layer; with no layers it gives ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        a, b, c, d = self.layers
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-(np.tanh(z @ a + b) @ c + d)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of both: the least ratio of their shares above a threshold, with a margin for small counts."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled))
    return float(np.clip(np.min((u + margin * 0.5) / p), 0.02, 0.98))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, batch: int = 512, seed: int = 3) -> QualityModel:
    """Minimise the non-negative risk by Adam. A ``prior`` of None is estimated: a first fit of positives against unlabelled rows ranks them."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(0.5)
    if prior is None:
        first = fit_nnpu(positive[::2], unlabelled[::2], 0.5, hidden, max(epochs // 4, 5), batch, seed)
        prior = estimate_prior(first.score(positive[1::2]), first.score(unlabelled[1::2])) if len(positive) > 20 and len(unlabelled) > 20 else 0.5
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    for _ in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(max(1, -(-len(u) // batch))):
            xp, xu = p[np.take(pi, range(k * batch, (k + 1) * batch), mode="wrap")], u[np.take(ui, range(k * batch, (k + 1) * batch), mode="wrap")]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ w[0] + w[1])
            f = h @ w[2] + w[3]
            fp, fu = f[: len(xp)], f[len(xp) :]
            loss = lambda z: np.logaddexp(0, -z)
            rest = loss(-fu).mean() - prior * loss(-fp).mean()
            g_p, g_u = prior * -sigmoid(-fp) / len(fp), np.zeros(len(fu))
            sign = 1.0 if rest >= 0 else -1.0
            if rest < 0:
                g_p = np.zeros(len(fp))
            g_u = g_u + sign * sigmoid(fu) / len(fu)
            g_p = g_p - sign * prior * sigmoid(fp) / len(fp)
            g = np.concatenate([g_p, g_u])
            back = np.outer(g, w[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
            t += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(prior, mean, scale, tuple(w))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["quality", "unlabelled", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_TRAINING_ROWS) -> QualityModel:
    """A model from documents whose crc32 modulo ``folds`` is not 0.

    Positives are documents labelled 1; unlabelled text is any document of
    those folds. The sample is bounded: about ``max_rows`` labels and as many
    unlabelled rows, chosen by hashes. The prior is the share
    of label 1 among the sampled labels if both occur, else it is estimated
    from scores. A label that is null, or that a doc_id has in two versions,
    counts as none. Without positives the model gives 0.5.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").select("doc_id", "quality")
    known = bounded_sample(known, max_rows, 11, labels.count(), "doc_id")
    training = docs.select("doc_id", "text").where(remainder(F.col("doc_id"), folds) != 0)
    plain = training.select("doc_id", "text", F.lit(None).cast("int").alias("quality"), F.lit(True).alias("unlabelled"))
    plain = bounded_sample(plain, max_rows, 12, training.count(), "doc_id", "text")
    marked = training.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.lit(False).alias("unlabelled"))
    rows = plain.union(marked).select("quality", "unlabelled", "text").mapInArrow(_feature_batches, "quality int, unlabelled boolean, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), N_FEATURES)
    order = np.lexsort(x.T)  # the rows' order in the result varies between runs
    x, rows = x[order], rows.iloc[order]
    given = rows["quality"].to_numpy(dtype=float, na_value=np.nan)
    free = rows["unlabelled"].to_numpy(dtype=bool)
    one, zero = (given == 1) & ~free, (given == 0) & ~free
    prior = float(one.sum() / (one.sum() + zero.sum())) if one.any() and zero.any() else None
    return fit_nnpu(x[one], x[free], prior)


def _score_batches(model: QualityModel, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t.as_py()) for t in batch.column(at)], dtype=float).reshape(batch.num_rows, N_FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, "_quality_score"])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with a column _quality_score, from 0 to 1; null and empty texts get one too.

    Repeated rows get equal scores, an empty table gives no rows. Columns of
    ``docs`` may have any names but that of the new one, which is replaced.
    """
    docs = docs.drop("_quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("_quality_score", T.DoubleType())])
    at = docs.columns.index(text)
    return docs.mapInArrow(lambda b: _score_batches(model, at, b), schema)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the classifier scores below ``threshold``; its columns as they are."""
    return score_quality(docs, fit_quality(docs, labels)).where(F.col("_quality_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
