"""Connected components by alternating large and small stars; what is left of few edges is joined in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Writer, persisted

#: Edges up to which one task joins them all (16 bytes each). More go through rounds of stars until so many are left.
ONE_TASK_EDGES = 1 << 18


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges, and the smallest that each one reaches."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return names, names[root]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _root_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of all edges to (vertex, root)."""
    ends = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
    if ends:
        found = _roots(*(np.concatenate(x) for x in zip(*ends)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["vertex", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours link to the smallest vertex of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours link to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, write: Writer = persisted) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v): the smallest vertex reachable. Vertices are long numbers.

    ONE_TASK_EDGES edges at most are joined in one task, without rounds. Each
    round is written by ``write``, to the shared folder, so that plans stay
    short and lost executors cost one round. Rounds end when the edges no
    longer change, by a count and a sum of hashes: two numbers reach the
    driver, no edges do.
    A vertex of very many edges is one join key that adaptive execution splits;
    minima are pre-aggregated. Loops and repeats of edges do no harm; an empty
    table gives no rows.
    """
    state, now = None, write(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == state:
            break
        if row["n"] <= ONE_TASK_EDGES:
            return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_root_batches, "vertex long, root long")
        state = (row["n"], row["h"])
        now = write(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
