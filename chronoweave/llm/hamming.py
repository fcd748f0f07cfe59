"""Hamming search by the generalised pigeonhole principle.

The 64 bits are grouped into partitions, correlated bits together. Two
fingerprints within ``radius`` bits differ in at most T[i] bits of some
partition i whenever the T[i] + 1 sum to ``radius`` + 1. For each query,
dynamic programming spends these units unequally over the partitions, by
estimated candidate counts; a partition without a unit is not probed. Probes
are all values within T[i] bits, looked up by an equi-join, and candidates are
verified in the join condition. No pair within the radius is lost.

Where sizes must be alike too, rows meet in buckets of sizes: a row is
indexed in its own bucket and the next, and asks in its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Writer

#: Numbers of partitions to choose from.
PARTITIONS = (2, 3, 4, 5, 6, 8, 10)
#: Relative cost of a probe (a row that is shuffled and sorted, some microseconds) and of a candidate (a comparison in the join, some nanoseconds).
PROBE, CANDIDATE = 2.0, 0.005
#: Width of the blocks of bits that value counts are kept of: 256 counts each.
BLOCK_BITS = 8


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row of 64 bits for each fingerprint, bit 0 the highest."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _values(bits: np.ndarray, members: list[int]) -> np.ndarray:
    """The numbers that some bits spell."""
    out = np.zeros(len(bits), np.int64)
    for m in members:
        out = (out << 1) | bits[:, m]
    return out


def group_bits(moments: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of like size, each grown by the bit that correlates most with it."""
    if n > 0:
        p = np.diag(moments) / n
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        corr = np.abs((moments / n - np.outer(p, p)) / np.outer(spread, spread))
    else:
        corr = np.eye(64)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = (64 + parts - 1 - k) // parts
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(group)
    return groups


def _blocks(group: list[int]) -> list[list[int]]:
    return [group[i : i + BLOCK_BITS] for i in range(0, len(group), BLOCK_BITS)]


@dataclass
class Plan:
    """``n`` fingerprints that one meets, groups of bits, and for each group the shares of fingerprints at 0 to ``radius`` bits from each value of its blocks."""

    radius: int
    n: float
    groups: list[list[int]]
    near: list[list[np.ndarray]]

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """Cost of searching each group with 0 to radius + 1 units, for each row of bits."""
        out = np.zeros((len(bits), len(self.groups), self.radius + 2))
        for g, (group, near) in enumerate(zip(self.groups, self.near)):
            dist = np.zeros((len(bits), self.radius + 1))
            dist[:, 0] = 1
            for block, table in zip(_blocks(group), near):
                here = table[_values(bits, block)]
                dist = np.stack([sum(dist[:, j] * here[:, d - j] for j in range(d + 1)) for d in range(self.radius + 1)], axis=1)
            balls = np.cumsum([comb(len(group), d) for d in range(self.radius + 1)])
            out[:, g, 1:] = PROBE * balls + CANDIDATE * self.n * np.cumsum(dist, axis=1)
        return out

    def allocate(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of each group and the total cost, for each row of bits."""
        costs, units = self.costs(bits), self.radius + 1
        best = np.full((len(bits), units + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for g in range(len(self.groups)):
            choice = np.stack([np.stack([best[:, s - u] + costs[:, g, u] if u <= s else np.full(len(bits), np.inf) for u in range(units + 1)]) for s in range(units + 1)])
            picks.append(choice.argmin(axis=1))
            best = choice.min(axis=1).T
        out, state = np.zeros((len(bits), len(self.groups)), np.int64), np.full(len(bits), units)
        for g in reversed(range(len(self.groups))):
            out[:, g] = picks[g][state, np.arange(len(bits))]
            state = state - out[:, g]
        return out, best[:, units]

    def masks(self, g: int, units: int) -> np.ndarray:
        """All differences of fewer than ``units`` bits in group g."""
        width = len(self.groups[g])
        return np.array([sum(1 << b for b in c) for d in range(units) for c in combinations(range(width), d)], np.int64)


def _sums(fps: DataFrame, make) -> dict[int, int]:
    """Sums over all partitions of counts by cell; ``make`` gives an array of counts for fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = make(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total = own if total is None else total + own
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}


def _moments(fps: np.ndarray) -> np.ndarray:
    total = np.zeros((64, 64))
    for i in range(0, len(fps), 1 << 16):
        b = _bits(fps[i : i + (1 << 16)]).astype(np.float32)
        total += b.T @ b
    return np.r_[total.reshape(-1), len(fps)].astype(np.int64)


def make_plan(fps: DataFrame, radius: int, meet: float = 1.0) -> Plan:
    """The cheapest plan for a self-join of ``fps`` (a column fp), each row of which meets a share ``meet`` of the others.

    Only sums of bounded number reach the driver: 64 x 64 moments, and 256
    counts for each block of bits of each grouping to choose from. Costs are
    compared on fingerprints drawn at random from these counts.
    """
    found = _sums(fps, _moments)
    flat = np.zeros(64 * 64 + 1, np.int64)
    for cell, v in found.items():
        flat[cell] = v
    n, moments = int(flat[-1]), flat[:-1].reshape(64, 64).astype(float)
    choices = [group_bits(moments, n, parts) for parts in PARTITIONS if parts <= 2 * (radius + 1)]
    blocks = [b for groups in choices for g in groups for b in _blocks(g)]

    def count(values: np.ndarray) -> np.ndarray:
        bits = _bits(values)
        return np.concatenate([np.bincount(_values(bits, b), minlength=256) for b in blocks]).astype(np.int64)

    counts = np.zeros(256 * len(blocks), np.int64)
    for cell, v in _sums(fps, count).items():
        counts[cell] = v
    counts = counts.reshape(-1, 256)
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    rng, at, plans = np.random.default_rng(1), 0, []
    for groups in choices:
        near, drawn = [], np.zeros((400, 64), np.uint8)
        for group in groups:
            tables = []
            for block in _blocks(group):
                share = counts[at] / max(n, 1)
                tables.append(np.stack([np.where(apart == d, share[None, :], 0).sum(axis=1) for d in range(radius + 1)], axis=1))
                value = rng.choice(256, 400, p=share / share.sum()) if n else np.zeros(400, np.int64)
                for k, m in enumerate(reversed(block)):
                    drawn[:, m] = (value >> k) & 1
                at += 1
            near.append(tables)
        plan = Plan(radius, n * meet, groups, near)
        plans.append((plan.allocate(drawn)[1].mean(), len(plans), plan))
    return min(plans)[2]


def _slots(plan: Plan, g: int, bucket: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (bucket.astype(np.int64) << 48) | (g << 40) | values


def _entries(plan: Plan, spread: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, bucket, more columns) to one row for each group of bits, under its value and the bucket; with ``spread`` under the next bucket too."""
    for batch in batches:
        bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        bucket = batch.column(1).to_numpy(zero_copy_only=False)
        for g, group in enumerate(plan.groups):
            values = _values(bits, group)
            for more in range(spread + 1):
                yield pa.RecordBatch.from_arrays([pa.array(_slots(plan, g, bucket + more, values)), *batch.columns], ["slot", *batch.schema.names])


def _probes(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, bucket, more columns) under all values that the row's thresholds allow, with the thresholds."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            rows = batch.slice(i, 4096)
            bits = _bits(rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            bucket = rows.column(1).to_numpy(zero_copy_only=False)
            units, _ = plan.allocate(bits)
            packed = (units << (4 * np.arange(len(plan.groups)))).sum(axis=1)
            for g, group in enumerate(plan.groups):
                values = _values(bits, group)
                for u in np.unique(units[:, g][units[:, g] > 0]):
                    own, masks = np.flatnonzero(units[:, g] == u), plan.masks(g, int(u))
                    step = max(1, (1 << 16) // len(masks))
                    for k in range(0, len(own), step):
                        some = own[k : k + step]
                        slots = _slots(plan, g, bucket[some][:, None], values[some][:, None] ^ masks[None, :]).reshape(-1)
                        told = rows.take(pa.array(np.repeat(some, len(masks))))
                        yield pa.RecordBatch.from_arrays([pa.array(slots), *told.columns, pa.array(np.repeat(packed[some], len(masks)))], ["slot", *batch.schema.names, "units"])


#: Rounds in which rows are compared with drawn ones alone, and rows drawn from each slot. What these join need not be compared pair by pair.
STARS, DRAWN = 3, 8


@dataclass(frozen=True)
class Near:
    """What makes two rows (key, fp, size and the columns ``wide``) candidates: at most ``radius`` bits (14 at most) between their fp, ``wide_radius`` between fp and ``wide`` together, and sizes ``ratio`` alike."""

    radius: int
    ratio: float = 0.0
    wide: tuple[str, ...] = ()
    wide_radius: int = 0

    def bucket(self) -> Column:
        """Rows of like size are in one bucket or in neighbours."""
        return (F.floor(F.log("size") / F.lit(-math.log(self.ratio) * 1.0001)) if self.ratio else F.lit(0)).cast("int")

    def condition(self, radius: int) -> str:
        """On rows q and x of different roots."""
        close = f"q.root <> x.root AND bit_count(q.fp ^ x.fp) <= {int(radius)} AND least(q.size, x.size) >= {float(self.ratio)!r}D * greatest(q.size, x.size) - 1e-9D"
        if self.wide:
            close += " AND " + " + ".join(f"bit_count(q.{c} ^ x.{c})" for c in ("fp", *self.wide)) + f" <= {int(self.wide_radius)}"
        return close


class _Search:
    """Candidates within ``radius`` among the rows of ``state``: key, fp, size, wide columns, root and bucket."""

    def __init__(self, state: DataFrame, near: Near, radius: int):
        sizes = {r["bucket"]: r["count"] for r in state.groupBy("bucket").count().collect()}  # a row for each factor 1 / ratio of sizes
        n = sum(sizes.values())
        meet = sum(c * (c + sizes.get(b - 1, 0)) for b, c in sizes.items()) / max(n, 1) ** 2
        self.plan, self.spread, self.condition = make_plan(state, radius, meet), int(near.ratio > 0), near.condition(radius)
        self.columns = ["fp", "bucket", "key", "size", "root", *near.wide]

    def _mapped(self, state: DataFrame, make, more: str = "") -> DataFrame:
        rows = state.select(*self.columns)
        return rows.mapInArrow(make, "slot long, " + ", ".join(f"{c} {t}" for c, t in rows.dtypes) + more).drop("bucket")

    def _entries(self, state: DataFrame, spread: int) -> DataFrame:
        plan = self.plan
        return self._mapped(state, lambda b: _entries(plan, spread, b))

    def stars(self, state: DataFrame, salt: int) -> DataFrame:
        """Pairs (u, v, ru, rv) of every key with two drawn ones at most: of those drawn from its slots the first in the order of a hash that all slots share, and the nearest."""
        least = [F.min_by("key", F.xxhash64("key", F.lit(salt * DRAWN + k))) for k in range(DRAWN)]
        drawn = self._entries(state, self.spread).groupBy("slot").agg(F.array_distinct(F.array(*least)).alias("keys")).select("slot", F.explode("keys").alias("key"))
        reps = drawn.join(state.drop("bucket"), "key")
        met = self._entries(state, 0).alias("q").join(reps.alias("x"), F.expr(f"q.slot = x.slot AND q.key <> x.key AND {self.condition}"))
        other = F.struct(F.col("x.key").alias("v"), F.col("x.root").alias("rv"))
        first = F.min_by(other, F.xxhash64("x.key", F.lit(salt)))
        nearest = F.min_by(other, F.struct(F.expr("bit_count(q.fp ^ x.fp)"), "x.key"))
        picks = met.groupBy(F.col("q.key").alias("u"), F.col("q.root").alias("ru")).agg(F.array_distinct(F.array(first, nearest)).alias("_to"))
        return picks.select("u", "ru", F.inline("_to")).select("u", "v", "ru", "rv")

    def pairs(self, state: DataFrame) -> DataFrame:
        """All pairs (u, v, ru, rv) of keys of different roots. A pair comes up once: the larger size asks, in the first group whose threshold the pair meets."""
        plan = self.plan
        asks = self._mapped(state, lambda b: _probes(plan, b), ", units long").alias("q")
        close = f"q.slot = x.slot AND (q.size > x.size OR (q.size = x.size AND q.key > x.key)) AND {self.condition}"
        for g, group in enumerate(plan.groups[:-1]):
            mask = sum(1 << (63 - bit) for bit in group)
            mask -= (mask >> 63) << 64
            close += f" AND ((shiftright(q.slot, 40) & 255) <= {g} OR bit_count((q.fp ^ x.fp) & {mask}L) >= (shiftright(q.units, {4 * g}) & 15))"
        met = asks.join(self._entries(state, self.spread).alias("x").hint("merge"), F.expr(close))
        return met.select(F.col("q.key").alias("u"), F.col("x.key").alias("v"), F.col("q.root").alias("ru"), F.col("x.root").alias("rv"))


def similar_pairs(fps: DataFrame, radius: int) -> DataFrame:
    """All pairs (a, b), a > b as signed numbers, of distinct fingerprints (a column fp) that differ in at most ``radius`` bits. An empty table gives no pairs."""
    near = Near(radius)
    state = fps.select("fp", F.lit(0).alias("bucket"), F.col("fp").alias("key"), F.lit(1).alias("size"), F.col("fp").alias("root"))
    return _Search(state, near, radius).pairs(state).select(F.col("u").alias("a"), F.col("v").alias("b"))


def similar_groups(rows: DataFrame, near: Near, write: Writer, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, root): the smallest key reachable over links, for every row of ``rows`` (key, fp, size and the wide columns of ``near``).

    Rows link if ``near`` makes them candidates and ``verify`` keeps the pair:
    it gets (u, v, ru, rv) and gives back those that hold. Keys are distinct.

    Groups of very many are not compared pair by pair: a few rounds compare
    each row with drawn representatives of its slots, and what is then joined
    is one group. All candidates that are still apart are compared at last, so
    the groups are those of all links.
    """
    state = write(rows.select("key", "fp", F.col("size").cast("int").alias("size"), *near.wide, F.col("key").alias("root"), near.bucket().alias("bucket")), "rows")
    search = _Search(state, near, near.radius)
    steps = [lambda s, k=k: search.stars(s, k) for k in range(STARS)]
    for step in [*steps, search.pairs]:
        pairs = step(state)
        links = (verify(pairs) if verify else pairs).select("ru", "rv")
        joined = components(links.select(F.col("ru").alias("u"), F.col("rv").alias("v")), write).select(F.col("vertex").alias("root"), F.col("root").alias("to"))
        state = write(state.join(joined, "root", "left").select("key", "fp", "size", *near.wide, F.coalesce("to", "root").alias("root"), "bucket"), "rows")
    return state.select("key", "root")
