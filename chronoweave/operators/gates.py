"""Which pairs of clips are worth comparing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import GateOptions

_META = ("clip_index", "clip_id", "track_id", "duration_seconds", "trusted_at")


def _meta(clips: DataFrame) -> list[str]:
    """Clips that need no names, as they are only counted, may come without clip_id."""
    return [c for c in _META if c != "clip_id" or c in clips.columns]


def all_pairs(clips: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Every pair i < j of a project, by metadata alone: columns of both sides with a_ and b_ before their names, ``more`` among them."""
    one = lambda p: clips.select("project_id", *[F.col(c).alias(f"{p}_{c}") for c in (*_meta(clips), *more)])
    return one("a").join(one("b"), "project_id").where("a_clip_index < b_clip_index")


def _sided(p: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{p}_{c}")


_A, _B = _sided("a"), _sided("b")


def same_device(a: Callable[[str], Column] = _A, b: Callable[[str], Column] = _B) -> Column:
    """A clip without a device is its own device. ``a`` and ``b`` give the columns of either clip."""
    return F.coalesce(a("track_id") == b("track_id"), F.lit(False))


def could_meet(slop: float, a: Callable[[str], Column] = _A, b: Callable[[str], Column] = _B) -> Column:
    """Whether the spans in which two clips may have been recorded touch; true where a time is missing."""
    low = lambda c: c("trusted_at") - c("duration_seconds") - slop
    high = lambda c: c("trusted_at") + c("duration_seconds") + slop
    return F.coalesce((low(a) <= high(b)) & (low(b) <= high(a)), F.lit(True))


def time_candidates(clips: DataFrame, slop: float, bin_seconds: float = 7200.0) -> DataFrame:
    """The pairs on different devices that could meet, without looking at all pairs.

    Spans are cut into bins of time that meet in an equi-join; a pair counts in
    the first bin that both have. Clips without a trusted time, few by nature,
    meet all others.
    """
    spans = clips.withColumn("low", F.col("trusted_at") - F.col("duration_seconds") - slop).withColumn("high", F.col("trusted_at") + F.col("duration_seconds") + slop)
    cell = lambda c: F.floor(F.col(c) / bin_seconds)
    timed = spans.where("trusted_at IS NOT NULL").withColumn("bin", F.explode(F.sequence(cell("low"), cell("high"))))
    one = lambda df, p, more=(): df.select("project_id", *more, *[F.col(c).alias(f"{p}_{c}") for c in (*_META, "low", "high")])
    met = one(timed, "a", ["bin"]).join(one(timed, "b", ["bin"]), ["project_id", "bin"])
    met = met.where((F.col("a_clip_index") < F.col("b_clip_index")) & (F.col("bin") == F.floor(F.greatest("a_low", "b_low") / bin_seconds)) & (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))).drop("bin")
    loose = spans.where("trusted_at IS NULL")
    rest = one(spans, "a").join(one(loose, "b"), "project_id").where("a_clip_index <> b_clip_index AND (a_trusted_at IS NOT NULL OR a_clip_index < b_clip_index)")
    flip = F.col("a_clip_index") > F.col("b_clip_index")
    turned = rest.select("project_id", *[F.when(flip, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p, q in ("ab", "ba") for c in (*_META, "low", "high")])
    return met.unionByName(turned).where(~same_device()).drop("a_low", "a_high", "b_low", "b_high")


def rescue(clips: DataFrame, slop: float) -> DataFrame:
    """``clips`` with ``freed``: whether the clock keeps a clip from all clips of other devices, of which there are some; the clock, not the clip, is wrong.

    Clips are judged by the original table, so their order does not matter; a
    clip_index is there once in its project. A device whose clips all are kept
    from others needs no rescue of its own: each of its clips is let off.

    A project's clips are gathered once and looked through until one is found
    that could meet, so that no table of pairs is moved. Rows stay dealt by
    project_id.
    """
    meta = _meta(clips)
    rows = clips.where("project_id IS NOT NULL").select("project_id", *meta).repartition("project_id")
    every = rows.groupBy("project_id").agg(F.collect_list(F.struct(*meta)).alias("_all"))

    def judged(x: Column) -> Column:
        mine = lambda c: x[c]
        other = lambda y: (mine("clip_index") != y["clip_index"]) & ~same_device(mine, lambda c: y[c])
        met = F.exists("_all", lambda y: other(y) & could_meet(slop, mine, lambda c: y[c]))
        freed = ~F.coalesce(met, F.lit(False)) & F.coalesce(F.exists("_all", other), F.lit(False))
        return F.struct(*[x[c].alias(c) for c in meta], freed.alias("freed"))

    return every.select("project_id", F.inline(F.transform("_all", judged)))


def screen_pair(opts: GateOptions | None = None) -> Column:
    """Why a row of :func:`all_pairs` need not be compared, without rescue: same-device, recording-time, or null. The envelope bound, which needs signals, is judged where pairs are matched."""
    opts = opts or GateOptions()
    device = F.lit(False) if opts.allow_same_device else same_device()
    late = ~could_meet(opts.slop) if opts.by_recording_time else F.lit(False)
    return F.when(device, "same-device").when(late, "recording-time")


def screen(clips: DataFrame, opts: GateOptions | None = None) -> DataFrame:
    """All pairs with ``skipped``: same-device, recording-time, or null where they are to be compared. None is dropped."""
    opts = opts or GateOptions()
    if opts.by_recording_time:
        pairs = all_pairs(rescue(clips, opts.slop), ("freed",)).withColumn("allowed", could_meet(opts.slop) | F.col("a_freed") | F.col("b_freed")).drop("a_freed", "b_freed")
    else:
        pairs = all_pairs(clips).withColumn("allowed", F.lit(True))
    device = F.lit(False) if opts.allow_same_device else same_device()
    return pairs.withColumn("skipped", F.when(device, "same-device").when(~F.col("allowed"), "recording-time"))


def gate_stats(screened: DataFrame) -> DataFrame:
    """Counts of a project's pairs."""
    count = lambda c: F.count_if(c).cast("long")
    return screened.groupBy("project_id").agg(
        F.count("*").alias("total_pairs"), count(F.col("skipped").isNull()).alias("aligned_pairs"),
        count(F.col("skipped") == "same-device").alias("skipped_same_device"), count(F.col("skipped") == "recording-time").alias("skipped_by_recording_time"),
        count(F.col("skipped") == "envelope").alias("skipped_by_envelope"),
    )


def overlapping_neighbours(spans: DataFrame, group: list[str], tolerance: float = 0.0) -> DataFrame:
    """Spans (id, start, end) that begin before their predecessor in the group has ended, with the overlap."""
    order = Window.partitionBy(*group).orderBy("start", "id")
    prior = spans.withColumn("prior_id", F.lag("id").over(order)).withColumn("overlap", F.lag("end").over(order) - F.col("start"))
    return prior.where(F.col("overlap") > tolerance).select(*group, "prior_id", "id", "overlap")
