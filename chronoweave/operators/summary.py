"""Figures for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import rejection_reason


def quality_distribution(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Worst, middle (the element at half the count, rounded down), best, and how many lie below one half, of accepted pairs. Ranked, not collected."""
    accepted = pairs.where("accepted")
    order = Window.partitionBy(*keys).orderBy("quality")
    ranked = accepted.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(
        F.min("quality").alias("worst"), F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("quality"))).alias("median"), F.max("quality").alias("best"),
        F.count_if(F.col("quality") < 0.5).cast("long").alias("below_half"),
    )


def best_pair_per_clip(pairs: DataFrame) -> DataFrame:
    """Each clip's best measured pair: the highest quality, the first partner of equals."""
    ends = [pairs.where("method <> 'none'").select("project_id", F.col(f"{p}_id").alias("clip_id"), F.col(f"{q}_id").alias("other_id"), "quality") for p, q in ("ab", "ba")]
    best = ends[0].union(ends[1]).groupBy("project_id", "clip_id").agg(F.max("quality").alias("quality"), F.min_by("other_id", F.struct(-F.col("quality"), "other_id")).alias("other_id"))
    return best


def near_misses(pairs: DataFrame, limit: int = 25) -> DataFrame:
    """The best pairs of each project that were not accepted, ``limit`` at most, with the reason."""
    order = Window.partitionBy("project_id").orderBy(F.desc("quality"), "a_id", "b_id")
    missed = pairs.where("NOT accepted AND method <> 'none'").withColumn("reason", rejection_reason())
    return missed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def worst_disagreements(errors: DataFrame) -> DataFrame:
    """Disagreements with their ``rank`` in the project, the largest error first."""
    order = Window.partitionBy("project_id").orderBy(F.desc(F.abs("error_seconds")), "a_id", "b_id", "kind")
    return errors.withColumn("rank", F.row_number().over(order))


def implausible_drift(placements: DataFrame, ppm: float = 500.0) -> DataFrame:
    """Clips whose measured drift no clock has: failed measurements."""
    return placements.where(F.abs("drift_ppm") > ppm).select("project_id", "clip_id", "drift_ppm")


def audio_bytes(prepared: DataFrame) -> DataFrame:
    """(project_id, bytes): size of a project's signals as doubles."""
    return prepared.groupBy("project_id").agg((F.sum("n_samples") * 8).cast("long").alias("bytes"))


def layout_counts(timeline: DataFrame) -> DataFrame:
    """(project_id, video_tracks, audio_tracks, clips, no_lane): lanes of a timeline, and clips that have none."""
    return timeline.groupBy("project_id").agg(
        F.count_distinct("video_track_id").alias("video_tracks"), F.count_distinct("audio_track_id").alias("audio_tracks"), F.count("*").alias("clips"),
        F.count_if(F.col("video_track_id").isNull() & F.col("audio_track_id").isNull()).cast("long").alias("no_lane"),
    )


def device_summary(clips: DataFrame) -> DataFrame:
    """Clips, minutes and formats of each device."""
    return clips.groupBy("project_id", "device").agg(F.count("*").alias("clips"), (F.sum("duration_seconds") / 60).alias("minutes"), F.count_distinct("format").alias("formats"))


def islands(placements: DataFrame, shown: int = 8) -> DataFrame:
    """Groups of several clips, the largest first, with the first members' ids."""
    rank = Window.partitionBy("project_id", "group_id").orderBy("start_seconds", "clip_id")
    rows = placements.where("synced").withColumn("at", F.row_number().over(rank))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= shown, F.struct("at", "clip_id")))), lambda s: s["clip_id"]), ",")
    return rows.groupBy("project_id", "group_id").agg(F.count("*").alias("clips"), named.alias("members"))


def rate_histogram(clips: DataFrame) -> DataFrame:
    """Clips of each frame rate, to a thousandth."""
    return clips.where("frame_rate > 0").groupBy("project_id", F.round("frame_rate", 3).alias("frame_rate")).agg(F.count("*").alias("clips"))


def disagreement_counts(errors: DataFrame, frame_seconds: float) -> DataFrame:
    """Disagreements below and above a frame."""
    over = F.abs("error_seconds") >= frame_seconds
    return errors.groupBy("project_id").agg(F.count_if(over).cast("long").alias("over_frame"), F.count_if(~over).cast("long").alias("sub_frame"))


def too_short(placements: DataFrame, clips: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Clips that did not sync and are shorter than any match can be."""
    return placements.where("NOT synced").join(clips.select("project_id", "clip_id", "duration_seconds"), ["project_id", "clip_id"]).where(F.col("duration_seconds") < seconds).select("project_id", "clip_id", "duration_seconds")


def can_sync(clips: DataFrame) -> DataFrame:
    """Whether a project has two clips and two devices."""
    n = clips.groupBy("project_id").agg(F.count("*").alias("clips"), F.count_distinct("device").alias("devices"))
    return n.withColumn("can_sync", (F.col("clips") >= 2) & (F.col("devices") >= 2))


def hidden_clips(spans: DataFrame) -> DataFrame:
    """(track, hidden): clips that begin before the one before them on the track has ended."""
    order = Window.partitionBy("track").orderBy("start", "id")
    late = (F.col("start") < F.lag("end").over(order)).cast("int")
    return spans.withColumn("late", late).groupBy("track").agg(F.coalesce(F.sum("late"), F.lit(0)).cast("long").alias("hidden"))


def timeline_percent(placements: DataFrame, clips: DataFrame) -> DataFrame:
    """Left edge and width of each clip as a share of its project's timeline, in percent."""
    rows = placements.join(clips.select("project_id", "clip_id", "duration_seconds"), ["project_id", "clip_id"])
    total = F.greatest(F.max(F.col("start_seconds") + F.col("duration_seconds")).over(Window.partitionBy("project_id")), F.lit(1e-9))
    return rows.select("project_id", "clip_id", (100 * F.col("start_seconds") / total).alias("left"), (100 * F.col("duration_seconds") / total).alias("width"))
