"""A folder of recordings in, a timeline and its exports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.devices import device_of, group_clips
from ..operators.features import CHUNK
from ..operators.lanes import assign_lanes, frame_rate
from ..options import FRAME_RATES, FrameRate, SyncOptions, TrackLimits
from ..sources.media import failures, find_media, probe_files, read_signals
from ..sources.sinks import build_timeline, export_edl, export_xml, report
from ..storage import settled
from .sync import SyncResult, sync


@dataclass
class FolderResult:
    """What a folder gives: its files, those that cannot take part, the solve, and the timeline with lanes."""

    project: str
    files: DataFrame
    failures: DataFrame
    result: SyncResult
    timeline: DataFrame
    rate: FrameRate

    def edl(self) -> DataFrame:
        return export_edl(self.timeline, self.project, self.rate)

    def xml(self) -> DataFrame:
        return export_xml(self.timeline, self.project, self.rate)

    def report(self) -> DataFrame:
        return report(self.result, self.timeline)

    def export(self, folder: str) -> None:
        """The exports as text files below ``folder``: a list for each device, one XML, one report. Spark writes them, to any store it knows."""
        named = self.edl().select(F.col("file").alias("name"), "text")
        others = self.xml().select(F.lit("timeline.xml").alias("name"), "text").union(self.report().select(F.lit("report.txt").alias("name"), "text"))
        named.union(others).withColumn("text", F.regexp_replace("text", "\n$", "")).write.mode("overwrite").partitionBy("name").text(folder)


def _clips(files: DataFrame) -> DataFrame:
    """Clips in the order of their paths."""
    order = Window.partitionBy("project_id").orderBy("clip_id")
    return files.select(
        "project_id", (F.row_number().over(order) - 1).alias("clip_index"), "clip_id", F.col("device").alias("track_id"), F.col("clip_id").alias("name"), F.col("out_rate").alias("sample_rate"),
        "timecode_seconds", "recorded_at_seconds", "recorded_at_source", "frame_rate",
    )


def sync_folder(
    spark: SparkSession, root: str, project: str = "project", opts: SyncOptions | None = None, limits: TrackLimits | None = None, rate: FrameRate | None = None,
    overrides: DataFrame | None = None, decoder: Callable | None = None, chunk: int = CHUNK,
) -> FolderResult:
    """Find, probe, group, align and lay out the recordings below ``root``.

    A file is a clip, told by its path below ``root``. Files whose sound can't
    be read are rows of ``failures`` and take no part. Signals go from files to
    chunks and never through the driver. ``overrides`` (project_id, clip_id,
    device_id) sets devices by hand; without a ``rate`` the commonest of the
    files' counts.
    """
    found = find_media(spark, root)
    probes = settled(probe_files(found.select("path")), "probes")
    base = F.regexp_replace(F.col("path"), "^file:/*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/") + "/"
    own = F.when(F.instr(base, top) > 0, F.substr(base, F.instr(base, F.lit(top)) + len(top))).otherwise(base)
    good = probes.where("has_audio AND decodable").withColumn("project_id", F.lit(project)).withColumn("clip_id", own)
    inputs = good.select("project_id", "clip_id", F.col("clip_id").alias("path"), "has_video", *[F.try_element_at("tags", F.lit(c)).alias(c) for c in ("make", "model", "serial")])
    assigned = group_clips(settled(inputs, "inputs"))
    none = spark.createDataFrame([], "project_id string, clip_id string, device_id string")
    devices = device_of(inputs, assigned, overrides if overrides is not None else none).withColumnRenamed("device_id", "device")
    signals = read_signals(good.select("path"), chunk=chunk, decoder=decoder).join(good.select("path", "project_id", "clip_id"), "path")
    chunks = settled(signals.select("project_id", "clip_id", "chunk_idx", "start_sample", "samples", "sample_rate"), "signals")
    rates = chunks.groupBy("project_id", "clip_id").agg(F.max("sample_rate").alias("out_rate"))
    files = settled(good.join(devices, ["project_id", "clip_id"]).join(rates, ["project_id", "clip_id"]), "files")
    clips = settled(_clips(files), "clips")
    result = sync(clips, opts, chunks.drop("sample_rate"), chunk=chunk)
    told = files.select("project_id", "clip_id", F.col("clip_id").alias("path"), "has_video", "has_audio", "channels", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), "duration_seconds", "timecode_seconds", "device")
    lines = build_timeline(result.placements.drop("timecode_seconds", "duration_seconds"), told, root)
    spans = lines.select("project_id", "id", F.col("reel").alias("device"), F.col("start_seconds").alias("start"), F.col("duration_seconds").alias("duration"), F.col("has_video").alias("video"), F.col("has_audio").alias("audio"), F.col("audio_channels").alias("channels"))
    timeline = settled(lines.join(assign_lanes(spans, limits), ["project_id", "id"], "left"), "timeline")
    if rate is None:
        label = frame_rate(clips).first()
        rate = dict(FRAME_RATES).get(label["label"] if label else "25", FrameRate())
    return FolderResult(project, files, failures(probes), result, timeline, rate)
