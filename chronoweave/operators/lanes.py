"""Tracks of a timeline: runs, lanes, numbering and links."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import id_slug
from ..options import FRAME_RATES, TrackLimits

Span = tuple[float, float]


def _free(lane: list[Span], span: Span) -> bool:
    """Spans may touch."""
    return all(span[0] >= to or frm >= span[1] for frm, to in lane)


def _plain(spans: list[Span]) -> bool:
    """Every span has a length above zero, so that what overlaps is told by neighbours in a lane; false for NaN."""
    return all(frm < to for frm, to in spans)


def first_fit(spans: list[Span]) -> list[int]:
    """For each span, in order of start, the first run in which it covers nothing."""
    order = sorted(range(len(spans)), key=lambda k: spans[k][0])
    out = [0] * len(spans)
    if _plain(spans):
        ends: list[float] = []  # of each run's last span; spans come in order, so the others end before
        for k in order:
            start, end = spans[k]
            for at, last in enumerate(ends):
                if last <= start:
                    ends[at] = end
                    break
            else:
                at = len(ends)
                ends.append(end)
            out[k] = at
        return out
    runs: list[list[Span]] = []
    for k in order:
        at = next((i for i, run in enumerate(runs) if _free(run, spans[k])), len(runs))
        if at == len(runs):
            runs.append([])
        runs[at].append(spans[k])
        out[k] = at
    return out


def _room(lane: list[Span], spans: list[Span]) -> bool:
    """Whether plain spans cover nothing of a lane that is in order."""
    for frm, to in spans:
        k = bisect_left(lane, (to,))
        if k and lane[k - 1][1] > frm:
            return False
    return True


def pack(runs: list[tuple[list[Span], int]], budget: int) -> tuple[list[int], bool]:
    """Lanes of runs (spans, cost; no two spans of a run overlap): each opens a lane while the budget lasts, then shares the first one with room. Returns lanes, and whether the budget was exceeded."""
    lanes: list[list[Span]] = []
    out, spent, over = [], 0, False
    plain = all(_plain(spans) for spans, _ in runs)
    for spans, cost in runs:
        room = spent + cost <= budget
        at = None if room else next((i for i, lane in enumerate(lanes) if (_room(lane, spans) if plain else all(_free(lane, s) for s in spans))), None)
        if at is None:
            over |= not room
            at = len(lanes)
            lanes.append([])
            spent += cost
        lanes[at] += spans
        if plain:
            lanes[at].sort()
        out.append(at)
    return out, over


def project_lanes(devices: list, starts: list[float], durations: list[float], video: list, audio: list, channels: list[int], limits: TrackLimits) -> tuple[list[int | None], list[int | None]]:
    """Numbers of the lanes of pictures and of sounds for a project's clips in the order of their ids; None without one."""
    members: dict = {}
    for k, d in enumerate(devices):
        if d is not None:
            members.setdefault(d, []).append(k)
    spans = [(frm, frm + size) for frm, size in zip(starts, durations)]

    def rank(own: list[int]) -> tuple[bool, bool, float]:
        known = [starts[k] for k in own if starts[k] == starts[k]]
        return not any(video[k] for k in own), not known, min(known, default=0.0)

    out = []
    order = sorted(members.values(), key=rank)
    for kind, budget, wide in ((video, limits.video, False), (audio, limits.audio, True)):
        lanes: list[int | None] = [None] * len(devices)
        runs, clips = [], []
        for every in order:
            own = [k for k in every if kind[k]]
            if not own:
                continue
            at = first_fit([spans[k] for k in own])
            cost = max(1, max(channels[k] for k in every)) if wide else 1
            for r in range(max(at) + 1):
                held = [k for k, a in zip(own, at) if a == r]
                clips.append(held)
                runs.append(([spans[k] for k in held], cost))
        for lane, held in zip(pack(runs, budget)[0], clips):
            for k in held:
                lanes[k] = lane
        out.append(lanes)
    return out[0], out[1]


_LANES = "project_id string, id string, video_track_id string, audio_track_id string"


def _lane_batches(limits: TrackLimits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of project_id and id to their lanes; the last project of a batch waits for the next batch."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        projects, _, device, start, duration, video, audio, channels = (c.to_pylist() for c in table.columns)
        nan = float("nan")
        start, duration = [nan if x is None else x for x in start], [nan if x is None else x for x in duration]
        channels = [2 if x is None else x for x in channels]
        pictures, sounds, k = [], [], 0
        while k < len(projects):
            e = k + 1
            while e < len(projects) and projects[e] == projects[k]:
                e += 1
            v, a = project_lanes(device[k:e], start[k:e], duration[k:e], video[k:e], audio[k:e], channels[k:e], limits)
            pictures += v
            sounds += a
            k = e
        names = lambda letter, lanes: pa.array([f"{letter}{n:03d}" for n in range(max((n for n in lanes if n is not None), default=-1) + 1)], pa.string()).take(pa.array(lanes, pa.int32()))
        whole = lambda k: table.column(k).combine_chunks() if table.column(k).num_chunks != 1 else table.column(k).chunk(0)
        return pa.RecordBatch.from_arrays([whole(0), whole(1), names("V", pictures), names("A", sounds)], ["project_id", "id", "video_track_id", "audio_track_id"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        projects = batch.column(0).to_pylist()
        if held and held[-1].column(0)[-1].as_py() != projects[0]:
            yield told(held)
            held = []
        k = len(projects)
        while k and projects[k - 1] == projects[-1]:
            k -= 1
        if k:
            yield told([*held, batch.slice(0, k)])
            held = []
        held.append(batch.slice(k))
    if held:
        yield told(held)


def assign_lanes(clips: DataFrame, limits: TrackLimits | None = None) -> DataFrame:
    """(project_id, id, video_track_id, audio_track_id): devices with a picture first, then by start; pictures and sounds are packed apart.

    Clips: project_id, id, device, start, duration, video, audio, channels.
    First fit goes by order, so that a project is one task's; a task takes
    many projects one after the other, without a call for each.
    """
    limits = limits or TrackLimits()
    kinds = (("project_id", "string"), ("id", "string"), ("device", "string"), ("start", "double"), ("duration", "double"), ("video", "boolean"), ("audio", "boolean"), ("channels", "int"))
    rows = clips.select(*[F.col(c).cast(t).alias(c) for c, t in kinds])
    dealt = rows.repartition("project_id").sortWithinPartitions("project_id", F.asc_nulls_last("id"))
    return dealt.mapInArrow(lambda b: _lane_batches(limits, b), _LANES)


def track_order(clips: DataFrame, track: str) -> DataFrame:
    """(project_id, track, ordinal): tracks without pictures first, then by their first clip, then by name."""
    tracks = clips.groupBy("project_id", F.col(track).alias("track")).agg(F.max(F.col("has_video").cast("int")).alias("camera"), F.min("start_seconds").alias("first"))
    order = Window.partitionBy("project_id").orderBy("camera", "first", F.collate("track", "UNICODE"))
    return tracks.withColumn("ordinal", F.row_number().over(order)).select("project_id", "track", "ordinal")


def slots(clips: DataFrame) -> DataFrame:
    """Clip items: project_id, id, media, channel, track_index, clip_index, item_id. Sound has a lane for each channel of its track.

    Clips are timeline clips: project_id, id, video_track_id, audio_track_id,
    start_seconds, has_video, has_audio, audio_channels.
    """
    place = Window.partitionBy("project_id", "media", "track", "channel").orderBy("start_seconds", "id")
    video = clips.where("has_video").withColumn("track", F.col("video_track_id"))
    v = video.join(track_order(video, "track"), ["project_id", "track"]).withColumn("media", F.lit("video")).withColumn("channel", F.lit(None).cast("int")).withColumn("track_index", F.col("ordinal"))
    audio = clips.where("has_audio").withColumn("track", F.col("audio_track_id")).withColumn("own", F.coalesce("audio_channels", F.lit(2)))
    widths = audio.groupBy("project_id", "track").agg(F.greatest(F.lit(1), F.max("own")).alias("width")).join(track_order(audio, "track"), ["project_id", "track"])
    before = Window.partitionBy("project_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    widths = widths.withColumn("base", F.coalesce(F.sum("width").over(before), F.lit(0))).drop("ordinal")
    a = audio.join(widths, ["project_id", "track"]).withColumn("media", F.lit("audio")).withColumn("channel", F.explode(F.sequence(F.lit(1), F.greatest("own", F.lit(1))))).where("channel <= own").withColumn("track_index", (F.col("base") + F.col("channel")).cast("int"))
    columns = ["project_id", "id", "media", "track", "channel", "track_index", "start_seconds"]
    both = v.select(columns).unionByName(a.select(columns)).withColumn("clip_index", F.row_number().over(place))
    item = F.concat(F.lit("clipitem-"), id_slug(F.col("id")), F.lit("-"), F.when(F.col("media") == "video", F.lit("video")).otherwise(F.concat(F.lit("audio-"), F.col("channel").cast("string"))))
    return both.withColumn("item_id", item).select("project_id", "id", "media", "channel", "track_index", "clip_index", "item_id")


def links(items: DataFrame) -> DataFrame:
    """(project_id, id, links): all items of a clip, where it has several."""
    one = F.struct(F.when(F.col("media") == "video", 0).otherwise(1).alias("kind"), "track_index", "clip_index", "media", "item_id")
    return items.groupBy("project_id", "id").agg(F.array_sort(F.collect_list(one)).alias("links")).where(F.size("links") > 1)


def frame_size(clips: DataFrame) -> DataFrame:
    """(project_id, width, height): the commonest size of pictures, the larger of equals."""
    sizes = clips.where("has_video AND width > 0 AND height > 0").groupBy("project_id", "width", "height").agg(F.count("*").alias("n"))
    top = sizes.groupBy("project_id").agg(F.max(F.struct("n", (F.col("width") * F.col("height")).alias("area"), "width", "height")).alias("t"))
    return top.select("project_id", "t.width", "t.height")


def frame_rate(clips: DataFrame) -> DataFrame:
    """(project_id, label): the commonest known rate among column frame_rate, 25 without any; the first of equals by clip_index."""
    spark = clips.sparkSession
    rates = spark.createDataFrame([(k, label, r.fps) for k, (label, r) in enumerate(FRAME_RATES)], "ordinal int, label string, fps double")
    near = clips.where("frame_rate > 0").join(F.broadcast(rates), F.abs(F.col("frame_rate") - F.col("fps")) < 0.01)
    first = near.groupBy("project_id", "clip_index").agg(F.min(F.struct("ordinal", "label")).alias("r")).select("project_id", "clip_index", "r.label")
    counts = first.groupBy("project_id", "label").agg(F.count("*").alias("n"), F.min("clip_index").alias("seen"))
    best = counts.groupBy("project_id").agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"))
    return clips.select("project_id").distinct().join(best, "project_id", "left").select("project_id", F.coalesce("label", F.lit("25")).alias("label"))
