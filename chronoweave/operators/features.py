"""Features of clips, and signals in chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.correlation import round_half_up
from ..functions.signal import decimate, decimation_factor, log_energy, normalise_rms, remove_dc
from ..options import AlignOptions
from ..schemas import PREPARED

#: Samples of a chunk: 4 MB.
CHUNK = 1 << 19


def trusted_time(source: Column, seconds: Column) -> Column:
    """Only a finite time that the file itself carried counts."""
    finite = ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when((source == "metadata") & finite, seconds)


def to_chunks(clips: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(project_id, clip_id, chunk_idx, start_sample, samples) of inline signals."""
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("samples") / chunk) - 1).cast("int")),
        lambda k: F.struct(k.alias("chunk_idx"), (k.cast("long") * chunk).alias("start_sample"), F.slice("samples", (k * chunk + 1).cast("int"), F.lit(chunk)).alias("samples")),
    )
    return clips.select("project_id", "clip_id", F.explode(parts).alias("c")).select("project_id", "clip_id", "c.*")


def _prepare(opts: AlignOptions, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            x = np.asarray(r.samples if r.samples is not None else [], dtype=float)
            dc, mono = float(x.mean()) if len(x) else 0.0, remove_dc(x)
            factor = decimation_factor(r.sample_rate, opts.coarse_rate)
            frame, hop = max(2, round_half_up(opts.envelope_frame * r.sample_rate)), max(1, round_half_up(opts.envelope_hop * r.sample_rate))
            rows.append((
                r.project_id, r.clip_index, r.clip_id, r.track_id, r.sample_rate, len(x), len(x) / r.sample_rate, dc, r.timecode_seconds, r.trusted_at,
                normalise_rms(decimate(mono, factor)), r.sample_rate / factor, remove_dc(log_energy(mono, frame, hop)), r.sample_rate / hop,
            ))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PREPARED.split(", ")])


def prepare(clips: DataFrame, opts: AlignOptions | None = None) -> DataFrame:
    """Each clip once: a waveform at about 2 kHz and a log-energy envelope at 100 Hz. Only what a pair needs to be found, not the signal, goes on."""
    opts = opts or AlignOptions()
    slim = clips.select(
        "project_id", "clip_index", "clip_id", "track_id", "sample_rate", "samples", "timecode_seconds",
        trusted_time(F.col("recorded_at_source"), F.col("recorded_at_seconds")).alias("trusted_at"),
    )
    return slim.mapInPandas(lambda it: _prepare(opts, it), PREPARED)


def prepare_chunks(clips: DataFrame, chunks: DataFrame, opts: AlignOptions | None = None) -> DataFrame:
    """:func:`prepare` of clips whose signals are in chunks (schemas.SIGNAL_CHUNKS): a task holds one clip at a time. A clip without chunks has no samples."""
    opts = opts or AlignOptions()
    slim = clips.select(
        "project_id", "clip_index", "clip_id", "track_id", "sample_rate", "timecode_seconds", trusted_time(F.col("recorded_at_source"), F.col("recorded_at_seconds")).alias("trusted_at"),
    )
    keys = ["project_id", "clip_id"]

    def run(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        whole = np.concatenate([np.zeros(0), *parts.sort_values("chunk_idx").samples])
        frames = _prepare(opts, iter([own.assign(samples=[whole] * len(own))])) if len(own) else iter(())
        return next(frames, pd.DataFrame(columns=[c.split()[0] for c in PREPARED.split(", ")]))

    parts = chunks.select(*keys, "chunk_idx", "samples")
    return slim.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInPandas(run, PREPARED)


def fetch(requests: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Native samples of spans of clips, from only the chunks that they touch.

    ``requests`` has project_id, clip_id, key, low and high (samples, high
    exclusive; they may reach beyond the clip). Returns key, first (the place
    of the first sample) and samples.
    """
    last = F.greatest(F.col("low"), F.col("high") - 1)
    wanted = requests.withColumn("chunk_idx", F.explode(F.sequence((F.greatest(F.col("low"), F.lit(0)) / chunk).cast("int"), (F.greatest(last, F.lit(0)) / chunk).cast("int"))))
    found = wanted.join(chunks, ["project_id", "clip_id", "chunk_idx"])
    begin = F.greatest(F.col("low"), F.col("start_sample"))
    part = F.slice("samples", (begin - F.col("start_sample") + 1).cast("int"), F.greatest(F.lit(0), F.least(F.col("high") - begin, F.lit(chunk))).cast("int"))
    cut = found.select("project_id", "key", F.struct(begin.alias("at"), part.alias("x")).alias("piece"))
    gathered = cut.groupBy("project_id", "key").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return gathered.select("project_id", "key", F.get(F.col("pieces.at"), F.lit(0)).alias("first"), F.flatten(F.col("pieces.x")).alias("samples"))


def envelope_table(signal: DataFrame, frame: int, hop: int) -> DataFrame:
    """Log-energy of sliding windows of a signal in rows (clip_id, i, x), as ordered windows."""
    ahead = Window.partitionBy("clip_id").orderBy("i").rowsBetween(0, frame - 1)
    level = 10 * F.log10(F.avg(F.col("x") * F.col("x")).over(ahead) + 1e-10)
    rows = signal.withColumn("level", level).withColumn("n", F.count("*").over(Window.partitionBy("clip_id")))
    return rows.where((F.col("i") % hop == 0) & (F.col("i") + frame <= F.col("n"))).select("clip_id", (F.col("i") / hop).cast("long").alias("k"), "level")


def level_table(signal: DataFrame) -> DataFrame:
    """(clip_id, i, x) with the mean removed and unit RMS; silence stays."""
    clip = Window.partitionBy("clip_id")
    free = signal.withColumn("x", F.col("x") - F.avg("x").over(clip))
    loud = F.sqrt(F.avg(F.col("x") * F.col("x")).over(clip))
    return free.withColumn("x", F.when(loud > 0, F.col("x") / loud).otherwise(F.col("x")))


def peaks_table(signal: DataFrame, buckets: int) -> DataFrame:
    """(clip_id, bucket, peak): the largest magnitude of each span, over the clip's largest."""
    clip = Window.partitionBy("clip_id")
    spans = signal.withColumn("bucket", F.floor(F.col("i") * buckets / F.count("*").over(clip))).groupBy("clip_id", "bucket").agg(F.max(F.abs("x")).alias("peak"))
    top = F.max("peak").over(clip)
    return spans.withColumn("peak", F.when(top > 0, F.col("peak") / top).otherwise(F.col("peak")))


def fir_table(signal: DataFrame, taps: list[float], factor: int) -> DataFrame:
    """(clip_id, k, y): a centred filter, then every ``factor``-th sample, floor(n / factor) of them."""
    d = (len(taps) - 1) // 2
    h = signal.sparkSession.createDataFrame([(m, float(v)) for m, v in enumerate(taps)], "m int, h double")
    sizes = signal.groupBy("clip_id").agg(F.max("i").alias("last"))
    spread = signal.join(F.broadcast(h)).withColumn("o", F.col("i") - d + F.col("m"))
    out = spread.where((F.col("o") >= 0) & (F.col("o") % factor == 0)).groupBy("clip_id", (F.col("o") / factor).cast("long").alias("k")).agg(F.sum(F.col("x") * F.col("h")).alias("y"))
    return out.join(sizes, "clip_id").where(F.col("k") < F.floor((F.col("last") + 1) / factor)).select("clip_id", "k", "y")
