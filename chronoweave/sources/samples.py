"""Made-up shoots: several devices that record one scene, with known starts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import CHUNK
from ..schemas import SIGNAL_CHUNKS

#: Samples a second of the sample shoots.
FULL_RATE = 16000.0


def talk(seconds: float, seed: int) -> np.ndarray:
    """Voiced bursts with hard onsets that die away, a third of them silent: three harmonics and smoothed noise, at 16 kHz."""
    rng, out = np.random.default_rng(seed), np.zeros(int(seconds * FULL_RATE))
    at = 0
    while at < len(out):
        n = min(len(out) - at, int(rng.uniform(0.08, 0.53) * FULL_RATE))
        if rng.random() > 0.35:
            t = np.arange(n) / FULL_RATE
            fall = np.minimum(1, t / 0.004) * np.exp(-3 * np.arange(n) / n)
            voice = sum(g * np.sin(2 * np.pi * k * rng.uniform(90, 250) * t) for k, g in ((1, 0.5), (2, 0.25), (3, 0.12)))
            hiss = np.convolve(rng.uniform(-1, 1, n + 4), np.full(5, 0.2), "valid")
            out[at : at + n] = rng.uniform(0.2, 1) * fall * (0.55 * voice + 0.45 * hiss)
        at += n
    return out


def on_board(x: np.ndarray, seed: int) -> list[float]:
    """What a camera's own microphone makes of it: reflections, 250 Hz to 5 kHz, 26 dB down, noise."""
    rng, out = np.random.default_rng(seed), x.copy()
    for _ in range(6):
        delay = int(rng.uniform(0.005, 0.055) * FULL_RATE)
        out[delay:] += rng.uniform(0.1, 0.4) * x[:-delay]
    f = np.fft.rfftfreq(len(out), 1 / FULL_RATE)
    spectrum = np.fft.rfft(out) / np.sqrt((1 + (250 / np.maximum(f, 1e-3)) ** 2) * (1 + (f / 5000) ** 2))
    return (0.05 * np.fft.irfft(spectrum, len(out)) + rng.uniform(-0.004, 0.004, len(out))).tolist()


def part(world: np.ndarray, start: float, seconds: float) -> np.ndarray:
    return world[int(start * FULL_RATE) : int((start + seconds) * FULL_RATE)]


#: Seconds after which the next device of a take begins.
STAGGER = 7.5


def sample_shoot(spark: SparkSession, devices: int = 4, takes: int = 5, seconds: float = 120.0, span: float = 10_800.0, seed: int = 1, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(clips, chunks): each device records each take, the takes spread over ``span`` seconds.

    The first device records the sound itself, the others as a camera does.
    Clips are as in schemas.CLIPS, without samples and with their true start;
    their recording times count. Signals are made by the tasks, a clip each.
    """
    gap = span / max(takes - 1, 1)
    specs = [(t * devices + d, t, d, t * gap + STAGGER * d) for t in range(takes) for d in range(devices)]
    clips = spark.createDataFrame(specs, "clip_index int, take int, device int, start double").select(
        F.lit("shoot").alias("project_id"), "clip_index", F.format_string("take%d-dev%d", "take", "device").alias("clip_id"), F.format_string("DEV%d", "device").alias("track_id"), F.format_string("take%d-dev%d", "take", "device").alias("name"),
        F.lit(FULL_RATE).alias("sample_rate"), F.lit(None).cast("double").alias("timecode_seconds"), F.col("start").alias("recorded_at_seconds"), F.lit("metadata").alias("recorded_at_source"), F.lit(None).cast("double").alias("frame_rate"), "take", "device", "start",
    )

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                own = part(talk(seconds + STAGGER * devices, seed * 1000 + r.take), STAGGER * r.device, seconds)
                x = np.asarray(on_board(own, r.clip_index) if r.device else own)
                for k, at in enumerate(range(0, len(x), chunk)):
                    yield pd.DataFrame([(r.project_id, r.clip_id, k, at, x[at : at + chunk])], columns=["project_id", "clip_id", "chunk_idx", "start_sample", "samples"])

    rows = clips.select("project_id", "clip_id", "clip_index", "take", "device").repartition(devices * takes, "clip_index")
    return clips, rows.mapInPandas(make, SIGNAL_CHUNKS)
