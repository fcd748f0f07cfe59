"""Folders of recordings as tables: files, headers, and signals in chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.containers import Bytes, FormatError, LocalFile, probe, read_wav, stream_mono
from ..functions.signal import StreamingDecimator, working_rate
from ..functions.text import is_media
from ..functions.timecode import origination_seconds
from ..operators.features import CHUNK

PROBES = (
    "path string, kind string, sample_rate double, channels int, duration_seconds double, timecode_seconds double, timecode_source string, frame_rate double, origination_date string, origination_time string, "
    "channel_names array<string>, tags map<string,string>, has_audio boolean, has_video boolean, decodable boolean, reason string"
)
_NAMES = [c.split()[0] for c in PROBES.replace("map<string,string>", "map").split(", ")]


def find_media(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of media files below a folder; contents are not read, hidden files and folders are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    rows = files.select("path", F.col("length").alias("size"), (F.unix_millis("modificationTime")).alias("modified"))
    return rows.where(is_media(F.col("path")) & ~F.col("path").rlike(r"/\.[^/]+"))


def _source(path: str, content: bytes | None):
    if content is not None:
        return Bytes(content)
    return LocalFile("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def probe_files(files: DataFrame) -> DataFrame:
    """Headers of files (path, and content if it is at hand): a row each, ``decodable`` false with a reason where one can't be read."""
    held = "content" in files.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    found = probe(_source(r.path, r.content if held else None), r.path)
                except (FormatError, OSError, ValueError) as e:
                    found = {"kind": "broken", "has_audio": False, "has_video": False, "decodable": False, "reason": str(e)}
                rows.append([r.path, *[found.get(n) for n in _NAMES[1:]]])
            yield pd.DataFrame(rows, columns=_NAMES)

    found = files.select("path", *(["content"] if held else [])).mapInPandas(run, PROBES)
    return found.withColumn("recorded_at_seconds", origination_seconds(F.col("origination_date"), F.col("origination_time"))).withColumn("recorded_at_source", F.when(F.col("recorded_at_seconds").isNotNull(), "metadata"))


def failures(probes: DataFrame) -> DataFrame:
    """Files that cannot take part, and why."""
    return probes.where("NOT (has_audio AND decodable)").select("path", F.coalesce("reason", F.lit("no sound")).alias("reason"))


def read_signals(files: DataFrame, target: float = 16000.0, budget: int = 120_000_000, chunk: int = CHUNK, decoder: Callable | None = None) -> DataFrame:
    """(path, sample_rate, chunk_idx, start_sample, samples): sound brought to about ``target`` Hz block by block.

    A task holds one block and one chunk, whatever a file's length. Files that
    can't be read give no rows; see :func:`failures`. ``decoder(path)`` may
    give (rate, frames, blocks) for other formats.
    """
    held = "content" in files.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                try:
                    src = _source(r.path, r.content if held else None)
                    wav = read_wav(src)
                    rate, total, blocks = wav.sample_rate, wav.frames, stream_mono(src, wav)
                except (FormatError, OSError):
                    if decoder is None:
                        continue
                    rate, total, blocks = decoder(r.path)
                factor, out_rate = working_rate(rate, total, target, budget)
                steps, held_back, at = StreamingDecimator(factor), np.zeros(0), 0
                for block in _with_end(blocks):
                    held_back = np.concatenate([held_back, steps.flush() if block is None else steps.push(block)])
                    while len(held_back) >= chunk or (block is None and len(held_back)):
                        part, held_back = held_back[:chunk], held_back[chunk:]
                        yield pd.DataFrame([(r.path, out_rate, at // chunk, at, part)], columns=["path", "sample_rate", "chunk_idx", "start_sample", "samples"])
                        at += len(part)

    return files.select("path", *(["content"] if held else [])).mapInPandas(run, "path string, sample_rate double, chunk_idx int, start_sample long, samples array<double>")


def _with_end(blocks) -> Iterator:
    yield from blocks
    yield None


class WavDataSource(DataSource):
    """``spark.read.format("wav").load(path)``: a file by ranges of frames, for files beyond what one task should hold.

    Option ``frames`` is the number of frames of a partition. Register it with
    ``spark.dataSource.register(WavDataSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, sample_rate double, start_frame long, samples array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(self.options["path"], int(self.options.get("frames", 1 << 20)))


class _WavReader(DataSourceReader):
    def __init__(self, path: str, frames: int):
        self.path, self.frames = path, frames

    def partitions(self) -> list[InputPartition]:
        wav = read_wav(_source(self.path, None))
        return [InputPartition(f) for f in range(0, max(wav.frames, 1), self.frames)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        src = _source(self.path, None)
        wav = read_wav(src)
        start, count = partition.value, min(self.frames, wav.frames - partition.value)
        wav.data_offset += start * wav.block_align
        wav.data_length = count * wav.block_align
        for block in stream_mono(src, wav, self.frames):
            yield self.path, float(wav.sample_rate), start, block.tolist()


def write_wav(samples: np.ndarray, rate: int, bits: int = 16, channels: int = 1) -> bytes:
    """PCM bytes of a mono signal on all channels, for fixtures and samples."""
    import struct

    scaled = np.clip(np.round(samples * (2 ** (bits - 1) - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype("<i4")
    raw = scaled.view(np.uint8).reshape(-1, 4)[:, : bits // 8] if bits > 8 else (scaled + 128).astype(np.uint8).reshape(-1, 1)
    body = np.repeat(raw[:, None, :], channels, axis=1).tobytes()
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * align, align, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body
