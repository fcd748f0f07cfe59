"""Signals that come in blocks, decimated as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.signal import StreamingDecimator

_OUT = "clip_id string, start_sample long, samples array<double>"
_STATE = "held array<double>, start long, seen long, next long, expected long, out long"


class _Decimate(StatefulProcessor):
    """State of a clip: the last filter length of samples. Blocks are numbered and must come in order within a clip."""

    def __init__(self, factor: int):
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decimator", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held, start, seen, nxt, expected, out = self.state.get()
            steps = StreamingDecimator.from_state(self.factor, (held, start, seen, nxt))
        else:
            steps, expected, out = StreamingDecimator(self.factor), 0, 0
        blocks = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.block)
        made = []
        for r in blocks:
            if r.block < expected:
                continue  # a block that has come before
            if r.block > expected:
                raise ValueError(f"clip {key[0]}: block {r.block} came before block {expected}")
            expected += 1
            made.append(steps.push(np.asarray(r.samples, dtype=float)))
            if r.last:
                made.append(steps.flush())
        y = np.concatenate(made) if made else np.zeros(0)
        self.state.update((*steps.state(), expected, out + len(y)))
        if len(y):
            yield pd.DataFrame({"clip_id": [key[0]], "start_sample": [out], "samples": [y.tolist()]})

    def close(self) -> None:
        pass


def decimate_stream(blocks: DataFrame, factor: int) -> DataFrame:
    """A stream of (clip_id, block, samples, last) at a ``factor``-th of its rate: equal to the decimation of the whole signal."""
    return blocks.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=_Decimate(factor), outputStructType=_OUT, outputMode="append", timeMode="none")
