"""Kernels on one sampled signal, in NumPy. Signals are float64 arrays."""

from __future__ import annotations

import numpy as np


def next_pow2(n: int) -> int:
    """The least power of two that is at least ``n``, 1 for less than 1."""
    return 1 << max(0, int(n) - 1).bit_length()


def decimation_factor(rate: float, target: float) -> int:
    return max(1, int(rate // target))


def working_rate(rate: float, frames: int, target: float = 16000.0, budget: int = 120_000_000) -> tuple[int, float]:
    """(factor, rate): decimation to about ``target``, and further while the samples go over ``budget`` and the rate stays at 1 kHz or more."""
    factor = max(decimation_factor(rate, target), min(-(-int(frames) // budget), int(rate // 1000)))
    return factor, rate / factor


def lowpass_taps(cutoff: float, taps: int) -> np.ndarray:
    """A Blackman-windowed sinc of odd length and unit gain at 0; ``cutoff`` in cycles per sample."""
    taps |= 1
    k = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * k) * np.blackman(taps) if taps > 1 else np.ones(1)
    return h / h.sum()


def decimation_taps(factor: int) -> np.ndarray:
    return lowpass_taps(0.45 / factor, min(511, max(31, 16 * factor + 1)))


def fir(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Centred convolution, zeros beyond the ends; as long as ``x``."""
    if not len(x):
        return np.zeros(0)
    d = (len(h) - 1) // 2
    return np.convolve(x, h)[d : d + len(x)]


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Low-pass, then every ``factor``-th sample: floor(n / factor) of them."""
    if factor <= 1:
        return np.array(x, dtype=float)
    return fir(x, decimation_taps(factor))[::factor][: len(x) // factor]


def remove_dc(x: np.ndarray) -> np.ndarray:
    return x - x.mean() if len(x) else np.zeros(0)


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0


def normalise_rms(x: np.ndarray) -> np.ndarray:
    """Unit RMS; silence stays as it is."""
    level = rms(x)
    return x / level if level > 0 else np.array(x, dtype=float)


def log_energy(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Level in dB of windows of ``frame`` samples every ``hop``, by running sums."""
    if len(x) < frame:
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(np.square(x))])
    at = np.arange((len(x) - frame) // hop + 1) * hop
    return 10 * np.log10(np.maximum(total[at + frame] - total[at], 0) / frame + 1e-10)


def to_mono(interleaved: np.ndarray, channels: int) -> np.ndarray:
    frames = len(interleaved) // channels
    return interleaved[: frames * channels].reshape(frames, channels).mean(axis=1)


def peak_summary(x: np.ndarray, buckets: int = 400) -> np.ndarray:
    """The largest magnitude in each of ``buckets`` equal spans, over the largest of all."""
    out = np.zeros(buckets)
    if len(x):
        edges = np.floor(np.arange(buckets + 1) * (len(x) / buckets)).astype(int)
        edges[-1] = len(x)
        size = np.abs(x)
        for k in np.flatnonzero(np.diff(edges)):
            out[k] = size[edges[k] : edges[k + 1]].max()
    top = out.max()
    return out / top if top > 0 else out


class StreamingDecimator:
    """:func:`decimate` of a signal that comes in blocks; keeps a filter length of samples."""

    def __init__(self, factor: int):
        self.factor = factor
        self.h = decimation_taps(factor) if factor > 1 else np.ones(1)
        self.d = (len(self.h) - 1) // 2
        self.held = np.zeros(self.d)  # zeros stand before the signal
        self.start = -self.d  # the place of held[0] in the signal
        self.seen = 0
        self.next = 0  # the place of the next output's centre

    def state(self) -> tuple[list[float], int, int, int]:
        return self.held.tolist(), self.start, self.seen, self.next

    @classmethod
    def from_state(cls, factor: int, state) -> StreamingDecimator:
        out = cls(factor)
        held, out.start, out.seen, out.next = state
        out.held = np.array(held, dtype=float)
        return out

    def _emit(self, until: int) -> np.ndarray:
        """Outputs whose centres lie before ``until``."""
        count = max(0, -(-(until - self.next) // self.factor))
        if not count:
            return np.zeros(0)
        first = self.next - self.d - self.start
        windows = np.lib.stride_tricks.sliding_window_view(self.held, len(self.h))[first :: self.factor][:count]
        out = windows @ self.h[::-1]
        self.next += count * self.factor
        drop = self.next - self.d - self.start
        if drop > 0:
            self.held, self.start = self.held[drop:], self.start + drop
        return out

    def push(self, block: np.ndarray) -> np.ndarray:
        self.held = np.concatenate([self.held, block])
        self.seen += len(block)
        return self._emit(self.seen - self.d)

    def flush(self) -> np.ndarray:
        """The rest of the floor(n / factor) outputs."""
        self.held = np.concatenate([self.held, np.zeros(len(self.h))])
        return self._emit((self.seen // self.factor) * self.factor)
