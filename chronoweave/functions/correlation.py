"""Kernels on pairs of signals, in NumPy.

A positive offset puts the second signal's first sample that much after the
first one's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .signal import decimate, decimation_factor, next_pow2


@dataclass(frozen=True)
class Peak:
    offset: float
    offset_int: int
    peak: float
    psr: float


def cross_correlation(a: np.ndarray, b: np.ndarray, phat: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(lags, values) over all lags from -(len(b) - 1) to len(a) - 1, phase-weighted by ``phat``."""
    n = next_pow2(len(a) + len(b))
    r = np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
    if phat:
        r = r / (np.abs(r) + 1e-12) ** phat
    full = np.fft.irfft(r, n)
    lags = np.arange(-(len(b) - 1), len(a))
    return lags, full[lags]


def phase_peak(a: np.ndarray, b: np.ndarray, max_lag: float | None = None, phat: float = 1.0, exclusion: int = 5, compat: bool = False) -> Peak:
    """The best lag by phase-transform correlation, between samples, and its ratio to the RMS of all other lags.

    Lags run over the whole transform, so that the ratio is over as many; they
    decode to a signal's own length. ``compat`` decodes them at half the
    transform, which folds long lags over.
    """
    if not len(a) or not len(b):
        return Peak(0.0, 0, 0.0, 0.0)
    n = next_pow2(len(a) + len(b))
    r = np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
    if phat:
        r = r / (np.abs(r) + 1e-12) ** phat
    v = np.fft.irfft(r, n)
    k = np.arange(n)
    lags = np.where(k < (n // 2 if compat else len(a)), k, k - n)
    limit = n // 2 - 1 if compat and max_lag is None else max_lag
    free = np.ones(n, bool) if limit is None else np.abs(lags) <= limit
    best = int(np.argmax(np.where(free, v, -np.inf)))
    top, left, right = v[best], v[best - 1], v[(best + 1) % n]
    bend = left - 2 * top + right
    part = 0.5 * (left - right) / bend if bend else 0.0
    near = np.abs((k - best + n // 2) % n - n // 2) <= exclusion
    rest = v[free & ~near]
    side = float(np.sqrt(np.mean(rest * rest))) if len(rest) else 0.0
    return Peak(float(lags[best] + (part if abs(part) <= 1 else 0.0)), int(lags[best]), float(top), float(top / side) if side > 0 else float("inf"))


def round_half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def pearson_at(a: np.ndarray, b: np.ndarray, offset: float) -> tuple[float, int]:
    """(r, samples) over the overlap at a whole offset; r is 0 without variance."""
    o = round_half_up(offset)
    start, end = max(0, o), min(len(a), len(b) + o)
    n = end - start
    if n <= 1:
        return 0.0, max(0, n)
    x, y = a[start:end] - a[start:end].mean(), b[start - o : end - o] - b[start - o : end - o].mean()
    scale = float(np.sqrt((x @ x) * (y @ y)))
    return (float(x @ y) / scale if scale > 0 else 0.0), n


def best_pearson(a: np.ndarray, b: np.ndarray, min_overlap: int) -> tuple[float, int, int]:
    """(r, lag, samples) of the highest correlation at any lag with enough overlap; zeros if there is none."""
    m = max(2, min_overlap)
    if len(a) < m or len(b) < m:
        return 0.0, 0, 0
    lags, cross = cross_correlation(a, b)
    start, end = np.maximum(0, lags), np.minimum(len(a), len(b) + lags)
    ok = end - start >= m
    lags, cross, start, end = lags[ok], cross[ok], start[ok], end[ok]
    sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    n = end - start
    pa, pa2, pb, pb2 = sums(a), sums(a * a), sums(b), sums(b * b)
    sx, sx2 = pa[end] - pa[start], pa2[end] - pa2[start]
    sy, sy2 = pb[end - lags] - pb[start - lags], pb2[end - lags] - pb2[start - lags]
    dx, dy = sx2 - sx * sx / n, sy2 - sy * sy / n
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.where((dx > 0) & (dy > 0), (cross - sx * sy / n) / np.sqrt(dx * dy), -np.inf)
    k = int(np.argmax(r)) if len(r) else 0
    return (float(r[k]), int(lags[k]), int(n[k])) if len(r) and np.isfinite(r[k]) else (0.0, 0, 0)


def resample(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """Linear resampling onto another rate."""
    if abs(rate - to) < 1e-9 or not len(x):
        return x
    return np.interp(np.arange(int(len(x) * to / rate)) * (rate / to), np.arange(len(x)), x)


@dataclass(frozen=True)
class Piece:
    """A span of samples on a common fine grid, and the native samples that it takes: ``pad`` outputs more at each end for the filter."""

    factor: int
    rate: float
    start: int
    end: int

    @property
    def pad(self) -> int:
        return 0 if self.factor == 1 else 48

    @property
    def native(self) -> tuple[int, int]:
        return (self.start - self.pad) * self.factor, (self.end + self.pad) * self.factor

    def cut(self, samples: np.ndarray, first: int, dc: float) -> np.ndarray:
        """The span from native samples that begin at ``first``; beyond the clip's ends there is silence."""
        low, high = self.native
        x = np.zeros(high - low)
        x[max(0, first - low) : max(0, first - low) + len(samples)] = samples[max(0, low - first) :][: high - low - max(0, first - low)] - dc
        return decimate(x, self.factor)[self.pad : self.pad + self.end - self.start] if self.factor > 1 else x


def refine_spans(n_a: int, n_b: int, rate_a: float, rate_b: float, offset: float, fine_rate: float, segment: float, window: float) -> tuple[Piece, Piece] | None:
    """The pieces that make a coarse offset (s) exact: one in the middle of the overlap, and its counterpart with some room. None if the grids differ or too little is left."""
    target = min(rate_a, rate_b, fine_rate)
    fa, fb = decimation_factor(rate_a, target), decimation_factor(rate_b, target)
    rate = rate_a / fa
    if abs(rate - rate_b / fb) > 1e-6:
        return None
    na, nb, o = n_a // fa, n_b // fb, round_half_up(offset * rate)
    start, end = max(0, o), min(na, nb + o)
    if end - start < rate:
        return None
    size = min(end - start, round_half_up(segment * rate))
    at = min(max(start, round_half_up((start + end) / 2 - size / 2)), end - size)
    w = round_half_up(window * rate)
    low, high = max(0, at - o - w), min(nb, at - o + size + w)
    return None if high - low < size / 2 else (Piece(fa, rate, at, at + size), Piece(fb, rate, low, high))


def drift_spans(n_a: int, n_b: int, rate_a: float, rate_b: float, offset: float, target: float, windows: int, window: float, search: float) -> list[tuple[Piece, Piece]]:
    """Pieces of windows spread over the overlap, each with its counterpart; none if two windows don't fit."""
    fa, fb = decimation_factor(rate_a, target), decimation_factor(rate_b, target)
    rate, na, nb = rate_a / fa, n_a // fa, n_b // fb
    o = offset * rate
    start, end = max(0.0, o), min(na, nb + o)
    size, reach = round_half_up(window * rate), round_half_up(search * rate)
    if size < 1 or end - start <= 2 * size:
        return []
    n, out = max(3, min(windows, int((end - start) // size))), []
    for i in range(n):
        at = round_half_up(start + (end - start - size) * i / (n - 1))
        want = round_half_up(at - o)
        low, high = max(0, want - reach), min(nb, want + size + reach)
        if at + size <= na and high - low >= size:
            out.append((Piece(fa, rate, at, at + size), Piece(fb, rate, low, high)))
    return out


def fit_drift(samples: list[tuple[float, float]]) -> tuple[float, float, float]:
    """(ppm, r2, total slip in seconds) by least squares; zeros for fewer than three samples.

    Positive ppm: the second clip's content comes progressively later, and its
    offset falls.
    """
    if len(samples) < 3:
        return 0.0, 0.0, 0.0
    t, y = np.array(samples, dtype=float).T
    dt, dy = t - t.mean(), y - y.mean()
    slope = float(dt @ dy / (dt @ dt)) if dt @ dt > 0 else 0.0
    total = float(dy @ dy)
    rest = dy - slope * dt
    return -slope * 1e6, (1 - float(rest @ rest) / total if total > 0 else 0.0), slope * float(t[-1] - t[0])
