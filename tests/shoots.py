"""Made-up shoots with known offsets."""

import numpy as np

from chronoweave.sources.samples import FULL_RATE, on_board, part, talk  # noqa: F401

RATE = 2000.0


def speech(seconds: float, seed: int) -> np.ndarray:
    """Bursts of noise with pauses."""
    rng = np.random.default_rng(seed)
    n = int(seconds * RATE)
    lengths = rng.integers(60, 1200, n // 60)
    gate = np.repeat(np.where(rng.random(len(lengths)) > 0.45, rng.random(len(lengths)), 0), lengths)[:n]
    return rng.normal(size=n) * (gate + 0.01)


def clip(world: np.ndarray, start: float, seconds: float, seed: int, gain: float = 0.1, noise: float = 0.01) -> list[float]:
    """A worse recording of a part of it."""
    rng = np.random.default_rng(seed)
    x = world[int(start * RATE) : int((start + seconds) * RATE)]
    return (gain * (x + 0.3 * np.roll(x, 7)) + noise * rng.normal(size=len(x))).tolist()


def rows(specs, rate=RATE):
    """(index, id, device, samples, recorded_at, source, timecode) to clips."""
    return [("p", i, name, device, name, rate, samples, timecode, at, source, None) for i, (name, device, samples, at, source, timecode) in enumerate(specs)]
