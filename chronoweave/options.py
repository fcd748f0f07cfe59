"""All options and their defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class AlignOptions:
    """Rates are in Hz, all other quantities in seconds unless they say otherwise."""

    coarse_rate: float = 2000.0
    fine_rate: float = 48000.0
    refine_window: float = 0.25
    fine_segment: float = 15.0
    min_overlap: float = 3.0
    min_quality: float = 0.3
    min_psr: float = 6.0
    max_lag: float = math.inf
    envelope_frame: float = 0.04
    envelope_hop: float = 0.01
    envelope_fallback: bool = True
    use_timecode: bool = True


@dataclass(frozen=True)
class GateOptions:
    allow_same_device: bool = False
    by_recording_time: bool = True
    slop: float = 3600.0
    envelope_prefilter: bool = False
    prefilter_margin: float = 0.05


@dataclass(frozen=True)
class DriftOptions:
    rate: float = 8000.0
    windows: int = 12
    window: float = 4.0
    search: float = 0.5
    min_psr: float = 5.0
    report_r2: float = 0.8
    report_ppm: float = 1.0
    implausible_ppm: float = 500.0


@dataclass(frozen=True)
class SyncOptions:
    align: AlignOptions = field(default_factory=AlignOptions)
    gates: GateOptions = field(default_factory=GateOptions)
    drift: DriftOptions = field(default_factory=DriftOptions)
    detect_drift: bool = True
    preserve_clip_order: bool = True
    group_gap: float = 5.0
    tolerance: float = 0.02
    #: ``True`` folds lags at half the transform, as the original kernels do.
    compat: bool = False


@dataclass(frozen=True)
class TrackLimits:
    video: int = 4
    audio: int = 10


@dataclass(frozen=True)
class FrameRate:
    nominal: int = 25
    ntsc: bool = False
    drop_frame: bool = False

    @property
    def fps(self) -> float:
        return self.nominal * 1000 / 1001 if self.ntsc else float(self.nominal)


RATE_24, RATE_25, RATE_30 = FrameRate(24), FrameRate(25), FrameRate(30)
RATE_2997_DF, RATE_2997_NDF = FrameRate(30, True, True), FrameRate(30, True, False)
#: Rates by the names that editors use, in order of preference.
FRAME_RATES = (
    ("23.976", FrameRate(24, True)), ("24", RATE_24), ("25", RATE_25), ("29.97 DF", RATE_2997_DF), ("29.97 NDF", RATE_2997_NDF),
    ("30", RATE_30), ("50", FrameRate(50)), ("59.94", FrameRate(60, True)), ("60", FrameRate(60)),
)
