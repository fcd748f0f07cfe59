"""Frame counts and timecodes as columns. Rates are options.FrameRate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import FrameRate


def half_up(x: Column) -> Column:
    """Rounds halves up, below zero too."""
    return F.floor(x + F.lit(0.5))


def seconds_to_frames(seconds: Column, rate: FrameRate) -> Column:
    return half_up(seconds * F.lit(rate.fps))


def frames_to_seconds(frames: Column, rate: FrameRate) -> Column:
    return frames / F.lit(rate.fps)


def _dropped(rate: FrameRate) -> int:
    """Frame numbers left out in each minute but every tenth."""
    if not rate.drop_frame:
        return 0
    if rate.nominal not in (30, 60):
        raise ValueError(f"no drop-frame timecode at {rate.nominal} frames a second")
    return rate.nominal // 15


def frames_to_timecode(frames: Column, rate: FrameRate) -> Column:
    """HH:MM:SS:FF, with ; before the frames for drop-frame; a minus for counts below zero."""
    drop, n = _dropped(rate), F.lit(rate.nominal)
    size = F.abs(frames.cast("long"))
    if drop:
        minute, ten = rate.nominal * 60 - drop, rate.nominal * 600 - 9 * drop
        rest = size % ten
        extra = F.when(rest >= drop, F.floor((rest - drop) / minute)).otherwise(F.lit(0))
        size = size + drop * (9 * F.floor(size / ten) + extra)
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    whole = F.floor(size / n)
    clock = F.concat_ws(":", two(F.floor(whole / 3600)), two(F.floor(whole / 60) % 60), two(whole % 60))
    return F.concat(F.when(frames < 0, F.lit("-")).otherwise(F.lit("")), clock, F.lit(";" if drop else ":"), two(size % n))


_PATTERN = r"^(-?)(\d+)[:;](\d{1,2})[:;](\d{1,2})[:;.](\d{1,3})$"


def timecode_to_frames(text: Column, rate: FrameRate) -> Column:
    """The frame count of a timecode; null if it is none."""
    drop = _dropped(rate)
    part = lambda k: F.regexp_extract(text, _PATTERN, k)
    number = lambda k: F.nullif(part(k), F.lit("")).cast("long")
    minutes = number(2) * 60 + number(3)
    count = (minutes * 60 + number(4)) * rate.nominal + number(5) - drop * (minutes - F.floor(minutes / 10))
    return F.when(part(1) == "-", -count).otherwise(count)


def seconds_to_timecode(seconds: Column, rate: FrameRate) -> Column:
    return frames_to_timecode(seconds_to_frames(seconds, rate), rate)


def timecode_to_seconds(text: Column, rate: FrameRate) -> Column:
    return frames_to_seconds(timecode_to_frames(text, rate), rate)


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = half_up(F.greatest(seconds, F.lit(0.0)))
    hours, two = F.floor(s / 3600), lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(F.floor(s / 60) % 60), two(s % 60))).otherwise(F.concat_ws(":", F.floor(s / 60).cast("string"), two(s % 60)))


def pad_right(text: Column, width: int) -> Column:
    """Filled up with spaces, never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def pad_path(text: Column, width: int) -> Column:
    """Filled up, or cut at the front behind an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.lit("…"), F.right(text, F.lit(width - 1)))).otherwise(F.rpad(text, width, " "))


def bext_start(time_reference: Column, timecode_rate: Column, file_rate: Column) -> Column:
    """Seconds since midnight of a sample count, by the timecode's own rate or else the file's; null without a rate."""
    rate = F.coalesce(timecode_rate, file_rate)
    return F.when(rate > 0, time_reference / rate)


def origination_seconds(date: Column, time: Column) -> Column:
    """Seconds since the epoch of a broadcast-wave date and time, read as UTC; null unless they are real. A day past its month's end rolls on."""
    d = lambda k: F.nullif(F.regexp_extract(date, r"^(\d{4})[-:/](\d{2})[-:/](\d{2})", k), F.lit("")).cast("int")
    t = lambda k: F.nullif(F.regexp_extract(time, r"^(\d{2})[-:.](\d{2})[-:.](\d{2})", k), F.lit("")).cast("int")
    ok = d(1).between(1990, 2200) & d(2).between(1, 12) & d(3).between(1, 31) & (t(1) < 24) & (t(2) < 60) & (t(3) < 60)
    day = F.date_add(F.make_date(F.when(ok, d(1)), d(2), F.lit(1)), d(3) - 1)
    return F.when(ok, F.unix_date(day) * 86400.0 + t(1) * 3600 + t(2) * 60 + t(3))
