"""Readers of recording formats from a byte source: ``read(start, end)`` and ``size``."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .text import AUDIO


class FormatError(ValueError):
    """The bytes are not what they claim to be; kept as data, a row of failures."""


class Bytes:
    """Bytes in memory as a source."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, start: int, end: int) -> bytes:
        return self.data[max(0, start) : max(0, end)]


class LocalFile:
    """A file as a source; only the ranges asked for are read."""

    def __init__(self, path: str):
        import os

        self.file, self.size = open(path, "rb"), os.path.getsize(path)

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, end - start))

    def close(self) -> None:
        self.file.close()


def c_string(raw: bytes) -> str:
    """Latin-1 up to the first NUL, trimmed."""
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


# --- RIFF / WAVE --------------------------------------------------------------------------------------------

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Wav:
    sample_rate: int
    channels: int
    bits: int
    is_float: bool
    block_align: int
    data_offset: int
    data_length: int
    bext: bytes | None = None
    ixml: str | None = None
    info: dict[str, str] = field(default_factory=dict)
    rf64: bool = False

    @property
    def frames(self) -> int:
        return self.data_length // self.block_align

    @property
    def duration(self) -> float:
        return self.frames / self.sample_rate


def is_wav(head: bytes) -> bool:
    return head[:4] in (b"RIFF", b"RF64") and head[8:12] == b"WAVE"


def _format(body: bytes) -> tuple[int, int, int, bool, int]:
    if len(body) < 16:
        raise FormatError("fmt chunk is too short")
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", body)
    if tag == EXTENSIBLE:
        tag = struct.unpack_from("<H", body, 24)[0] if len(body) >= 26 else PCM
    if tag not in (PCM, FLOAT):
        raise FormatError(f"format tag 0x{tag:x} is neither PCM nor float")
    if not (channels and rate and bits):
        raise FormatError("fmt chunk has no channels, rate or depth")
    return rate, channels, bits, tag == FLOAT, align or -(-bits * channels // 8)


def _info(body: bytes) -> dict[str, str]:
    if body[:4] != b"INFO":
        return {}
    out, at = {}, 4
    while at + 8 <= len(body):
        name, size = body[at : at + 4].decode("latin-1"), struct.unpack_from("<I", body, at + 4)[0]
        if at + 8 + size > len(body):
            break
        out[name] = c_string(body[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def chunks_of(src) -> Iterator[tuple[bytes, int, int | None]]:
    """(id, start, size) of a RIFF file's chunks; size None where the field holds no size. Bodies are padded to even lengths."""
    at = 12
    while at + 8 <= src.size:
        name, size = struct.unpack("<4sI", src.read(at, at + 8))
        known = None if size == 0xFFFFFFFF else size
        got = yield name, at + 8, known
        known = got if got is not None else known
        if known is None:
            return
        at += 8 + known + known % 2


def read_wav(src) -> Wav:
    """Headers of a WAVE file, RF64 too; the samples stay where they are. A data size beyond the file is cut to it."""
    if src.size < 12 or not is_wav(src.read(0, 12)):
        raise FormatError("not a RIFF/WAVE file")
    fmt, data, long_size, parts = None, None, None, {}
    walk = chunks_of(src)
    item = next(walk, None)
    while item is not None:
        name, at, size = item
        send = None
        if name == b"ds64":
            long_size = struct.unpack_from("<Q", src.read(at, at + 28), 8)[0]
        elif name == b"fmt ":
            fmt = _format(src.read(at, at + min(size or 40, 40)))
        elif name == b"data":
            rest = src.size - at
            length = min(size if size is not None else long_size if long_size is not None else rest, rest)
            data, send = (at, length), length
        elif size and name in (b"bext", b"iXML", b"LIST"):
            parts[name] = src.read(at, at + size)
        try:
            item = walk.send(send)
        except StopIteration:
            item = None
    if fmt is None or data is None:
        raise FormatError("no fmt chunk" if fmt is None else "no data chunk")
    ixml = parts[b"iXML"].decode("utf-8", "replace").rstrip("\0") if b"iXML" in parts else None
    return Wav(*fmt, *data, bext=parts.get(b"bext"), ixml=ixml, info=_info(parts.get(b"LIST", b"")), rf64=src.read(0, 4) == b"RF64")


def decode(raw: bytes, bits: int, is_float: bool, channels: int, align: int) -> np.ndarray:
    """Frames as mono, from -1 to 1: the channels' mean."""
    frames = len(raw) // align
    body = np.frombuffer(raw, np.uint8, frames * align).reshape(frames, align)
    width = bits // 8
    if width < 1 or channels * width > align:
        raise FormatError(f"depth of {bits} bits is not supported")
    part = np.ascontiguousarray(body[:, : channels * width]).reshape(frames * channels, width)
    if is_float and width in (4, 8):
        x = part.view(f"<f{width}").astype(float)
    elif not is_float and width == 1:
        x = (part.astype(float) - 128) / 128
    elif not is_float and width in (2, 4):
        x = part.view(f"<i{width}").astype(float) / 2.0 ** (bits - 1)
    elif not is_float and width == 3:
        wide = np.zeros((len(part), 4), np.uint8)
        wide[:, 1:] = part
        x = wide.view("<i4").astype(float) / 2.0**31
    else:
        raise FormatError(f"depth of {bits} bits is not supported")
    return x.reshape(frames, channels).mean(axis=1) if frames else np.zeros(0)


def stream_mono(src, wav: Wav, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The samples block by block; a file that ends early gives what it has."""
    for frame in range(0, wav.frames, block):
        count = min(block, wav.frames - frame)
        start = wav.data_offset + frame * wav.block_align
        out = decode(src.read(start, start + count * wav.block_align), wav.bits, wav.is_float, wav.channels, wav.block_align)
        yield out
        if len(out) < count:
            return


# --- broadcast-wave and iXML metadata -----------------------------------------------------------------------

#: Fixed layout of the bext chunk: description, originator, reference, date, time, sample count (64 bits), version.
_BEXT = struct.Struct("<256s32s32s10s8sQH")
BEXT_SIZE = 602


def parse_bext(raw: bytes | None) -> dict | None:
    if raw is None or len(raw) < BEXT_SIZE:
        return None
    description, originator, reference, date, time, count, version = _BEXT.unpack_from(raw)
    texts = {"description": description, "originator": originator, "originator_reference": reference, "origination_date": date, "origination_time": time}
    return {k: c_string(v) for k, v in texts.items()} | {"time_reference": count, "version": version, "coding_history": c_string(raw[BEXT_SIZE:])}


def xml_text(xml: str, name: str) -> str | None:
    """The decoded text of the first element of a name; the XML may be broken elsewhere."""
    m = re.search(rf"<{name}\b[^>]*>(.*?)</{name}>", xml, re.I | re.S)
    if not m:
        return None
    text = m[1].strip()
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(entity, char)
    return text


def xml_number(xml: str, name: str) -> float | None:
    try:
        value = float(xml_text(xml, name) or 0 if xml_text(xml, name) is not None else "none")
    except ValueError:
        return None
    return value if np.isfinite(value) else None


def parse_ixml(xml: str) -> dict:
    rate = re.fullmatch(r"\s*(\d+)\s*(?:/\s*(\d+)\s*)?", xml_text(xml, "TIMECODE_RATE") or "")
    flag = xml_text(xml, "TIMECODE_FLAG")
    tracks: dict[int, str] = {}
    block = re.search(r"<TRACK_LIST\b[^>]*>(.*?)</TRACK_LIST>", xml, re.I | re.S)
    for m in re.finditer(r"<TRACK\b[^>]*>(.*?)</TRACK>", block[1] if block else "", re.I | re.S):
        name, index = xml_text(m[1], "NAME"), xml_number(m[1], "CHANNEL_INDEX")
        if name is not None:
            tracks[int(index) - 1 if index is not None and index >= 1 else max(tracks, default=-1) + 1] = name
    return {
        "rate_numerator": int(rate[1]) if rate else None, "rate_denominator": int(rate[2] or 1) if rate else None,
        "drop_frame": flag.strip().upper() == "DF" if flag else None, "timecode_sample_rate": xml_number(xml, "TIMECODE_SAMPLE_RATE"), "file_sample_rate": xml_number(xml, "FILE_SAMPLE_RATE"),
        **{k: xml_text(xml, k.upper()) for k in ("project", "scene", "take", "note")}, "track_names": [tracks.get(k, "") for k in range(max(tracks, default=-1) + 1)],
    }


def start_seconds(bext: dict | None, ixml: dict | None, file_rate: float) -> float | None:
    rate = (ixml or {}).get("timecode_sample_rate")
    rate = file_rate if rate is None else rate
    return bext["time_reference"] / rate if bext and rate and rate > 0 else None


# --- ISO media (MOV, MP4) -----------------------------------------------------------------------------------

MOOV_LIMIT = 64 << 20


def is_iso(head: bytes) -> bool:
    return head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip", b"pnot")


def boxes(src, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes in a range; sizes of 64 bits, and 0 for the rest of the range."""
    end = src.size if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack(">I4s", src.read(start, start + 8))
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack(">Q", src.read(body, body + 8))[0], start + 16
        size = end - start if size == 0 else size
        if start + size > end or start + size < body:
            return
        yield kind, body, start + size
        start += size


def box(src, path: tuple[bytes, ...], start: int, end: int) -> tuple[int, int] | None:
    """The range of the first box down a path."""
    for kind in path:
        found = next(((a, b) for k, a, b in boxes(src, start, end) if k == kind), None)
        if found is None:
            return None
        start, end = found
    return start, end


def read_moov(src, limit: int = MOOV_LIMIT) -> bytes | None:
    found = box(src, (b"moov",), 0, src.size)
    if found is None:
        return None
    if found[1] - found[0] > limit:
        raise FormatError("moov is too large")
    return src.read(*found)


def timecode_track(moov: bytes) -> dict | None:
    """The timecode track of a moov: rate, flags, and where its one sample lies in the file."""
    src = Bytes(moov)
    for kind, a, b in boxes(src):
        handler = kind == b"trak" and box(src, (b"mdia", b"hdlr"), a, b)
        if not handler or moov[handler[0] + 8 : handler[0] + 12] != b"tmcd":
            continue
        table = box(src, (b"mdia", b"minf", b"stbl"), a, b)
        parts = {k: (s, e) for k, s, e in reversed(list(boxes(src, *table)))} if table else {}
        entry = _timecode_entry(moov, *parts[b"stsd"]) if b"stsd" in parts else None
        offset = None
        for name, code in ((b"stco", ">I"), (b"co64", ">Q")):
            s, e = parts.get(name, (0, 0))
            if offset is None and e - s >= 8 + struct.calcsize(code) and struct.unpack_from(">I", moov, s + 4)[0] >= 1:
                offset = struct.unpack_from(code, moov, s + 8)[0]
        if entry is None or offset is None:
            continue
        s, e = parts.get(b"stsz", (0, 0))
        size = 4
        if e - s >= 12:
            size = struct.unpack_from(">I", moov, s + 4)[0] or (struct.unpack_from(">I", moov, s + 12)[0] if e - s >= 16 else 4)
        return entry | {"sample_offset": offset, "sample_size": size}
    return None


def _timecode_entry(moov: bytes, start: int, end: int) -> dict | None:
    at = start + 8
    while at + 16 <= end:
        size, kind = struct.unpack_from(">I4s", moov, at)
        if size < 16:
            return None
        if kind == b"tmcd" and at + 34 <= end:
            flags, scale, duration, frames = struct.unpack_from(">IIIB", moov, at + 20)
            if not scale or not duration:
                return None
            return {"time_scale": scale, "frame_duration": duration, "number_of_frames": frames or int(scale / duration + 0.5), "drop_frame": bool(flags & 1), "frame_rate": scale / duration}
        at += size
    return None


def read_timecode(src) -> dict | None:
    """The start timecode of a movie; None if it has none or is broken."""
    try:
        moov = read_moov(src)
        track = timecode_track(moov) if moov else None
        if track is None:
            return None
        raw = src.read(track["sample_offset"], track["sample_offset"] + 4)
        frames = struct.unpack_from(">I" if track["sample_size"] >= 4 else ">H", raw)[0]
        return track | {"start_frames": frames, "start_seconds": frames / track["frame_rate"]}
    except (FormatError, struct.error):
        return None


def probe(src, name: str) -> dict:
    """What the headers say. Compressed sound is not decoded here: ``decodable`` false and why."""
    out = dict.fromkeys(("kind", "sample_rate", "channels", "duration_seconds", "timecode_seconds", "timecode_source", "frame_rate", "origination_date", "origination_time", "channel_names", "reason", "tags"))
    head = src.read(0, 12)
    if is_wav(head):
        wav = read_wav(src)
        bext, ixml = parse_bext(wav.bext), parse_ixml(wav.ixml) if wav.ixml else None
        at = start_seconds(bext, ixml, wav.sample_rate)
        rate = ixml["rate_numerator"] / ixml["rate_denominator"] if ixml and ixml["rate_denominator"] else None
        return out | {
            "kind": "wav", "sample_rate": float(wav.sample_rate), "channels": wav.channels, "duration_seconds": wav.duration, "timecode_seconds": at, "timecode_source": "bext" if at is not None else None, "frame_rate": rate,
            "origination_date": bext["origination_date"] if bext else None, "origination_time": bext["origination_time"] if bext else None, "channel_names": ixml["track_names"] if ixml else None, "tags": wav.info or None,
            "has_audio": True, "has_video": False, "decodable": True,
        }
    if is_iso(head):
        code = read_timecode(src)
        found = {"timecode_seconds": code["start_seconds"], "timecode_source": "tmcd", "frame_rate": code["frame_rate"]} if code else {}
        return out | {"kind": "iso", "has_audio": True, "has_video": name.rsplit(".", 1)[-1].lower() not in AUDIO, "decodable": False, "reason": "compressed sound needs a decoder"} | found
    return out | {"kind": "unknown", "has_audio": False, "has_video": False, "decodable": False, "reason": "unknown container"}
