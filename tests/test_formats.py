import struct

import numpy as np
import pytest

from chronoweave.functions.containers import Bytes, FormatError, boxes, parse_bext, parse_ixml, probe, read_timecode, read_wav, start_seconds, stream_mono
from chronoweave.sources.media import failures, probe_files, read_signals, write_wav


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_round_trip(bits, channels):
    x = np.sin(np.arange(500) / 9) * 0.8
    src = Bytes(write_wav(x, 8000, bits, channels))
    wav = read_wav(src)
    assert (wav.sample_rate, wav.channels, wav.frames) == (8000, channels, 500)
    y = np.concatenate(list(stream_mono(src, wav, 64)))
    assert np.abs(x - y).max() < 2.0 ** (2 - bits)


def test_wav_oddities():
    data = write_wav(np.ones(10) * 0.5, 8000)
    assert read_wav(Bytes(data[:-6])).frames == 7  # the data size overruns the file
    with pytest.raises(FormatError):
        read_wav(Bytes(b"RIFF0000WAVE"))
    fmt = struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16)
    ds64 = struct.pack("<QQQI", 0, 8, 4, 0)
    long_one = b"RF64\xff\xff\xff\xffWAVE" + chunk(b"ds64", ds64) + chunk(b"fmt ", fmt) + b"data\xff\xff\xff\xff" + b"\1\0" * 4
    wav = read_wav(Bytes(long_one))
    assert wav.rf64 and wav.frames == 4
    extensible = struct.pack("<HHIIHHHHIH", 0xFFFE, 1, 8000, 32000, 4, 32, 22, 32, 0, 3) + b"\0" * 14
    wav = read_wav(Bytes(b"RIFF\0\0\0\0WAVE" + chunk(b"fmt ", extensible) + chunk(b"LIST", b"INFO" + chunk(b"INAM", b"take\0")) + chunk(b"data", struct.pack("<f", 0.25))))
    assert wav.is_float and wav.info == {"INAM": "take"}


def test_broadcast_metadata():
    raw = struct.pack("<256s32s32s10s8sQH", b"desc", b"rec", b"ref", b"2024-05-06", b"10:11:12", 1 << 33, 1).ljust(602, b"\0") + b"A=PCM"
    bext = parse_bext(raw)
    assert bext["time_reference"] == 1 << 33 and bext["coding_history"] == "A=PCM" and parse_bext(raw[:600]) is None
    xml = "<BWFXML><TIMECODE_RATE>30000/1001</TIMECODE_RATE><TIMECODE_FLAG>df</TIMECODE_FLAG><SCENE>a & b &amp;lt;</SCENE><TRACK_LIST><TRACK><CHANNEL_INDEX>2</CHANNEL_INDEX><NAME>Boom</NAME></TRACK><TRACK><NAME>Lav</NAME></TRACK></TRACK_LIST>"
    found = parse_ixml(xml)
    assert (found["rate_numerator"], found["rate_denominator"], found["drop_frame"]) == (30000, 1001, True)
    assert found["track_names"] == ["", "Boom", "Lav"] and found["scene"] == "a & b &lt;" and found["take"] is None
    assert start_seconds(bext, found, 48000.0) == (1 << 33) / 48000 and start_seconds(None, found, 48000.0) is None


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def movie(wide: bool) -> bytes:
    entry = struct.pack(">I4s6xHIIIIB1x", 34, b"tmcd", 1, 0, 1, 30000, 1001, 30)
    stsd = box(b"stsd", struct.pack(">II", 0, 1) + entry)
    where = lambda at: box(b"co64", struct.pack(">IIQ", 0, 1, at)) if wide else box(b"stco", struct.pack(">III", 0, 1, at))
    stsz = box(b"stsz", struct.pack(">III", 0, 4, 1))
    make = lambda at: box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", b"\0" * 8 + b"tmcd" + b"\0" * 12) + box(b"minf", box(b"stbl", stsd + where(at) + stsz)))))
    head = box(b"ftyp", b"qt  ")
    at = len(head) + len(make(0)) + 8
    return head + make(at) + box(b"mdat", struct.pack(">I", 1800))


@pytest.mark.parametrize("wide", [False, True])
def test_movie_timecode(wide):
    code = read_timecode(Bytes(movie(wide)))
    assert code["start_frames"] == 1800 and code["drop_frame"] and abs(code["start_seconds"] - 60.06) < 1e-9
    assert read_timecode(Bytes(movie(wide)[:60])) is None
    assert probe(Bytes(movie(wide)), "a.mov")["timecode_source"] == "tmcd"
    assert [k for k, _, _ in boxes(Bytes(movie(wide)))] == [b"ftyp", b"moov", b"mdat"]


def test_signals_from_files(spark, tmp_path):
    x = np.sin(np.arange(20000) / 30)
    (tmp_path / "a.wav").write_bytes(write_wav(x, 48000))
    (tmp_path / "b.mov").write_bytes(movie(False))
    (tmp_path / "c.wav").write_bytes(b"nonsense")
    from chronoweave.sources.media import WavDataSource, find_media

    files = find_media(spark, str(tmp_path))
    assert files.count() == 3
    probes = probe_files(files)
    assert {r.path[-5:] for r in failures(probes).collect()} == {"b.mov", "c.wav"}
    got = read_signals(files, chunk=1000).orderBy("chunk_idx").collect()
    from chronoweave.functions.signal import decimate

    y = np.concatenate([r.samples for r in got])
    assert got[0].sample_rate == 16000 and len(y) == 6666 and np.abs(y - decimate(x, 3)).max() < 1e-3
    spark.dataSource.register(WavDataSource)
    rows = spark.read.format("wav").option("frames", "3000").load(str(tmp_path / "a.wav")).orderBy("start_frame").collect()
    assert len(rows) == 7 and sum(len(r.samples) for r in rows) == 20000
