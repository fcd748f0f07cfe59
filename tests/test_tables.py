import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.functions import timecode as TC
from chronoweave.operators import devices, files, lanes
from chronoweave.options import RATE_25, RATE_2997_DF, FrameRate, TrackLimits
from chronoweave.sources import sinks

GROUP = "project_id string, clip_id string, path string, has_video boolean, make string, model string, serial string"


def grouped(spark, paths, **more):
    rows = [("p", str(i), p, None, more.get("make"), None, None) for i, p in enumerate(paths)]
    found = {int(r.clip_id): (r.device_id, r.basis) for r in devices.group_clips(spark.createDataFrame(rows, GROUP)).collect()}
    return [found[i] for i in range(len(paths))]


def test_grouping(spark):
    assert grouped(spark, ["CamA/PRIVATE/AVCHD/1.MTS", "CamB/DCIM/2.MP4"]) == [("CAMA", "card-structure"), ("CAMB", "card-structure")]
    assert grouped(spark, ["Footage/C1/C1_1.mp4", "Footage/C1/C1_2.mp4", "Footage/C2/C2_1.mp4"]) == [("FOOTAGE-C1", "directory")] * 2 + [("FOOTAGE-C2", "directory")]
    days = [d for d, _ in grouped(spark, ["Shoot/Mon/a1.mp4", "Shoot/Tue/b1.mp4", "Rec/z.wav"])]
    assert days == ["SHOOT", "SHOOT", "REC"]
    same = [d for d, _ in grouped(spark, ["F/X/0001.mp4", "F/Y/0001.mp4"])]
    assert same == ["F-X", "F-Y"]
    assert grouped(spark, ["C1_1.MP4", "C2_2.MP4", "01 take.mp3"])[:2] == [("C1", "filename-prefix"), ("C2", "filename-prefix")]
    assert grouped(spark, ["C1_1.MP4", "C2_2.MP4", "01 take.mp3"])[2][0] == "AUDIO"
    assert {b for _, b in grouped(spark, ["C2_1.mp4", "C2_2.mp4"])} == {"filename-prefix"}
    assert [d for d, _ in grouped(spark, ["1.mp4", "2.wav"])] == ["VIDEO", "AUDIO"]


def test_relink_and_upsert(spark):
    schema = "ordinal int, project_id string, path string, size long, modified long"
    want = spark.createDataFrame([(0, "p", "a/x.wav", 1, 1), (1, "p", "a/y.wav", 2, 2), (2, "p", "z.wav", 3, 3), (3, "p", "gone.wav", 9, 9)], schema)
    have = spark.createDataFrame([(0, "p", "b/y.wav", 2, 2), (1, "p", "a/x.wav", 1, 1), (2, "p", "c/z.wav", 3, 7)], schema)
    sets = {r.path: (r.found, r.tier) for r in files.relink(want, have).collect()}
    assert sets == {"a/x.wav": ("a/x.wav", "exact"), "a/y.wav": ("b/y.wav", "moved"), "z.wav": ("c/z.wav", "renamed"), "gone.wav": (None, "missing")}
    ladder = {r.path: r.found for r in files.relink_in_order(want, have).collect()}
    assert ladder == {k: v for k, (v, _) in sets.items()}
    merged = {r.path: r.size for r in files.upsert(want.drop("ordinal", "project_id"), have.drop("ordinal", "project_id")).collect()}
    assert len(merged) == 6 and files.changed(want, have).count() == 2


def test_lanes():
    assert lanes.first_fit([(0, 5), (5, 9), (4, 6), (6, 7)]) == [0, 0, 1, 1]
    assert lanes.pack([([(0, 5)], 1), ([(5, 9)], 1), ([(0, 9)], 1)], 2) == ([0, 1, 2], True)
    assert lanes.pack([([(0, 5)], 2), ([(5, 9)], 2), ([(6, 9)], 2)], 4) == ([0, 1, 0], False)


TIMELINE = (
    "project_id string, id string, name string, path string, track_id string, video_track_id string, audio_track_id string, track_label string, start_seconds double, duration_seconds double, "
    "source_in_seconds double, has_video boolean, has_audio boolean, audio_channels int, width int, height int, synced boolean, reel string, timecode_seconds double"
)


@pytest.fixture(scope="module")
def timeline(spark):
    rows = [
        ("p", "rec", "rec.wav", "/m/rec.wav", "REC", None, None, "REC", 0.0, 60.0, None, False, True, 1, None, None, True, None, None),
        ("p", " cam", "cam 1.mov", "/m/cam 1.mov", "CAM", None, None, "CAM", 8.04, 20.0, None, True, True, 2, 1920, 1080, True, None, 3600.0),
        ("p", "orphan", "a & b.mov", "/m/a & b.mov", "CAM", None, None, "CAM", 70.0, 5.0, None, True, True, 2, 1920, 1080, False, None, None),
    ]
    return spark.createDataFrame(rows, TIMELINE)


def test_edl(timeline):
    texts = {r.track_id: r.text for r in sinks.export_edl(timeline, "Show", RATE_25).collect()}
    cam = texts["CAM"].split("\n")
    assert cam[:3] == ["TITLE: SHOW CAM", "FCM: NON-DROP FRAME", ""]
    assert cam[3] == "001 CAM1     AA/V  C        00:00:00:00 00:00:20:00 00:00:08:01 00:00:28:01"
    assert cam[4] == "* FROM CLIP NAME: cam 1.mov" and "* COMMENT: UNSYNCED" in cam and cam[-4:-1] == ["* REEL MAP", "* CAM1     cam 1.mov", "* AB       a & b.mov"]
    assert sinks.reel_names(["CAM"] * 3) == ["CAM", "CAM1", "CAM2"]


def test_xml(timeline):
    import xml.etree.ElementTree as ET

    text = sinks.export_xml(timeline, "A & B", RATE_25).first().text
    root = ET.fromstring(text.split("<!DOCTYPE xmeml>")[1])
    assert root.find("sequence/name").text == "A & B" and root.find("sequence/duration").text == "1875"
    audio = root.findall("sequence/media/audio/track")
    assert len(audio) == 3 and audio[0].find("clipitem/name").text == "rec.wav"
    cam = root.find("sequence/media/video/track/clipitem")
    assert cam.get("id") == "clipitem-_cam-video" and cam.find("start").text == "201" and len(cam.findall("link")) == 3
    assert cam.find("file/pathurl").text == "file:///m/cam%201.mov" and cam.find("file/timecode/string").text == "01:00:00:00"
    assert len(root.findall(".//file/name")) == 3 and len(root.findall(".//label2")) == 3


def test_lane_assignment(spark):
    rows = [("p", f"{d}{k}", d, s, 10.0, v, True, 1) for k, (d, s, v) in enumerate([("A", 0.0, True), ("A", 10.0, True), ("B", 5.0, True), ("R", 0.0, False), ("A", 5.0, True)])]
    df = spark.createDataFrame(rows, "project_id string, id string, device string, start double, duration double, video boolean, audio boolean, channels int")
    got = {r.id: (r.video_track_id, r.audio_track_id) for r in lanes.assign_lanes(df, TrackLimits(2, 10)).collect()}
    assert got["A0"][0] == got["A1"][0] == "V000" and got["R3"][0] is None and got["A4"][0] != "V000"
    assert {v for v, _ in got.values() if v} == {"V000", "V001", "V002"}


def test_timecode(spark):
    df = spark.range(0, 200000, 997).withColumnRenamed("id", "f")
    back = df.select("f", TC.timecode_to_frames(TC.frames_to_timecode(F.col("f"), RATE_2997_DF), RATE_2997_DF).alias("g"), TC.timecode_to_frames(TC.frames_to_timecode(F.col("f"), RATE_25), RATE_25).alias("h"))
    assert back.where("f <> g OR f <> h").count() == 0
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(TC.frames_to_timecode(F.lit(1800), RATE_2997_DF)) == "00:01:00;02" and one(TC.frames_to_timecode(F.lit(17982), RATE_2997_DF)) == "00:10:00;00"
    assert one(TC.half_up(F.lit(-0.5))) == 0 and one(TC.clock(F.lit(3661.0))) == "1:01:01"
    with pytest.raises(ValueError):
        TC.frames_to_timecode(F.lit(1), FrameRate(25, False, True))
    assert one(TC.origination_seconds(F.lit("2024-02-31"), F.lit("00:00:01"))) == one(TC.origination_seconds(F.lit("2024-03-02"), F.lit("00:00:01")))
    assert one(TC.origination_seconds(F.lit("1970-01-01"), F.lit("00:00:00"))) is None
    assert one(X.xml_tag(F.lit("<a><NOTE x='1'> a &amp;lt; </NOTE>"), "NOTE")) == "a &lt;"


def test_stream_equals_whole(spark, tmp_path):
    import numpy as np

    from chronoweave.functions.signal import decimate
    from chronoweave.streaming.decimate import decimate_stream

    x = np.random.default_rng(2).normal(size=1000)
    schema = "clip_id string, block long, samples array<double>, last boolean"
    source = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame([(c, k, x[k * 250 : (k + 1) * 250].tolist(), k == 3) for c in "ab"], schema).coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = decimate_stream(stream, 3).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("out").where("clip_id = 'a'").orderBy("start_sample").collect()
    assert np.allclose(np.concatenate([r.samples for r in got]), decimate(x, 3))


def test_report_figures(spark):
    """Ranks by project, drift that no clock has, sizes, lanes, and figures of clips that could not sync."""
    from chronoweave.operators import summary

    pairs = spark.createDataFrame([(p, "a", f"b{k:02d}", k / 100, 9.0, 5.0, "waveform", False) for p in "xy" for k in range(30)], "project_id string, a_id string, b_id string, quality double, psr double, overlap_seconds double, method string, accepted boolean")
    missed = summary.near_misses(pairs).collect()
    assert len(missed) == 50 and {r.b_id for r in missed if r.rank == 1} == {"b29"}
    errors = spark.createDataFrame([("x", "a", "b", 0.03, "m"), ("x", "a", "c", -9.0, "m"), ("x", "b", "c", 0.5, "m")], "project_id string, a_id string, b_id string, error_seconds double, kind string")
    assert [r.error_seconds for r in summary.worst_disagreements(errors).orderBy("rank").collect()] == [-9.0, 0.5, 0.03]
    assert tuple(summary.disagreement_counts(errors, 0.04).first()) == ("x", 2, 1)
    placed = spark.createDataFrame([("x", "a", 0.0, True, 0, 700.0), ("x", "b", 5.0, True, 0, -20.0), ("x", "c", 20.0, False, 1, None), ("x", "d", 30.0, False, 2, None)], "project_id string, clip_id string, start_seconds double, synced boolean, group_id int, drift_ppm double")
    assert [r.clip_id for r in summary.implausible_drift(placed).collect()] == ["a"]
    clips = spark.createDataFrame([("x", "a", 10.0, "A", 100), ("x", "b", 10.0, "B", 50), ("x", "c", 2.0, "B", 7), ("x", "d", 10.0, "B", 0)], "project_id string, clip_id string, duration_seconds double, device string, n_samples long")
    assert summary.audio_bytes(clips).first().bytes == 157 * 8
    assert [r.clip_id for r in summary.too_short(placed, clips).collect()] == ["c"] and summary.can_sync(clips).first().can_sync
    assert [(r.clips, r.members) for r in summary.islands(placed).collect()] == [(2, "a,b")]
    edges = {r.clip_id: (r.left, r.width) for r in summary.timeline_percent(placed, clips).collect()}
    assert edges["b"] == (12.5, 25.0) and edges["d"] == (75.0, 25.0)
    lanes_of = spark.createDataFrame([("x", "V1", None), ("x", "V1", "A1"), ("x", None, None)], "project_id string, video_track_id string, audio_track_id string")
    assert tuple(summary.layout_counts(lanes_of).first()) == ("x", 1, 1, 3, 1)


def test_devices_by_hand_and_in_order(spark):
    files = spark.createDataFrame([("x", "1", "r/1.wav", False), ("x", "2", "c/2.mp4", True), ("x", "3", "c/3.mp4", True)], "project_id string, clip_id string, path string, has_video boolean")
    assigned = spark.createDataFrame([("x", "1", "REC", "directory"), ("x", "2", "CAM", "directory")], "project_id string, clip_id string, device_id string, basis string")
    by_hand = spark.createDataFrame([("x", "2", "MINE")], "project_id string, clip_id string, device_id string")
    assert {r.clip_id: r.device_id for r in devices.device_of(files, assigned, by_hand).collect()} == {"1": "REC", "2": "MINE", "3": "DEVICE"}
    assert [r.device_id for r in devices.device_order(assigned, files).orderBy("ordinal").collect()] == ["CAM", "REC"]
    one = spark.createDataFrame([("y", "1", "CAM", "b"), ("y", "2", "CAM", "b")], assigned.schema)
    assert "two are needed" in devices.grouping_warnings(one, files.limit(0)).first().warning


def test_lanes_hold_no_overlaps(spark):
    """Clips of a lane never overlap while the budget lasts, and every clip has the lanes that it needs."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(f"p{p}", f"c{k}", f"d{rng.integers(5)}", float(rng.integers(60)), float(rng.integers(1, 20)), bool(rng.random() < 0.6), True, int(rng.integers(1, 3))) for p in range(4) for k in range(25)]
    df = spark.createDataFrame(rows, "project_id string, id string, device string, start double, duration double, video boolean, audio boolean, channels int")
    got = {(r.project_id, r.id): r for r in lanes.assign_lanes(df, TrackLimits(100, 100)).collect()}
    lane = {}
    for p, i, _, start, size, video, _, _ in rows:
        r = got[(p, i)]
        assert (r.video_track_id is not None) == video and r.audio_track_id is not None
        for key in (r.video_track_id, r.audio_track_id):
            if key:
                lane.setdefault((p, key), []).append((start, start + size))
    for spans in lane.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_lanes_as_by_first_fit_over_all_spans(spark):
    """Lanes of many projects, as first fit over every span gives them; some spans are empty, some rows lack a device or a kind, and projects cross batches. No call is made for each project."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows = []
    for p in range(40):
        for k in range(int(rng.integers(1, 50))):
            size = 0.0 if p % 5 == 0 and rng.random() < 0.3 else float(rng.integers(1, 15))
            rows.append((f"p{p}", f"c{k:02d}", None if rng.random() < 0.05 else f"d{rng.integers(7)}", float(rng.integers(40)), size, bool(rng.random() < 0.6), bool(rng.random() < 0.9), None if rng.random() < 0.1 else int(rng.integers(1, 3))))
    free = lambda lane, s: all(s[0] >= t or f >= s[1] for f, t in lane)

    def first(lists, spans):
        return next((i for i, lane in enumerate(lists) if all(free(lane, s) for s in spans)), None)

    want = {}
    for p in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == p), key=lambda r: r[1])
        names = list(dict.fromkeys(r[2] for r in own if r[2]))
        names.sort(key=lambda d: (not any(r[5] for r in own if r[2] == d), min(r[3] for r in own if r[2] == d)))
        for letter, kind, budget in (("V", 5, 4), ("A", 6, 10)):
            lists, spent = [], 0
            for d in names:
                cost = 1 if kind == 5 else max(2 if r[7] is None else r[7] for r in own if r[2] == d)
                runs = []
                for r in sorted((r for r in own if r[2] == d and r[kind]), key=lambda r: r[3]):
                    at = first([[(x[3], x[3] + x[4]) for x in run] for run in runs], [(r[3], r[3] + r[4])])
                    runs.append([r]) if at is None else runs[at].append(r)
                for run in runs:
                    spans = [(r[3], r[3] + r[4]) for r in run]
                    at = None if spent + cost <= budget else first(lists, spans)
                    if at is None:
                        at, spent = len(lists), spent + cost
                        lists.append([])
                    lists[at] += spans
                    want |= {(p, r[1], letter): f"{letter}{at:03d}" for r in run}
    df = spark.createDataFrame(rows, "project_id string, id string, device string, start double, duration double, video boolean, audio boolean, channels int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = lanes.assign_lanes(df)
        got = {(r.project_id, r.id): (r.video_track_id, r.audio_track_id) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(r[0], r[1]): (want.get((r[0], r[1], "V")), want.get((r[0], r[1], "A"))) for r in rows}
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
