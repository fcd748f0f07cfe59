"""A folder of WAVE files to a timeline, edit lists and XML."""

import glob
from xml.etree import ElementTree

import numpy as np
from shoots import FULL_RATE, on_board, part, talk

from chronoweave.operators.features import prepare, prepare_chunks, to_chunks
from chronoweave.plans.folder import sync_folder
from chronoweave.plans.sync import sync
from chronoweave.schemas import CLIPS
from chronoweave.sources.media import write_wav


def test_folder(spark, tmp_path):
    world, root = talk(70, 21), tmp_path / "shoot"
    takes = {"REC/sound_1.wav": part(world, 0, 60), "CAM_A/a_1.wav": on_board(part(world, 6, 25), 1), "CAM_B/b_1.wav": on_board(part(world, 20.5, 30), 2), "CAM_C/c_1.wav": on_board(talk(30, 22), 3)}
    for name, x in takes.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        x = np.asarray(x)
        path.write_bytes(write_wav(x / np.abs(x).max() * 0.9, int(FULL_RATE)))
    (root / "REC" / "broken.wav").write_bytes(b"nonsense")
    out = sync_folder(spark, str(root), "day one", chunk=100_000)
    assert [r.path.rsplit("/", 1)[-1] for r in out.failures.collect()] == ["broken.wav"]
    at = {r.id: r for r in out.timeline.collect()}
    assert set(at) == set(takes) and {r.reel for r in at.values()} == {"REC", "CAM_A", "CAM_B", "CAM_C"}
    for name, start in (("REC/sound_1.wav", 0), ("CAM_A/a_1.wav", 6), ("CAM_B/b_1.wav", 20.5)):
        assert at[name].synced and abs(at[name].start_seconds - start) < 2e-3
    assert not at["CAM_C/c_1.wav"].synced and at["CAM_C/c_1.wav"].start_seconds >= 60
    assert all(r.audio_track_id and r.video_track_id is None for r in at.values())
    lists = {r.file: r.text for r in out.edl().collect()}
    assert len(lists) == 4 and "00:00:20:" in next(t for f, t in lists.items() if "CAM_B" in f)
    tree = ElementTree.fromstring(out.xml().first().text.encode())
    assert len(tree.findall(".//audio/track/clipitem")) == 4 and tree.findtext(".//sequence/name") == "day one"
    out.export(str(tmp_path / "out"))
    assert len(glob.glob(str(tmp_path / "out" / "name=*"))) == 6


def test_chunks_make_no_difference(spark):
    x = talk(9, 3)
    rows = [("p", k, f"c{k}", None, "n", FULL_RATE, x[: 40_000 * (k + 1)].tolist() if k < 3 else [], None, 1.0, "metadata", None) for k in range(4)]
    clips = spark.createDataFrame(rows, CLIPS)
    whole = {r.clip_id: r for r in prepare(clips).collect()}
    for r in prepare_chunks(clips.drop("samples"), to_chunks(clips, 7000)).collect():
        assert r == whole[r.clip_id]


def test_gates_make_no_difference(spark):
    """Gates change which pairs are compared and not what is accepted; starts are true."""
    from chronoweave.options import GateOptions, SyncOptions
    from chronoweave.sources.samples import sample_shoot
    from chronoweave.storage import settled

    clips, chunks = sample_shoot(spark, devices=3, takes=2, seconds=30.0, span=9000.0, chunk=100_000)
    chunks, accepted, compared = settled(chunks, "shoot"), {}, {}
    for timed in (True, False):
        out = sync(clips.drop("take", "device", "start"), SyncOptions(gates=GateOptions(by_recording_time=timed), detect_drift=False), chunks, chunk=100_000)
        accepted[timed] = {(r.a_id, r.b_id) for r in out.pairs.where("accepted").collect()}
        compared[timed] = out.stats.first().aligned_pairs
    assert accepted[True] == accepted[False] == {(f"take{t}-dev{a}", f"take{t}-dev{b}") for t in range(2) for a in range(3) for b in range(a + 1, 3)}
    assert compared == {True: 6, False: 12}
    start = {r.clip_id: r.start_seconds for r in out.placements.collect()}
    for r in clips.collect():
        assert abs(start[r.clip_id] - start[f"take{r['take']}-dev0"] - 7.5 * r.device) < 2e-3
