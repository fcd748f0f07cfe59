"""From accepted pairs to one timeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.correlation import drift_spans, phase_peak
from ..options import DriftOptions, SyncOptions
from ..storage import settled
from .features import CHUNK, fetch
from .gates import overlapping_neighbours
from .pairs import _piece, _told, edge_score

_SOLVED = "project_id string, clip_index long, position double, group_id int, group_size int, best_quality double, tree string, refused int"


def spanning_forest(n: int, lengths: list[float], devices: list[str | None], edges: list[tuple], tolerance: float):
    """The most trusted forest that lays no two clips of one device over each other.

    ``edges`` are (i, j, offset, quality) in the order of trust. Returns
    positions, component of each clip, numbers of the edges used, and how many
    were refused.
    """
    position, owner = [0.0] * n, list(range(n))
    clips = {i: [i] for i in range(n)}
    used, refused = [], 0
    for k, (i, j, offset, _) in enumerate(edges):
        left, right = owner[i], owner[j]
        if left == right:
            continue
        shift = position[i] + offset - position[j]
        held: dict[str, list[int]] = {}
        for m in clips[left]:
            if devices[m] is not None:
                held.setdefault(devices[m], []).append(m)
        stacked = any(
            position[m] + shift < position[o] + lengths[o] - tolerance and position[o] < position[m] + shift + lengths[m] - tolerance
            for m in clips[right]
            if devices[m] is not None
            for o in held.get(devices[m], ())
        )
        if stacked:
            refused += 1
            continue
        for m in clips[right]:
            position[m] += shift
        if len(clips[left]) < len(clips[right]):
            left, right = right, left
        for m in clips[right]:
            owner[m] = left
        clips[left] += clips.pop(right)
        used.append(k)
    for own in clips.values():
        base = min(position[m] for m in own)
        for m in own:
            position[m] -= base
    return position, owner, used, refused


def solve(clips: DataFrame, pairs: DataFrame, opts: SyncOptions | None = None) -> DataFrame:
    """Relative positions by project: one task a project, which holds metadata and accepted pairs but no signal.

    Returns clip_index, position, group_id (in the order of first clips),
    group_size, best_quality, tree (the numbers i:j of the edges that place the
    clip) and refused (edges that would stack a device's clips).
    """
    opts = opts or SyncOptions()
    meta = clips.select("project_id", "clip_index", "track_id", "duration_seconds")
    edges = pairs.where("accepted").select("project_id", "i", "j", "offset_seconds", "quality", edge_score(F.col("quality"), F.col("overlap_seconds"), F.col("psr")).alias("score"))

    edges = edges.toDF(*edges.columns)  # columns of its own, apart from those of the clips

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in _SOLVED.split(", ")])
        nodes = nodes.sort_values("clip_index")
        at = {c: k for k, c in enumerate(nodes.clip_index)}
        edges = edges.sort_values(["score", "i", "j"], ascending=[False, True, True], kind="stable")
        rows = [(at[e.i], at[e.j], e.offset_seconds, e.quality) for e in edges.itertuples(index=False)]
        devices = [None if pd.isna(d) else d for d in nodes.track_id]
        position, owner, used, refused = spanning_forest(len(nodes), nodes.duration_seconds.tolist(), devices, rows, opts.tolerance)
        number: dict[int, int] = {}
        group = [number.setdefault(o, len(number)) for o in owner]
        best, tree = [None] * len(nodes), [[] for _ in owner]
        for k in used:
            i, j, _, q = rows[k]
            name = f"{nodes.clip_index.iloc[i]}:{nodes.clip_index.iloc[j]}"
            for m in (i, j):
                best[m] = q if best[m] is None else max(best[m], q)
            tree[j].append(name)
        sizes = pd.Series(group).value_counts()
        best = [q or None for q in best]
        return pd.DataFrame({
            "project_id": nodes.project_id.iloc[0], "clip_index": nodes.clip_index.to_numpy(), "position": position, "group_id": group,
            "group_size": [int(sizes[g]) for g in group], "best_quality": best, "tree": [",".join(t) for t in tree], "refused": refused,
        })

    return meta.groupBy("project_id").cogroup(edges.groupBy("project_id")).applyInPandas(run, _SOLVED)


def tree_edges(solved: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that hold the timeline, with their order among those of their second clip."""
    names = solved.select("project_id", F.posexplode(F.split("tree", ",")).alias("ordinal", "name")).where("name <> ''")
    named = names.select("project_id", "ordinal", *[F.split("name", ":")[k].cast("int").alias(c) for k, c in enumerate("ij")])
    return pairs.join(named, ["project_id", "i", "j"])


def layout(clips: DataFrame, solved: DataFrame, opts: SyncOptions | None = None) -> DataFrame:
    """Places on the timeline: groups by size, one after another, then loose clips end to end, device by device.

    Returns clip_index, clip_id, track_id, start_seconds, synced, quality,
    group_id. Running sums are within a project.
    """
    opts = opts or SyncOptions()
    rows = solved.join(clips.select("project_id", "clip_index", "clip_id", "track_id", "duration_seconds"), ["project_id", "clip_index"])
    ends = rows.where("group_size > 1").groupBy("project_id", "group_id", "group_size").agg(F.max(F.col("position") + F.col("duration_seconds")).alias("extent"))
    before = Window.partitionBy("project_id").orderBy(F.desc("group_size"), "group_id").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.withColumn("base", F.coalesce(F.sum(F.col("extent") + opts.group_gap).over(before), F.lit(0.0)))
    totals = bases.groupBy("project_id").agg(F.sum(F.col("extent") + opts.group_gap).alias("synced_end"))
    device = F.coalesce("track_id", "clip_id")
    loose = rows.where("group_size = 1").withColumn("device", device)
    order = ["clip_index"] if opts.preserve_clip_order else ["group_id"]
    seen = loose.groupBy("project_id", "device").agg(F.min("clip_index").alias("first"), F.sum("duration_seconds").alias("length"))
    by_first = Window.partitionBy("project_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.withColumn("device_base", F.coalesce(F.sum(F.col("length") + opts.group_gap).over(by_first), F.lit(0.0))).select("project_id", "device", "device_base")
    within = Window.partitionBy("project_id", "device").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parked = loose.withColumn("inner", F.coalesce(F.sum("duration_seconds").over(within), F.lit(0.0))).join(starts, ["project_id", "device"]).join(totals, "project_id", "left")
    parked = parked.withColumn("start_seconds", F.coalesce("synced_end", F.lit(0.0)) + F.col("device_base") + F.col("inner"))
    placed = rows.where("group_size > 1").join(bases.select("project_id", "group_id", "base"), ["project_id", "group_id"]).withColumn("start_seconds", F.col("base") + F.col("position"))
    out = lambda df: df.select("project_id", "clip_index", "clip_id", device.alias("track_id"), "start_seconds", (F.col("group_size") > 1).alias("synced"), F.col("best_quality").alias("quality"), "group_id")
    return out(placed).unionByName(out(parked))


def disagreements(solved: DataFrame, pairs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Accepted pairs outside the tree whose offset the timeline contradicts."""
    tree = tree_edges(solved, pairs).select("project_id", "i", "j")
    rest = pairs.where("accepted").join(tree, ["project_id", "i", "j"], "left_anti")
    at = lambda p, k: solved.select("project_id", F.col("clip_index").alias(k), F.col("position").alias(f"{p}_at"), F.col("group_id").alias(f"{p}_group"))
    both = rest.join(at("a", "i"), ["project_id", "i"]).join(at("b", "j"), ["project_id", "j"]).where("a_group = b_group")
    error = F.col("b_at") - F.col("a_at") - F.col("offset_seconds")
    return both.withColumn("error_seconds", error).where(F.abs("error_seconds") > tolerance).select("project_id", "a_id", "b_id", "error_seconds", F.lit("offset-disagreement").alias("kind"))


def device_overlaps(placements: DataFrame, clips: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Synced clips of one device that lie over their predecessor."""
    rows = placements.where("synced").join(clips.select("project_id", "clip_index", F.col("track_id").alias("device"), "duration_seconds"), ["project_id", "clip_index"]).where("device IS NOT NULL")
    spans = rows.select("project_id", "device", F.col("clip_id").alias("id"), F.col("start_seconds").alias("start"), (F.col("start_seconds") + F.col("duration_seconds")).alias("end"))
    found = overlapping_neighbours(spans, ["project_id", "device"], tolerance)
    return found.select("project_id", F.col("prior_id").alias("a_id"), F.col("id").alias("b_id"), F.col("overlap").alias("error_seconds"), F.lit("same-device-overlap").alias("kind"))


def drift_fit(samples: DataFrame, keys: list[str]) -> DataFrame:
    """ppm, r2 and total slip of samples (time_seconds, offset_seconds) by least squares; zeros for fewer than three."""
    few = F.col("n_samples") < 3
    flat = F.col("spread") == 0
    fit = samples.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n_samples"), F.regr_slope("offset_seconds", "time_seconds").alias("slope"), F.regr_r2("offset_seconds", "time_seconds").alias("fit"),
        F.var_pop("offset_seconds").alias("spread"), (F.max("time_seconds") - F.min("time_seconds")).alias("span"),
    )
    slope = F.when(few, F.lit(0.0)).otherwise(F.coalesce("slope", F.lit(0.0)))
    return fit.select(
        *keys, (-slope * 1e6).alias("ppm"), F.when(few | flat, F.lit(0.0)).otherwise(F.coalesce("fit", F.lit(0.0))).alias("r2"), (slope * F.col("span")).alias("total_slip_seconds"), "n_samples"
    )


def measure_drift(tree: DataFrame, prepared: DataFrame, chunks: DataFrame, opts: DriftOptions | None = None, compat: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Clock drift of the pairs that hold the timeline, from windows spread over their overlap; only those windows are read."""
    o = opts or DriftOptions()
    size = lambda p, k: prepared.select("project_id", F.col("clip_index").alias(k), F.col("n_samples").alias(f"{p}_n"), F.col("sample_rate").alias(f"{p}_rate"), F.col("dc").alias(f"{p}_dc"))
    edges = tree.select("project_id", "i", "j", "a_id", "b_id", "offset_seconds").join(size("a", "i"), ["project_id", "i"]).join(size("b", "j"), ["project_id", "j"])

    def spans(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, (a, b) in enumerate(drift_spans(r.a_n, r.b_n, r.a_rate, r.b_rate, r.offset_seconds, o.rate, o.windows, o.window, o.search)):
                    rows.append((r.project_id, f"{r.i}:{r.j}:{k}", r.a_id, r.b_id, r.a_dc, r.b_dc, _told(a), _told(b), *a.native, *b.native))
            yield pd.DataFrame(rows, columns=["project_id", "key", "a_id", "b_id", "a_dc", "b_dc", "a_piece", "b_piece", "a_low", "a_high", "b_low", "b_high"])

    windows = settled(edges.mapInPandas(spans, "project_id string, key string, a_id string, b_id string, a_dc double, b_dc double, a_piece string, b_piece string, a_low long, a_high long, b_low long, b_high long"), "windows")
    out = windows
    for p in "ab":
        wanted = windows.select("project_id", F.col(f"{p}_id").alias("clip_id"), "key", F.col(f"{p}_low").alias("low"), F.col(f"{p}_high").alias("high"))
        out = out.join(fetch(wanted, chunks, chunk).select("project_id", "key", F.col("first").alias(f"{p}_first"), F.col("samples").alias(f"{p}_samples")), ["project_id", "key"])

    def measure(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                pa, pb = _piece(r.a_piece), _piece(r.b_piece)
                x, y = pa.cut(np.asarray(r.a_samples, dtype=float), r.a_first, r.a_dc), pb.cut(np.asarray(r.b_samples, dtype=float), r.b_first, r.b_dc)
                peak = phase_peak(x, y, len(x) + round(o.search * pa.rate), compat=compat)
                if peak.psr >= o.min_psr:
                    rows.append((r.project_id, r.a_id, r.b_id, pa.start / pa.rate, (pa.start - pb.start + peak.offset) / pa.rate))
            yield pd.DataFrame(rows, columns=["project_id", "a_id", "b_id", "time_seconds", "offset_seconds"])

    samples = out.mapInPandas(measure, "project_id string, a_id string, b_id string, time_seconds double, offset_seconds double")
    return drift_fit(samples, ["project_id", "a_id", "b_id"])
