"""The whole of it: clips in, a timeline out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import CHUNK, prepare, prepare_chunks, to_chunks
from ..operators.gates import gate_stats, screen
from ..operators.pairs import align
from ..operators.solve import device_overlaps, disagreements, layout, measure_drift, solve, tree_edges
from ..options import SyncOptions
from ..storage import settled


@dataclass
class SyncResult:
    """Tables of one run; each has a project_id."""

    placements: DataFrame
    pairs: DataFrame
    tree: DataFrame
    inconsistencies: DataFrame
    stats: DataFrame
    drift: DataFrame | None

    @property
    def unsynced(self) -> DataFrame:
        return self.placements.where("NOT synced").select("project_id", "clip_id")


def sync(clips: DataFrame, opts: SyncOptions | None = None, chunks: DataFrame | None = None, known: DataFrame | None = None, chunk: int = CHUNK) -> SyncResult:
    """Align all clips of all projects (see schemas.CLIPS), each project for itself.

    Features are made once and kept; pairs are pruned by metadata before any
    signal moves; features meet by blocks of clips; signals are read only under
    the pieces that winners need. Gated pairs stay in ``pairs`` with method
    none. Signals are a column ``samples`` of the clips, or ``chunks`` of
    ``chunk`` samples each.
    """
    opts = opts or SyncOptions()
    prepared = settled(prepare(clips, opts.align) if "samples" in clips.columns else prepare_chunks(clips, chunks, opts.align), "prepared")
    chunks = settled(to_chunks(clips, chunk), "chunks") if chunks is None else chunks  # read for refinement and for drift
    screened = settled(screen(prepared, opts.gates), "screened")
    pairs = settled(align(screened, prepared, chunks, opts.align, opts.gates, opts.compat, known, chunk), "pairs")
    solved = settled(solve(prepared, pairs, opts), "solved")
    tree = settled(tree_edges(solved, pairs), "tree")
    placements = settled(layout(prepared, solved, opts), "layout")
    wrong = disagreements(solved, pairs, opts.tolerance)
    if opts.preserve_clip_order:
        wrong = wrong.unionByName(device_overlaps(placements, prepared, opts.tolerance))
    drift = None
    if opts.detect_drift:
        drift = measure_drift(tree, prepared, chunks, opts.drift, opts.compat, chunk).where((F.col("r2") >= opts.drift.report_r2) & (F.abs("ppm") > opts.drift.report_ppm))
        drift = settled(drift, "drift")
        last = tree.join(drift.select("project_id", "a_id", "b_id", "ppm"), ["project_id", "a_id", "b_id"]).groupBy("project_id", F.col("b_id").alias("clip_id")).agg(F.max_by("ppm", "ordinal").alias("drift_ppm"))
        placements = placements.join(last, ["project_id", "clip_id"], "left")
    else:
        placements = placements.withColumn("drift_ppm", F.lit(None).cast("double"))
    refused = solved.groupBy("project_id").agg(F.max("refused").cast("long").alias("rejected_by_overlap"))
    stats = gate_stats(pairs).join(refused, "project_id")
    columns = ["project_id", "clip_index", "clip_id", "track_id", "start_seconds", "synced", "quality", "group_id", "drift_ppm"]
    return SyncResult(placements.select(columns), pairs, tree, wrong, stats, drift)
