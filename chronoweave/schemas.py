"""Schemas of the tables that operators pass on."""

from __future__ import annotations

#: One recording: a uniformly sampled signal and what is known of it. ``clip_index`` is the supplied order.
CLIPS = (
    "project_id string, clip_index int, clip_id string, track_id string, name string, sample_rate double, samples array<double>, "
    "timecode_seconds double, recorded_at_seconds double, recorded_at_source string, frame_rate double"
)
#: Long signals in pieces; ``start_sample`` = chunk_idx * the chunk length.
SIGNAL_CHUNKS = "project_id string, clip_id string, chunk_idx int, start_sample long, samples array<double>"
#: Features of a clip.
PREPARED = (
    "project_id string, clip_index int, clip_id string, track_id string, sample_rate double, n_samples long, duration_seconds double, dc double, "
    "timecode_seconds double, trusted_at double, coarse array<double>, coarse_rate double, envelope array<double>, envelope_rate double"
)
#: An edge between two clips, i < j in supplied order.
PAIRS = (
    "project_id string, i int, j int, a_id string, b_id string, offset_seconds double, quality double, psr double, overlap_seconds double, method string, accepted boolean"
)
PLACEMENTS = "project_id string, clip_index int, clip_id string, track_id string, start_seconds double, synced boolean, quality double, group_id int, drift_ppm double"
INCONSISTENCIES = "project_id string, a_id string, b_id string, error_seconds double, kind string"
DRIFT = "project_id string, a_id string, b_id string, ppm double, r2 double, total_slip_seconds double, n_samples int"
