"""DuckDB SQL with the same rows as the queries of that name."""

from __future__ import annotations

from .functions.signal import decimation_taps
from .functions.text import AUDIO, MEDIA
from .options import FRAME_RATES

_VECTORS = "v AS (SELECT vec_id AS clip_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_LAGS = f"""{_VECTORS}, ids AS (SELECT vec_id AS id, label FROM embeddings),
b AS (SELECT a.id AS a_id, b.id AS b_id FROM ids a JOIN ids b ON a.id < b.id AND a.label = b.label),
l AS (SELECT a_id, b_id, x.i - y.i AS lag, corr(x.x, y.x) AS r, sum(x.x * y.x) AS product, count(*) AS n FROM b JOIN v x ON x.clip_id = a_id JOIN v y ON y.clip_id = b_id GROUP BY ALL)"""
_HOURLY = """e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, sum(value) AS x FROM events GROUP BY ALL),
g AS (SELECT DISTINCT event_type, CAST(floor(h / 24.0) AS BIGINT) AS day FROM e),
v AS (SELECT g.event_type || '/' || g.day AS clip_id, k AS i, coalesce(e.x, 0.0::DOUBLE) AS x FROM g CROSS JOIN (SELECT unnest(range(0, 24)) AS k) LEFT JOIN e ON e.event_type = g.event_type AND e.h = g.day * 24 + k)"""
_LINES = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line FROM lineitem)"
_RECORDINGS = f"""{_LINES}, c AS (SELECT CAST(l_partkey AS VARCHAR) AS project_id, l_orderkey * 100 + line AS clip_index, l_orderkey || '-' || line AS clip_id, CAST(l_suppkey AS VARCHAR) AS track_id,
l_quantity * 60.0::DOUBLE AS d, floor(epoch(l_shipdate)) / 5000.0::DOUBLE AS took_at, CASE WHEN l_returnflag <> 'N' THEN floor(epoch(l_shipdate)) / 5000.0::DOUBLE END AS t FROM li)"""
_SCREEN = f"""{_RECORDINGS}, p AS (SELECT a.project_id, a.clip_index AS i, b.clip_index AS j, a.clip_id AS a_id, b.clip_id AS b_id, a.track_id AS a_track, b.track_id AS b_track,
coalesce(a.t - a.d - 3600 <= b.t + b.d + 3600 AND b.t - b.d - 3600 <= a.t + a.d + 3600, true) AS allowed FROM c a JOIN c b ON a.project_id = b.project_id AND a.clip_index < b.clip_index),
e1 AS (SELECT project_id, i AS k, allowed FROM p WHERE a_track <> b_track UNION ALL SELECT project_id, j, allowed FROM p WHERE a_track <> b_track),
f1 AS (SELECT project_id, k FROM e1 GROUP BY ALL HAVING NOT bool_or(allowed)),
p1 AS (SELECT * EXCLUDE (allowed), allowed OR EXISTS (SELECT 1 FROM f1 WHERE f1.project_id = p.project_id AND f1.k = p.i) OR EXISTS (SELECT 1 FROM f1 WHERE f1.project_id = p.project_id AND f1.k = p.j) AS allowed FROM p),
e2 AS (SELECT project_id, a_track AS k, allowed FROM p1 WHERE a_track <> b_track UNION ALL SELECT project_id, b_track, allowed FROM p1 WHERE a_track <> b_track),
f2 AS (SELECT project_id, k FROM e2 GROUP BY ALL HAVING NOT bool_or(allowed)),
s AS (SELECT project_id, a_id, b_id, CASE WHEN a_track = b_track THEN 'same-device' WHEN NOT (allowed OR EXISTS (SELECT 1 FROM f2 WHERE f2.project_id = p1.project_id AND f2.k = p1.a_track) OR EXISTS (SELECT 1 FROM f2 WHERE f2.project_id = p1.project_id AND f2.k = p1.b_track)) THEN 'recording-time' ELSE 'compared' END AS verdict FROM p1)"""
_MADE = f"""{_LINES}, n AS (SELECT *, lead(line) OVER (PARTITION BY l_orderkey ORDER BY line) AS b FROM li),
m AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS project_id, l_orderkey AS o, line AS i, b AS j, l_orderkey || '-' || line AS a_id, l_orderkey || '-' || b AS b_id, l_extendedprice / 1000 AS off, l_discount * 10 AS quality, l_quantity / 4 AS psr, l_tax * 100 AS overlap,
CASE WHEN l_linestatus = 'F' THEN 'none' ELSE 'waveform' END AS method, l_discount * 10 >= 0.3 AND l_quantity / 4 >= 6 AND l_tax * 100 >= 3 AS accepted FROM n WHERE b IS NOT NULL)"""
_KINDS = "['MP4', 'wav', 'mov', 'mp3', 'txt']"
_NAMES = "['C2_', 'A001C0', 'clip', 'Z', '01 ', 'GX-']"
_PATHS = rf"""f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE page_id % 7 WHEN 0 THEN '/PRIVATE/AVCHD' WHEN 1 THEN '/DCIM' WHEN 2 THEN '/Contents/CLIP' ELSE '' END || '/' ||
{_NAMES}[CAST(page_id % 6 AS INTEGER) + 1] || lpad(CAST(page_id AS VARCHAR), CAST(greatest(4, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '.' || {_KINDS}[CAST(page_id % 5 AS INTEGER) + 1] AS path,
CAST(length(html) AS BIGINT) AS size, page_id * 1000 AS modified, page_id % 4 <> 0 AS has_video FROM pages),
q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM f), w AS (SELECT *, parts[len(parts)] AS base FROM q)"""
_OLD_NEW = f"""{_PATHS}, o AS (SELECT path, size, modified FROM w),
k AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'moved/' || path WHEN page_id % 11 = 0 THEN path || '.new' ELSE path END AS path, size + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS size, modified + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS modified FROM w)"""


def _sanitised(x: str) -> str:
    clean = f"upper(regexp_replace(regexp_replace(trim({x}), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'))"
    return f"CASE WHEN {clean} = '' THEN 'DEVICE' ELSE {clean} END"


def _timecode(drop: bool) -> str:
    f = "(o_orderkey * 37)"
    count = f"({f} + 2 * (9 * ({f} // 17982) + CASE WHEN {f} % 17982 >= 2 THEN ({f} % 17982 - 2) // 1798 ELSE 0 END))" if drop else f
    n, sep = (30, ";") if drop else (25, ":")
    hour = f"({count} // {n * 3600})"
    return f"CASE WHEN {hour} < 100 THEN lpad(CAST({hour} AS VARCHAR), 2, '0') ELSE CAST({hour} AS VARCHAR) END || ':' || lpad(CAST({count} // {n * 60} % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({count} // {n} % 60 AS VARCHAR), 2, '0') || '{sep}' || lpad(CAST({count} % {n} AS VARCHAR), 2, '0')"


_TAPS = ", ".join(f"{v!r}::DOUBLE" for v in decimation_taps(2).tolist())
_HALF = (len(decimation_taps(2)) - 1) // 2
_RATES = ", ".join(f"({k}, '{label}', {r.fps!r}::DOUBLE)" for k, (label, r) in enumerate(FRAME_RATES))
_PICTURES = "pic AS (SELECT p_brand AS project_id, p_partkey AS clip_index, CAST(640 + p_size % 4 * 320 AS INTEGER) AS width, CAST(360 + p_size % 4 * 180 AS INTEGER) AS height, [23.976::DOUBLE, 24.0::DOUBLE, 25.0::DOUBLE, 29.97::DOUBLE, 50.0::DOUBLE, 12.0::DOUBLE][p_size % 6 + 1] AS rate FROM part)"
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CARD = "".join(
    f" WHEN {p} > 1 THEN {_sanitised(f'parts[{p} - 1]')} WHEN {p} = 1 THEN '{label}_CARD'"
    for p, label in (
        ("pa", "AVCHD"), ("list_position(low, 'avchd')", "AVCHD"), ("list_position(low, 'bpav')", "XDCAM"), ("cc", "P2"), ("list_position(low, 'contents')", "CanonXF"), ("list_position(low, 'dcim')", "DCIM"),
    )
)
_FIRST_RUN = "coalesce(list_min(list_filter(range(1, len(low)), lambda i: low[i] = '{}' AND low[i + 1] = '{}')), 0)"
_DEVICE = "coalesce(nullif(regexp_extract(bare, '^([A-Za-z][0-9]{3})[A-Za-z][0-9]{3,4}', 1), ''), nullif(regexp_extract(bare, '^([^_.-]*[A-Za-z][^_.-]*)[_.-]', 1), ''), nullif(regexp_extract(bare, '^([A-Za-z]{2,})', 1), ''), nullif(regexp_extract(bare, '^([A-Za-z])[0-9]+$', 1), ''))"
_SPANS = "sp AS (SELECT project_id || '/' || track_id AS g, clip_id AS id, took_at AS s, took_at + d AS e FROM c), pr AS (SELECT *, lag(id) OVER o AS prior_id, lag(e) OVER o AS prior_end FROM sp WINDOW o AS (PARTITION BY g ORDER BY s, id))"

ORACLE_SQL = {
    "pair_lag_pearson": f"WITH {_LAGS}, r AS (SELECT a_id, b_id, lag, round(r, 9) AS r FROM l WHERE n >= 24) SELECT a_id, b_id, CAST(arg_min(lag, [-r, lag]) AS BIGINT) AS lag, round(max(r), 6) AS r FROM r GROUP BY ALL",
    "pair_xcorr_peak": f"WITH {_LAGS}, r AS (SELECT a_id, b_id, lag, round(product, 9) AS product FROM l) SELECT a_id, b_id, CAST(arg_min(lag, [-product, lag]) AS BIGINT) AS lag, round(max(product), 6) AS peak FROM r GROUP BY ALL",
    "log_energy_envelope": f"WITH {_VECTORS}, w AS (SELECT clip_id, i, avg(x * x) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS p, count(*) OVER (PARTITION BY clip_id) AS n FROM v) SELECT clip_id, CAST(i // 4 AS BIGINT) AS k, round(10 * log10(p + 1e-10::DOUBLE), 6) AS level FROM w WHERE i % 4 = 0 AND i + 8 <= n",
    "fir_decimate": f"WITH {_VECTORS}, h AS (SELECT unnest(range(0, {2 * _HALF + 1})) AS m, unnest([{_TAPS}]) AS h), s AS (SELECT clip_id, i - {_HALF} + m AS o, sum(x * h) AS y FROM v CROSS JOIN h GROUP BY ALL), z AS (SELECT clip_id, count(*) AS n FROM v GROUP BY ALL) SELECT clip_id, CAST(o // 2 AS BIGINT) AS k, round(y, 6) AS y FROM s JOIN z USING (clip_id) WHERE o >= 0 AND o % 2 = 0 AND o // 2 < n // 2",
    "remove_dc_rms": f"WITH {_HOURLY}, c AS (SELECT clip_id, i, x - avg(x) OVER (PARTITION BY clip_id) AS x FROM v), r AS (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY clip_id)) AS s FROM c) SELECT clip_id, CAST(i AS BIGINT) AS i, round(CASE WHEN s > 0 THEN x / s ELSE x END, 6) AS x FROM r",
    "peak_summary": f"WITH {_HOURLY}, b AS (SELECT clip_id, CAST(floor(i * 6 / 24.0) AS BIGINT) AS bucket, max(abs(x)) AS peak FROM v GROUP BY ALL) SELECT clip_id, bucket, round(CASE WHEN max(peak) OVER w > 0 THEN peak / max(peak) OVER w ELSE peak END, 6) AS peak FROM b WINDOW w AS (PARTITION BY clip_id)",
    "recording_time_gate": f"WITH {_RECORDINGS} SELECT a.clip_id AS a_id, b.clip_id AS b_id FROM c a JOIN c b ON a.project_id = b.project_id AND a.clip_index < b.clip_index AND a.track_id <> b.track_id AND (a.t IS NULL OR b.t IS NULL OR (a.t - a.d - 3600 <= b.t + b.d + 3600 AND b.t - b.d - 3600 <= a.t + a.d + 3600))",
    "pair_screen": f"WITH {_RECORDINGS} SELECT a.clip_id AS a_id, b.clip_id AS b_id, CASE WHEN a.track_id = b.track_id THEN 'same-device' WHEN a.t IS NULL OR b.t IS NULL OR (a.t - a.d - 3600 <= b.t + b.d + 3600 AND b.t - b.d - 3600 <= a.t + a.d + 3600) THEN 'compared' ELSE 'recording-time' END AS verdict FROM c a JOIN c b ON a.project_id = b.project_id AND a.clip_index < b.clip_index",
    "gate_rescue": f"WITH {_SCREEN} SELECT a_id, b_id, verdict FROM s",
    "gate_stats": f"WITH {_SCREEN} SELECT project_id, count(*) AS total_pairs, count(*) FILTER (verdict = 'compared') AS aligned_pairs, count(*) FILTER (verdict = 'same-device') AS skipped_same_device, count(*) FILTER (verdict = 'recording-time') AS skipped_by_recording_time FROM s GROUP BY ALL",
    "device_overlap_report": f"WITH {_RECORDINGS}, {_SPANS} SELECT g AS device, prior_id, id, round(prior_end - s, 3) AS overlap FROM pr WHERE prior_end - s > 0.02",
    "hidden_clips": f"WITH {_RECORDINGS}, {_SPANS} SELECT g AS track, count(*) FILTER (s < prior_end) AS hidden FROM pr GROUP BY ALL",
    "edge_score_rank": f"WITH {_MADE}, s AS (SELECT project_id, a_id, b_id, round(10 * quality + log10(1 + overlap) + log10(1 + psr), 6) AS score FROM m WHERE accepted) SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, a_id, b_id) AS rank FROM s",
    "rejection_reason": f"WITH {_MADE} SELECT a_id, b_id, concat_ws('; ', CASE WHEN overlap < 3 THEN 'overlap too short' END, CASE WHEN quality < 0.3 THEN 'quality too low' END, CASE WHEN psr < 6 THEN 'peak not distinct' END) AS reason FROM m WHERE NOT accepted",
    "quality_distribution": f"WITH {_MADE}, q AS (SELECT project_id, list_sort(list(quality)) AS l FROM m WHERE accepted GROUP BY ALL) SELECT project_id, round(l[1], 6) AS worst, round(l[len(l) // 2 + 1], 6) AS median, round(l[len(l)], 6) AS best, CAST(len(list_filter(l, lambda x: x < 0.5)) AS BIGINT) AS below_half FROM q",
    "best_pair_per_clip": f"WITH {_MADE}, e AS (SELECT project_id, a_id AS clip_id, b_id AS other_id, quality FROM m WHERE method <> 'none' UNION ALL SELECT project_id, b_id, a_id, quality FROM m WHERE method <> 'none'), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY quality DESC, other_id) AS k FROM e) SELECT project_id, clip_id, other_id, round(quality, 6) AS quality FROM r WHERE k = 1",
    "drift_regression": "WITH e AS (SELECT user_id, floor(epoch(ts)) - 1704067200.0::DOUBLE AS t, value AS y FROM events), f AS (SELECT user_id, count(*) AS n_samples, regr_slope(y, t) AS s, regr_r2(y, t) AS r2, var_pop(y) AS v, max(t) - min(t) AS span FROM e GROUP BY ALL) SELECT user_id, n_samples, round(CASE WHEN n_samples < 3 THEN 0.0::DOUBLE ELSE -coalesce(s, 0.0::DOUBLE) * 1e6 END, 4) AS ppm, round(CASE WHEN n_samples < 3 OR v = 0 THEN 0.0::DOUBLE ELSE coalesce(r2, 0.0::DOUBLE) END, 6) AS r2, round(CASE WHEN n_samples < 3 THEN 0.0::DOUBLE ELSE coalesce(s, 0.0::DOUBLE) END * span, 6) AS total_slip_seconds FROM f",
    "timeline_layout": f"""WITH {_LINES}, r AS (SELECT CAST(l_suppkey AS VARCHAR) AS project_id, l_orderkey * 100 + line AS k, l_orderkey AS g, l_orderkey || '-' || line AS clip_id, CAST(l_partkey AS VARCHAR) AS device, l_quantity AS d FROM li),
p AS (SELECT *, CAST(k - min(k) OVER w AS DOUBLE) AS pos, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY project_id, g)),
x AS (SELECT project_id, g, n, max(pos + d) + 5 AS extent FROM p WHERE n > 1 GROUP BY ALL),
b AS (SELECT *, coalesce(sum(extent) OVER (PARTITION BY project_id ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS base FROM x),
z AS (SELECT project_id, sum(extent) AS synced_end FROM x GROUP BY ALL),
v AS (SELECT project_id, device, min(k) AS first, sum(d) + 5 AS len FROM p WHERE n = 1 GROUP BY ALL),
y AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY project_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS device_base FROM v),
l AS (SELECT p.*, coalesce(sum(d) OVER (PARTITION BY project_id, device ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS inn FROM p WHERE n = 1)
SELECT p.project_id, clip_id, round(base + pos, 6) AS start_seconds, true AS synced FROM p JOIN b ON b.project_id = p.project_id AND b.g = p.g WHERE p.n > 1
UNION ALL SELECT l.project_id, clip_id, round(coalesce(synced_end, 0.0::DOUBLE) + device_base + inn, 6), false FROM l JOIN y ON y.project_id = l.project_id AND y.device = l.device LEFT JOIN z ON z.project_id = l.project_id""",
    "sync_components": f"""WITH RECURSIVE {_MADE}, e AS (SELECT project_id, o * 100 + i AS i, o * 100 + j AS j FROM m WHERE accepted),
b AS (SELECT project_id, i AS u, j AS v FROM e UNION ALL SELECT project_id, j, i FROM e),
r AS (SELECT project_id, u AS clip_index, u AS root FROM b UNION SELECT b.project_id, b.v, r.root FROM r JOIN b ON b.project_id = r.project_id AND b.u = r.clip_index AND r.root < b.v)
SELECT project_id, clip_index, min(root) AS root FROM r GROUP BY ALL""",
    "filename_prefix": f"WITH {_PATHS}, n AS (SELECT page_id, {_DEVICE} AS device FROM (SELECT *, regexp_replace(base, '\\.[^.]+$', '') AS bare FROM w)) SELECT page_id, CASE WHEN device IS NOT NULL THEN {_sanitised('device')} END AS device FROM n",
    "card_device": f"WITH {_PATHS}, l AS (SELECT *, list_transform(parts, lambda x: lower(x)) AS low FROM w), a AS (SELECT *, {_FIRST_RUN.format('private', 'avchd')} AS pa, {_FIRST_RUN.format('contents', 'clip')} AS cc FROM l) SELECT page_id, CASE{_CARD} END AS device FROM a",
    "extension_class": f"WITH {_PATHS}, x AS (SELECT page_id, lower(regexp_extract(base, '^.+\\.([^.]*)$', 1)) AS extension FROM w) SELECT page_id, extension, CASE WHEN extension IN ({_in(AUDIO)}) THEN 'AUDIO' ELSE 'VIDEO' END AS class FROM x WHERE extension IN ({_in(MEDIA)})",
    "sanitise": f"WITH {_PATHS} SELECT page_id, {_sanitised('path')} AS name, upper(regexp_replace(path, '[^A-Za-z0-9]', '', 'g')) AS token FROM w",
    "upsert_merge": f"WITH {_OLD_NEW} SELECT coalesce(k.path, o.path) AS path, CASE WHEN k.path IS NULL THEN o.size ELSE k.size END AS size, CASE WHEN k.path IS NULL THEN o.modified ELSE k.modified END AS modified FROM o FULL JOIN k ON o.path = k.path",
    "changed_files": f"WITH {_OLD_NEW} SELECT path, size, modified FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = k.path AND o.size = k.size AND o.modified = k.modified)",
    "relink_tiers": f"""WITH {_OLD_NEW}, o1 AS (SELECT *, regexp_extract(path, '[^/]+/*$', 0) AS name FROM o), k1 AS (SELECT *, regexp_extract(path, '[^/]+/*$', 0) AS name FROM k),
m1 AS (SELECT x.path, y.path AS found FROM (SELECT *, row_number() OVER (PARTITION BY path, size, modified ORDER BY path) AS n FROM o1) x JOIN (SELECT *, row_number() OVER (PARTITION BY path, size, modified ORDER BY path) AS n FROM k1) y ON x.path = y.path AND x.size = y.size AND x.modified = y.modified AND x.n = y.n),
o2 AS (SELECT * FROM o1 WHERE path NOT IN (SELECT path FROM m1)), k2 AS (SELECT * FROM k1 WHERE path NOT IN (SELECT found FROM m1)),
m2 AS (SELECT x.path, y.path AS found FROM (SELECT *, row_number() OVER (PARTITION BY size, modified ORDER BY path) AS n FROM o2) x JOIN (SELECT *, row_number() OVER (PARTITION BY size, modified ORDER BY path) AS n FROM k2) y ON x.size = y.size AND x.modified = y.modified AND x.n = y.n),
o3 AS (SELECT * FROM o2 WHERE path NOT IN (SELECT path FROM m2)), k3 AS (SELECT * FROM k2 WHERE path NOT IN (SELECT found FROM m2)),
m3 AS (SELECT x.path, y.path AS found FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY path) AS n FROM o3) x JOIN (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY path) AS n FROM k3) y ON x.name = y.name AND x.size = y.size AND x.n = y.n)
SELECT path, found, 'exact' AS tier FROM m1 UNION ALL SELECT path, found, 'moved' FROM m2 UNION ALL SELECT path, found, 'renamed' FROM m3 UNION ALL SELECT path, NULL, 'missing' FROM o3 WHERE path NOT IN (SELECT path FROM m3)""",
    "idslug_escape": """SELECT page_id, CASE WHEN s = '' THEN '_' ELSE s END AS slug, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM (SELECT *, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[^A-Za-z_]+', '_') AS s FROM pages)""",
    "path_to_url": f"WITH {_PATHS}, u AS (SELECT page_id, '/' || path || ' (1)~''!*&x=é' AS p FROM w) SELECT page_id, 'file://' || replace(replace(replace(replace(replace(replace(replace(url_encode(p), '%2F', '/'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '+', '%20') AS url FROM u",
    "smpte_ndf": f"SELECT o_orderkey, {_timecode(False)} AS timecode FROM orders",
    "smpte_df": f"SELECT o_orderkey, {_timecode(True)} AS timecode FROM orders",
    "timecode_parse": "SELECT o_orderkey, CAST(o_orderkey * 37 AS BIGINT) AS frames FROM orders",
    "frame_size_mode": f"WITH {_PICTURES}, c AS (SELECT project_id, width, height, count(*) AS n FROM pic GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, width * height DESC) AS k FROM c) SELECT project_id, width, height FROM r WHERE k = 1",
    "frame_rate_mode": f"WITH {_PICTURES}, f(o, label, fps) AS (VALUES {_RATES}), m AS (SELECT project_id, clip_index, arg_min(label, o) AS label FROM pic JOIN f ON abs(rate - fps) < 0.01 GROUP BY ALL), c AS (SELECT project_id, label, count(*) AS n, min(clip_index) AS seen FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, seen) AS k FROM c), a AS (SELECT DISTINCT project_id FROM pic) SELECT a.project_id, coalesce(label, '25') AS label FROM a LEFT JOIN r ON r.project_id = a.project_id AND k = 1",
    "device_summary": "SELECT l_suppkey AS device, count(*) AS clips, round(sum(l_quantity) / 60, 6) AS minutes, count(DISTINCT l_returnflag || l_linestatus) AS formats FROM lineitem GROUP BY ALL",
    "rate_histogram": f"WITH {_PICTURES} SELECT project_id, round(rate, 3) AS frame_rate, count(*) AS clips FROM pic GROUP BY ALL",
}

_LAYOUT = ORACLE_SQL["timeline_layout"]
_QUANTITIES = f"{_LINES}, d AS (SELECT CAST(l_suppkey AS VARCHAR) AS project_id, l_orderkey || '-' || line AS clip_id, l_quantity AS duration_seconds FROM li)"
ORACLE_SQL |= {
    "islands": f"WITH r AS (SELECT *, split_part(clip_id, '-', 1) AS group_id, row_number() OVER (PARTITION BY project_id, split_part(clip_id, '-', 1) ORDER BY start_seconds, clip_id) AS nth FROM ({_LAYOUT}) WHERE synced) SELECT project_id, group_id, count(*) AS clips, string_agg(clip_id, ',' ORDER BY nth) FILTER (nth <= 8) AS members FROM r GROUP BY project_id, group_id",
    "timeline_percent": f"WITH {_QUANTITIES}, j AS (SELECT l.project_id, l.clip_id, start_seconds, duration_seconds, greatest(max(start_seconds + duration_seconds) OVER (PARTITION BY l.project_id), 1e-9::DOUBLE) AS total FROM ({_LAYOUT}) l JOIN d ON d.project_id = l.project_id AND d.clip_id = l.clip_id) SELECT project_id, clip_id, round(100 * start_seconds / total, 6) AS left_edge, round(100 * duration_seconds / total, 6) AS width FROM j",
    "too_short": f"WITH {_QUANTITIES} SELECT l.project_id, l.clip_id, duration_seconds FROM ({_LAYOUT}) l JOIN d ON d.project_id = l.project_id AND d.clip_id = l.clip_id WHERE NOT synced AND duration_seconds < 3",
    "can_sync": f"WITH {_RECORDINGS} SELECT project_id, count(*) AS clips, count(DISTINCT track_id) AS devices, count(*) >= 2 AND count(DISTINCT track_id) >= 2 AS can_sync FROM c GROUP BY project_id",
    "disagreement_counts": f"WITH {_MADE} SELECT project_id, count(*) FILTER (abs(psr - 6) >= 0.5) AS over_frame, count(*) FILTER (abs(psr - 6) < 0.5) AS sub_frame FROM m GROUP BY project_id",
}
