"""SQL over the driver's tables that the registered queries are held against."""

from __future__ import annotations

#: Fixed values, as published for WGS84: rectifying radius, and the transverse Mercator series' coefficients by multiple of the angle.
UTM_EAST, UTM_SCALE, WGS84_F = 500000.0, 0.9996, 1 / 298.257223563
RADIUS = 6367449.145823415
ALPHA = (8.377318206244698e-4, 7.608527773572307e-7, 1.197645503329453e-9, 2.429170607201359e-12)

POINTS = """
WITH pt AS (
  SELECT event_id, user_id, event_type, ts, CAST(value AS DOUBLE) AS value,
    CASE WHEN event_id % 97 <> 0 THEN 'cell_' || (user_id % 40) || '_' || (user_id // 40) END AS cell_id,
    36 + 0.03::DOUBLE * (user_id % 10) AS lat, -120 + 0.04::DOUBLE * ((3 * (user_id % 10)) % 10) AS lon FROM events),
w AS (
  SELECT *, sqrt(u10 * u10 + v10 * v10) AS wind_speed, (degrees(atan2(v10, u10)) + 360) % 360 AS wind_dir
  FROM (SELECT *, date_trunc('hour', ts) AS b, (7 * event_id) % 21 - 10 AS u10, (13 * event_id) % 17 - 8 AS v10 FROM pt WHERE event_type <> 'error')),
f AS (SELECT *, date_trunc('hour', ts) AS b FROM pt WHERE event_type = 'error')"""
PANEL = POINTS + """,
wa AS (
  SELECT cell_id, b, avg(value) AS t2m_mean, max(value) AS t2m_max, avg(u10) AS u10_mean, avg(v10) AS v10_mean, avg(wind_speed) AS wind_speed_mean,
    avg(wind_dir) AS wind_dir_mean, count(*) AS n FROM w WHERE cell_id IS NOT NULL GROUP BY ALL),
fa AS (SELECT cell_id, b, sum(value) AS frp_sum, count(*) AS c FROM f WHERE cell_id IS NOT NULL GROUP BY ALL),
pa AS (
  SELECT coalesce(wa.cell_id, fa.cell_id) AS cell_id, coalesce(wa.b, fa.b) AS b, CAST(epoch(coalesce(wa.b, fa.b)) AS BIGINT) // 3600 AS h,
    coalesce(t2m_mean, 0) AS t2m_mean, coalesce(t2m_max, 0) AS t2m_max, coalesce(u10_mean, 0) AS u10_mean, coalesce(v10_mean, 0) AS v10_mean,
    coalesce(wind_speed_mean, 0) AS wind_speed_mean, coalesce(wind_dir_mean, 0) AS wind_dir_mean,
    coalesce(n, 0) AS n, coalesce(frp_sum, 0) AS frp_sum, coalesce(c, 0) AS c, c IS NOT NULL AS fire FROM wa FULL JOIN fa ON wa.cell_id = fa.cell_id AND wa.b = fa.b),
ce AS (SELECT DISTINCT cell_id, CAST(split_part(cell_id, '_', 2) AS INT) AS i, CAST(split_part(cell_id, '_', 3) AS INT) AS j FROM pa)"""
EDGES = PANEL + """,
kn AS (
  SELECT source, target, d, si, sj, ti, tj FROM (
    SELECT a.cell_id AS source, c.cell_id AS target, a.i AS si, a.j AS sj, c.i AS ti, c.j AS tj, 1000 * sqrt((a.i - c.i) ** 2 + (a.j - c.j) ** 2) AS d,
      row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.i - c.i) ** 2 + (a.j - c.j) ** 2, c.cell_id) AS r
    FROM ce a JOIN ce c ON a.cell_id <> c.cell_id) WHERE r <= 8),
al AS (
  SELECT p.h, source, target, d, si, sj, ti, tj, p.frp_sum AS frp_src, p.wind_dir_mean AS wind_src, q.frp_sum AS frp_tgt, coalesce(q.fire, false) AS tb
  FROM pa p JOIN kn ON p.cell_id = source LEFT JOIN pa q ON q.cell_id = target AND q.h = p.h WHERE p.fire),
ca AS (SELECT * FROM al WHERE NOT tb),
la AS (SELECT ca.*, CASE WHEN EXISTS (SELECT 1 FROM pa z WHERE z.fire AND z.cell_id = target AND z.h > ca.h AND z.h <= ca.h + 24) THEN 1 ELSE 0 END AS label FROM ca),
sc AS (SELECT *, (((h * 31 + 7 * (ti - si) + 13 * (tj - sj)) % 1000 + 1000) % 1000) / 1000.0 AS p FROM la)"""
TOPO = """,
tp AS (
  SELECT 'cell_' || (c_custkey % 40) || '_' || ((c_custkey // 40) % 38) AS cell_id, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS elevation,
    CAST((c_custkey * 7919) % 45 AS DOUBLE) AS slope, c_mktsegment AS landcover
  FROM customer WHERE (c_custkey % 40 + 7 * ((c_custkey // 40) % 38)) % 13 <> 5),
tn AS (SELECT cell_id, landcover, count(*) AS n FROM tp GROUP BY ALL),
tm AS (SELECT cell_id, landcover, n / sum(n) OVER (PARTITION BY cell_id) AS share, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, landcover) AS r FROM tn),
st AS (
  SELECT cell_id, avg(elevation) AS elevation_mean, stddev_samp(elevation) AS elevation_std, min(elevation) AS elevation_min, max(elevation) AS elevation_max,
    avg(slope) AS slope_mean, stddev_samp(slope) AS slope_std, min(slope) AS slope_min, max(slope) AS slope_max FROM tp GROUP BY 1)"""
PLACES = """
WITH c AS (
  SELECT c_custkey, 500000.0::DOUBLE + 1000 * (c_custkey % 40) + 50 + 37 * (c_custkey % 23) AS x, 4000000.0::DOUBLE + 1000 * ((c_custkey // 40) % 38) + 50 + 41 * (c_custkey % 19) AS y FROM customer),
z AS (SELECT min(x) AS x0, min(y) AS y0, CAST(ceil((max(x) - min(x)) / 1000) AS INTEGER) AS nx, CAST(ceil((max(y) - min(y)) / 1000) AS INTEGER) AS ny FROM c)"""
STATIONS = """,
sn AS (SELECT CAST(row_number() OVER (ORDER BY lat, lon) - 1 AS INTEGER) AS station_idx, lat, lon FROM (SELECT DISTINCT lat, lon FROM w)),
ns AS (
  SELECT cell_id, arg_min(station_idx, d) AS station_idx, min(d) AS d FROM (
    SELECT cell_id, station_idx, 2 * 6371000 * asin(least(1, sqrt(sin(radians(lat - cl) / 2) ** 2 + cos(radians(cl)) * cos(radians(lat)) * sin(radians(lon - co) / 2) ** 2))) AS d
    FROM (SELECT cell_id, -120 + 0.01::DOUBLE * i AS co, 36 + 0.01::DOUBLE * j AS cl FROM ce), sn) GROUP BY 1)"""
AXIS = PANEL + """,
ax AS (SELECT cell_id, h, CAST(h - lo AS INTEGER) AS t FROM (SELECT DISTINCT cell_id FROM pa), (SELECT min(h) AS lo, max(h) AS hi FROM pa), LATERAL (SELECT unnest(range(lo, hi + 1)) AS h)),
te AS (
  SELECT ax.cell_id, t, ax.h, CAST(coalesce(frp_sum, 0) AS FLOAT) AS frp_sum, CAST(coalesce(t2m_mean, 0) AS FLOAT) AS t2m_mean, CAST(coalesce(wind_speed_mean, 0) AS FLOAT) AS wind_speed_mean,
    CAST(coalesce(u10_mean, 0) AS FLOAT) AS u10_mean, CAST(coalesce(v10_mean, 0) AS FLOAT) AS v10_mean, CAST(coalesce(fire, false) AS INTEGER) AS y FROM ax LEFT JOIN pa ON pa.cell_id = ax.cell_id AND pa.h = ax.h),
tl AS (SELECT *, CASE WHEN y = 0 THEN coalesce(max(y) OVER (PARTITION BY cell_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0) ELSE 0 END AS ahead FROM te)"""
MIDDLE = """,
bh AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT h FROM pa WHERE fire)),
mi AS (SELECT h AS mid FROM bh WHERE r = n // 2)"""
ENDS = "500500 + 1000.0::DOUBLE * si AS sx, 4000500 + 1000.0::DOUBLE * sj AS sy, 500500 + 1000.0::DOUBLE * ti AS tx, 4000500 + 1000.0::DOUBLE * tj AS ty"
STATIC = ("elevation_mean", "elevation_std", "elevation_min", "elevation_max", "slope_mean", "slope_std")
EXAMPLES = EDGES + TOPO + """,
tr AS (SELECT cell_id, h, regr_slope(frp_sum, h) OVER (PARTITION BY cell_id ORDER BY h RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS k FROM pa),
nb AS (SELECT h, source, count(*) FILTER (tb) AS bc, coalesce(avg(frp_tgt), 0) AS mf FROM al GROUP BY ALL),
ex AS (
  SELECT la.*, CASE WHEN k IS NULL OR isnan(k) THEN 0 ELSE k END AS trend, bc, mf, (degrees(atan2(tj - sj, ti - si)) + 360) % 360 AS angle
  FROM la JOIN tr ON tr.cell_id = source AND tr.h = la.h JOIN nb ON nb.source = la.source AND nb.h = la.h)"""


def fixed(*columns: str, digits: int = 6) -> str:
    """Rounded columns; 'a AS b' renames."""
    parts = [c.split(" AS ") for c in columns]
    return ", ".join(f"round({p[0]}, {digits}) + 0.0 AS {p[-1]}" for p in parts)


def bin_of(column: str = "b") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS datetime_bin"


def projection() -> str:
    """The transverse Mercator series of the library's projection, written out."""
    radius, alpha = RADIUS, ALPHA
    e = (WGS84_F * (2 - WGS84_F)) ** 0.5
    wave = lambda a, b: "".join(f" + {k!r} * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, k in enumerate(alpha, 1))
    return PANEL + f""",
ll AS (SELECT cell_id, -120 + 0.01::DOUBLE * i AS lon, 36 + 0.01::DOUBLE * j AS lat FROM ce),
zo AS (SELECT CAST(floor(((min(lon) + max(lon)) / 2 + 180) / 6) + 1 AS INTEGER) AS zone FROM ll),
t1 AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sin(radians(lat)) AS s FROM ll, zo),
t2 AS (SELECT *, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM t1),
t3 AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t2)
SELECT cell_id, zone, round({UTM_EAST} + {UTM_SCALE * radius!r} * (eta{wave("cos", "sinh")}), 2) AS east, round({UTM_SCALE * radius!r} * (xi{wave("sin", "cosh")}), 2) AS north,
  round(lon, 7) AS lon_back, round(lat, 7) AS lat_back FROM t3"""


ORACLE = {
    "assigned_points": POINTS + " SELECT event_id, cell_id FROM pt",
    "fire_cell_time": POINTS + " SELECT cell_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS datetime_bin, round(sum(value), 6) AS frp_sum, round(max(value), 6) AS frp_max, round(avg(300 + value / 10), 6) AS brightness_mean, round(max(300 + value / 10), 6) AS brightness_max, CAST(count(*) AS INTEGER) AS fire_count, true AS fire_any FROM f WHERE cell_id IS NOT NULL GROUP BY cell_id, b",
    "panel_sparse": PANEL + " SELECT cell_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS datetime_bin, h AS epoch_hr, round(t2m_mean, 6) AS t2m_mean, round(t2m_max, 6) AS t2m_max, n AS _obs_count_sum, round(frp_sum, 6) AS frp_sum, CAST(c AS INTEGER) AS fire_count, fire AS fire_any FROM pa",
    "stations": "SELECT CAST(row_number() OVER (ORDER BY lat, lon) - 1 AS INTEGER) AS station_idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT DISTINCT 36 + 0.03::DOUBLE * (user_id % 10) AS lat, -120 + 0.04::DOUBLE * ((3 * (user_id % 10)) % 10) AS lon FROM events WHERE event_type <> 'error')",
    "knn_pairs": EDGES + " SELECT source, target, round(d, 6) AS dist_m FROM kn",
    "frp_trend": PANEL + " SELECT cell_id, h AS epoch_hr, round(CASE WHEN k IS NULL OR isnan(k) THEN 0 ELSE k END, 6) + 0.0 AS frp_src_trend FROM (SELECT cell_id, h, regr_slope(frp_sum, h) OVER (PARTITION BY cell_id ORDER BY h RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS k FROM pa)",
    "spread_labels": EDGES + " SELECT h AS time_epoch, source, target, round(d, 6) AS dist_m, label FROM la",
    "label_counts": EDGES + " SELECT count(*) AS total, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM la",
    "class_weight": EDGES + " SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round(greatest(1.0, count(*) FILTER (label = 0)::DOUBLE / greatest(1, count(*) FILTER (label = 1))), 6) AS weight FROM la",
    "confusion_matrix": EDGES + " SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM sc GROUP BY 1, 2",
    "calibration_curve": EDGES + " SELECT CAST(greatest(0, ceil(p::DOUBLE * 10) - 1) AS INTEGER) AS bin, round(avg(p::DOUBLE), 6) AS predicted, round(avg(label), 6) AS observed, count(*) AS n FROM sc GROUP BY 1",
    "max_target_prob": EDGES + " SELECT target, round(max(p::DOUBLE), 6) AS pred_proba FROM sc GROUP BY 1",
    "average_precision": EDGES + ", g AS (SELECT p, sum(label) AS y, count(*) AS c FROM sc GROUP BY p), t AS (SELECT y, sum(y) OVER (ORDER BY p DESC) AS tp, sum(c) OVER (ORDER BY p DESC) AS n FROM g) SELECT round(sum(y * tp::DOUBLE / n) / sum(y), 6) AS average_precision FROM t",
    "missing_cells": PANEL + " SELECT DISTINCT cell_id FROM pa WHERE cell_id NOT IN (SELECT 'cell_' || (c_custkey % 40) || '_' || ((c_custkey // 40) % 38) FROM customer WHERE (c_custkey % 40 + 7 * ((c_custkey // 40) % 38)) % 13 <> 5)",
    "mean_wind": PANEL + " SELECT cell_id, round((degrees(atan2(avg(v10_mean), avg(u10_mean))) + 360) % 360, 3) AS wind_deg FROM pa GROUP BY 1",
    "adjacency_rw": EDGES + ", me AS (SELECT median(d) AS m FROM kn), e AS (SELECT source, target, exp(-d / m) AS w FROM kn, me), y AS (SELECT src, dst, sum(w) AS w FROM (SELECT source AS src, target AS dst, w FROM e UNION ALL SELECT target, source, w FROM e) GROUP BY 1, 2) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS weight FROM y",
    "pr_curve": EDGES + ", g AS (SELECT p, sum(label) AS y, count(*) AS c FROM sc GROUP BY p), t AS (SELECT p, sum(y) OVER (ORDER BY p DESC) AS tp, sum(c) OVER (ORDER BY p DESC) AS n, sum(y) OVER () AS a FROM g) SELECT round(p::DOUBLE, 6) AS threshold, round(tp::DOUBLE / n, 6) AS precision, round(tp::DOUBLE / a, 6) AS recall FROM t",
    "adjacency_sym": EDGES + ", me AS (SELECT median(d) AS m FROM kn), e AS (SELECT source, target, exp(-d / m) AS w FROM kn, me), y AS (SELECT src, dst, sum(w) AS w FROM (SELECT source AS src, target AS dst, w FROM e UNION ALL SELECT target, source, w FROM e) GROUP BY 1, 2), d AS (SELECT src AS node, sum(w) AS s FROM y GROUP BY 1) SELECT y.src, y.dst, round(y.w / sqrt(a.s * b.s), 6) AS weight FROM y JOIN d a ON a.node = y.src JOIN d b ON b.node = y.dst",
}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NUMBERS = (*STATIC, "slope_min", "slope_max")
ORACLE |= {
    "csv_points": POINTS + " SELECT event_id, user_id * 0.25::DOUBLE AS lat, user_id * 0.5::DOUBLE AS lon, round(value, 6) AS value FROM pt WHERE event_type <> 'error' AND event_id % 50 <> 0",
    "parsed_times": POINTS + " SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') END AS datetime, CASE WHEN event_id % 40 <> 0 THEN CAST(epoch(b) AS BIGINT) // 3600 END AS epoch_hr FROM f",
    "wind_points": POINTS + f" SELECT event_id, CASE WHEN event_id % 60 <> 0 THEN u10::DOUBLE END AS u10, v10::DOUBLE AS v10, CASE WHEN event_id % 60 <> 0 THEN round(wind_speed, 6) END AS wind_speed, CASE WHEN event_id % 60 <> 0 THEN round(wind_dir, 6) END AS wind_dir_deg FROM w",
    "all_points": POINTS + " SELECT cell_id, round(value, 6) AS t2m, NULL::DOUBLE AS frp FROM w UNION ALL SELECT cell_id, NULL, round(value, 6) FROM f",
    "bounded_cells": PLACES + ", k AS (SELECT *, CAST(floor((x - x0) / 1000) AS INTEGER) AS i, CAST(floor((y - y0) / 1000) AS INTEGER) AS j FROM c, z) SELECT c_custkey, CASE WHEN x > x0 + i * 1000 AND y > y0 + j * 1000 AND i < nx AND j < ny THEN 'cell_' || i || '_' || j END AS cell_id FROM k",
    "grid_files": PLACES + " SELECT 'cell_' || i || '_' || j AS cell_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, x0 + i * 1000 AS xmin, y0 + j * 1000 AS ymin, x0 + i * 1000 + 1000 AS xmax, y0 + j * 1000 + 1000 AS ymax, x0 + i * 1000 + 500 AS centroid_x, y0 + j * 1000 + 500 AS centroid_y FROM z, LATERAL (SELECT unnest(range(0, nx)) AS i), LATERAL (SELECT unnest(range(0, ny)) AS j)",
    "projected_cells": projection(),
    "static_features": POINTS + TOPO + f" SELECT st.cell_id, {fixed(*NUMBERS)}, landcover AS landcover_mode, " + ", ".join(f"round(coalesce((SELECT share FROM tm t WHERE t.cell_id = st.cell_id AND t.landcover = '{v}'), 0), 6) AS landcover_prop_{v}" for v in SEGMENTS) + " FROM st JOIN tm ON tm.cell_id = st.cell_id AND r = 1",
    "category_shares": POINTS + TOPO + " SELECT cell_id, landcover, round(share, 6) AS share FROM tm",
    "weather_cell_time": POINTS + f" SELECT cell_id, {bin_of()}, {fixed(*(f'{a}({c}) AS {n}_{k}' for c, n in (('value', 't2m'), ('wind_speed', 'wind_speed')) for a, k in (('avg', 'mean'), ('max', 'max'), ('stddev_samp', 'std'))), 'avg(u10) AS u10_mean', 'avg(v10) AS v10_mean', 'avg(wind_dir) AS wind_dir_deg_mean')}, count(*) AS _obs_count_sum FROM (SELECT * EXCLUDE (b), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b FROM w WHERE cell_id IS NOT NULL) GROUP BY cell_id, b",
    "panel_keys": PANEL + f" SELECT cell_id, {bin_of()} FROM pa",
    "panel_dense": PANEL + f", ti AS (SELECT cell_id, unnest(generate_series(min(b), max(b), INTERVAL '1 hour')) AS b FROM pa GROUP BY 1) SELECT ti.cell_id, {bin_of('ti.b')}, round(last_value(t2m_mean IGNORE NULLS) OVER (PARTITION BY ti.cell_id ORDER BY ti.b ROWS UNBOUNDED PRECEDING), 6) AS t2m_mean, round(frp_sum, 6) AS frp_sum FROM ti LEFT JOIN pa ON pa.cell_id = ti.cell_id AND pa.b = ti.b",
    "panel_stage_files": PANEL + f" SELECT cell_id, {bin_of()}, {fixed('frp_sum', 't2m_mean')}, fire AS fire_any FROM pa",
    "panel_half_hours": POINTS + """,
q AS (SELECT cell_id, time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') AS b, event_type = 'error' AS e, value FROM pt WHERE cell_id IS NOT NULL),
g AS (SELECT cell_id, b, coalesce(sum(value) FILTER (e), 0) AS frp, count(*) FILTER (e) AS c, coalesce(max(value) FILTER (NOT e), 0) AS t, count(*) FILTER (NOT e) AS n FROM q GROUP BY ALL)
SELECT cell_id, CAST(epoch(b) AS BIGINT) // 3600 AS epoch_hr, round(sum(frp), 6) AS frp_sum, CAST(sum(c) AS BIGINT) AS fire_count, sum(c) > 0 AS fire_any, round(max(t), 6) AS t2m_max, CAST(sum(n) AS BIGINT) AS _obs_count_sum FROM g GROUP BY 1, 2""",
    "grid_coverage": PANEL + TOPO + " SELECT st.cell_id, count(pa.cell_id) AS n, count(pa.cell_id) > 0 AS in_panel FROM st LEFT JOIN pa ON pa.cell_id = st.cell_id GROUP BY 1",
    "stage_summary": PANEL + TOPO + "".join(f"{' UNION ALL' if i else ''} SELECT '{n}' AS stage, count(*) AS n_rows, count(DISTINCT cell_id) AS cells, {'strftime(min(b), ' + chr(39) + '%Y-%m-%d %H:%M:%S' + chr(39) + ')' if t else 'NULL'} AS first_bin, {'strftime(max(b), ' + chr(39) + '%Y-%m-%d %H:%M:%S' + chr(39) + ')' if t else 'NULL'} AS last_bin FROM {f}" for i, (n, f, t) in enumerate((("panel", "pa", 1), ("static", "st", 0), ("weather", "wa", 1), ("fire", "fa", 1), ("grid", "(SELECT cell_id FROM pa UNION SELECT cell_id FROM st)", 0)))),
    "nearest_station": PANEL + STATIONS + " SELECT cell_id, station_idx, round(d, 3) AS dist_m FROM ns",
    "station_weather": PANEL + STATIONS + f", sw AS (SELECT station_idx, b, avg(value) AS t2m_mean, max(value) AS t2m_max, avg(u10) AS u10_mean, max(u10)::DOUBLE AS u10_max, avg(v10) AS v10_mean, max(v10)::DOUBLE AS v10_max, count(*) AS _cnt_sum FROM w JOIN sn ON w.lat = sn.lat AND w.lon = sn.lon GROUP BY ALL) SELECT cell_id, {bin_of()}, {fixed('t2m_mean', 't2m_max', 'u10_mean', 'v10_mean')}, u10_max, v10_max, _cnt_sum FROM sw JOIN ns ON ns.station_idx = sw.station_idx",
    "fire_in_weather_cells": PANEL + f" SELECT cell_id, {bin_of()}, round(frp_sum, 6) AS frp_sum FROM fa WHERE cell_id IN (SELECT cell_id FROM wa)",
    "refreshed_panel": PANEL + f" SELECT cell_id, {bin_of()}, {fixed('t2m_mean', 'frp_sum')}, CAST(c AS INTEGER) AS fire_count, fire AS fire_any FROM pa WHERE n > 0",
    "knn_impute": PANEL + TOPO + """,
wn AS (SELECT cell_id, CAST(split_part(cell_id, '_', 2) AS INT) AS i, CAST(split_part(cell_id, '_', 3) AS INT) AS j FROM (SELECT cell_id FROM st UNION SELECT cell_id FROM pa)),
ky AS (
  SELECT a.cell_id AS source, c.cell_id AS target, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.i - c.i) ** 2 + (a.j - c.j) ** 2, c.cell_id) AS r
  FROM wn a, wn c WHERE c.cell_id IN (SELECT cell_id FROM st)),
ke AS (SELECT source, avg(elevation_mean) AS e FROM ky JOIN st ON st.cell_id = target WHERE ky.r <= 5 GROUP BY 1),
kl AS (SELECT source, landcover, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, landcover) AS o FROM ky JOIN tm ON tm.cell_id = target AND tm.r = 1 WHERE ky.r <= 5 GROUP BY 1, 2)
SELECT wn.cell_id, round(coalesce(st.elevation_mean, e, (SELECT avg(elevation_mean) FROM st)), 6) AS elevation_mean, coalesce(tm.landcover, kl.landcover) AS landcover_mode, round(slope_mean, 6) AS slope_mean
FROM wn LEFT JOIN st ON st.cell_id = wn.cell_id LEFT JOIN tm ON tm.cell_id = wn.cell_id AND tm.r = 1 LEFT JOIN ke ON ke.source = wn.cell_id LEFT JOIN kl ON kl.source = wn.cell_id AND o = 1""",
    "tensor_static_files": PANEL + TOPO + f" SELECT CAST(row_number() OVER (ORDER BY k.cell_id) - 1 AS INTEGER) AS node_idx, k.cell_id, round(coalesce(elevation_mean, 0), 2) AS elevation_mean, round(coalesce(slope_mean, 0), 2) AS slope_mean FROM (SELECT DISTINCT cell_id FROM pa) k LEFT JOIN st ON st.cell_id = k.cell_id",
    "boosting_sums": EDGES + """,
wt AS (SELECT greatest(1.0::DOUBLE, count(*) FILTER (label = 0) / greatest(1, count(*) FILTER (label = 1))) AS w FROM la),
gh AS (
  SELECT d, frp_src, CAST(round((0.5::DOUBLE - label) * CASE WHEN label = 1 THEN w ELSE 1 END * 1073741824) AS BIGINT) AS g,
    CAST(round(0.25::DOUBLE * CASE WHEN label = 1 THEN w ELSE 1 END * 1073741824) AS BIGINT) AS h FROM la, wt)
SELECT 0 AS feature, CAST(d > 1200 AS INT) + CAST(d > 1800 AS INT) + CAST(d > 2500 AS INT) AS bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM gh GROUP BY 2
UNION ALL
SELECT 1, CAST(frp_src > 50.5 AS INT) + CAST(frp_src > 100.5 AS INT) + CAST(frp_src > 200.5 AS INT) + CAST(frp_src > 400.5 AS INT), CAST(sum(g) AS BIGINT), CAST(sum(h) AS BIGINT), count(*) FROM gh GROUP BY 2""",
    "example_features": EXAMPLES + f" SELECT h AS time_epoch, source, target, {fixed('d AS dist_m', 'frp_src', 'coalesce(frp_tgt, 0) AS frp_tgt', 'trend AS frp_src_trend', 'mf AS mean_frp_neighbors', 'angle AS vec_angle_deg', 'cos(radians(wind_src - angle)) AS wind_align')}, true AS fire_any_src, false AS fire_any_tgt, false AS target_burning_at_t, bc AS burning_neighbor_count, label, {ENDS}, 1000.0::DOUBLE * (ti - si) AS vec_dx, 1000.0::DOUBLE * (tj - sj) AS vec_dy, {fixed(*(f'coalesce(a.{c}, 0) AS {c}' for c in STATIC), *(f'coalesce(z.{c}, 0) AS {c}_tgt' for c in STATIC))} FROM ex LEFT JOIN st a ON a.cell_id = source LEFT JOIN st z ON z.cell_id = target",
    "example_table": EXAMPLES + f" SELECT {fixed('d AS dist_m', 'frp_src', 'trend AS frp_src_trend', 'mf AS mean_frp_neighbors', 'cos(radians(wind_src - angle)) AS wind_align', 'coalesce(elevation_mean, 0) AS elevation_mean_tgt')}, bc::DOUBLE AS burning_neighbor_count, 0.0::DOUBLE AS humidity FROM ex LEFT JOIN st ON st.cell_id = target",
    "balanced_examples": EDGES + ", o AS (SELECT h, source, target, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', h, source, target, '42'))) AS r, sum(label) OVER () AS n FROM la) SELECT h AS time_epoch, source, target, label FROM o WHERE label = 1 OR r <= greatest(1, n)",
    "stratified_split": EDGES + ", o AS (SELECT h, source, target, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', h, source, target, '42'))) AS r, count(*) OVER (PARTITION BY label) AS n FROM la) SELECT h AS time_epoch, source, target, label, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o",
    "time_split": EDGES + ", q AS (SELECT floor(quantile_cont(h, 0.7)) AS a, floor(quantile_cont(h, 0.85)) AS b FROM (SELECT DISTINCT h::DOUBLE AS h FROM la)) SELECT h AS time_epoch, source, target, label, CASE WHEN h <= a THEN 'train' WHEN h <= b THEN 'val' ELSE 'test' END AS split FROM la, q",
    "classification_report": EDGES + """,
m AS (SELECT count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p >= 0.5) AS fp, count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label = 0 AND p < 0.5) AS tn FROM sc),
e AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall, tn + fp AS support FROM m
  UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), tp + fn FROM m),
k AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM e),
u AS (
  SELECT * FROM k UNION ALL SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM m
  UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM k
  UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""",
    "map_predictions": EDGES + ", t AS (SELECT target, max(p::DOUBLE) AS p FROM sc GROUP BY 1) SELECT cell_id, round(coalesce(p, 0), 6) AS pred_proba, coalesce(p, 0) >= 0.5 AS above FROM ce LEFT JOIN t ON target = cell_id",
    "predicted_edges": EDGES + f" SELECT h AS time_epoch, source, target, {ENDS}, round(p::DOUBLE, 6) AS pred_proba FROM sc WHERE p >= 0.9",
    "actual_edges": EDGES + f" SELECT h AS time_epoch, source, target, {ENDS} FROM la WHERE label = 1",
    "choose_time": PANEL + MIDDLE + " SELECT mid AS epoch_hr FROM mi",
    "burning_sources": PANEL + MIDDLE + " SELECT DISTINCT pa.cell_id, 500500 + 1000.0::DOUBLE * i AS x, 4000500 + 1000.0::DOUBLE * j AS y FROM pa JOIN ce ON ce.cell_id = pa.cell_id JOIN mi ON h = mid WHERE fire",
    "new_burns": PANEL + MIDDLE + " SELECT cell_id, round(sum(frp_sum), 6) AS frp_sum FROM pa, mi WHERE h > mid AND h <= mid + 24 GROUP BY 1 HAVING bool_or(fire)",
    "node_coords": PANEL + TOPO + " SELECT ce.cell_id, CASE WHEN st.cell_id IS NOT NULL THEN 500500 + 1000.0::DOUBLE * i END AS x, CASE WHEN st.cell_id IS NOT NULL THEN 4000500 + 1000.0::DOUBLE * j END AS y, CAST(count(*) FILTER (st.cell_id IS NULL) OVER () AS INTEGER) AS missing FROM ce LEFT JOIN st ON st.cell_id = ce.cell_id",
    "adjacency_wind": EDGES + ", me AS (SELECT median(d) AS m FROM kn), wi AS (SELECT cell_id, (degrees(atan2(avg(v10_mean), avg(u10_mean))) + 360) % 360 AS a FROM pa GROUP BY 1) SELECT source AS src, target AS dst, round(exp(-d / m) * (1 + 0.5 * greatest(0, cos(radians(a - (degrees(atan2(tj - sj, ti - si)) + 360) % 360)))), 6) AS weight FROM kn JOIN wi ON wi.cell_id = source, me",
    "adjacency_files": EDGES + ", me AS (SELECT median(d) AS m FROM kn), e AS (SELECT source, target, exp(-d / m) AS w FROM kn, me), y AS (SELECT src, dst, sum(w) AS w FROM (SELECT source AS src, target AS dst, w FROM e UNION ALL SELECT target, source, w FROM e) GROUP BY 1, 2), ix AS (SELECT cell_id, CAST(row_number() OVER (ORDER BY cell_id) - 1 AS INTEGER) AS k FROM ce) SELECT a.k AS src_idx, z.k AS dst_idx, round(CAST(CAST(w / s AS FLOAT) AS DOUBLE), 4) AS weight FROM (SELECT *, sum(w) OVER (PARTITION BY src) AS s FROM y) JOIN ix a ON a.cell_id = src JOIN ix z ON z.cell_id = dst",
    "tensor": AXIS + f" SELECT cell_id, h AS epoch_hr, t AS t_idx, {fixed(*(f'{c}::DOUBLE AS {c}' for c in ('frp_sum', 't2m_mean', 'wind_speed_mean', 'u10_mean', 'v10_mean')), digits=4)}, y AS y_current, ahead AS y_future FROM tl",
    "tensor_all_nodes": PANEL + TOPO + """,
lo AS (SELECT min(h) + 24 AS a FROM pa),
ax AS (SELECT cell_id, a + t AS h, CAST(t AS INTEGER) AS t FROM st, lo, LATERAL (SELECT unnest(range(0, 49)) AS t)),
te AS (SELECT ax.cell_id, t, ax.h, CAST(coalesce(frp_sum, 0) AS FLOAT) AS frp_sum, CAST(coalesce(fire, false) AS INTEGER) AS y FROM ax LEFT JOIN pa ON pa.cell_id = ax.cell_id AND pa.h = ax.h)
SELECT cell_id, t AS t_idx, h AS epoch_hr, round(frp_sum::DOUBLE, 4) AS frp_sum, y AS y_current, CASE WHEN y = 0 THEN coalesce(max(y) OVER (PARTITION BY cell_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0) ELSE 0 END AS y_future FROM te""",
    "tensor_files": AXIS + " SELECT cell_id, CAST(count(*) AS INTEGER) AS times, round(sum(frp_sum::DOUBLE), 2) AS frp_sum, CAST(sum(y) AS BIGINT) AS burning, CAST(sum(ahead) AS BIGINT) AS positives FROM tl GROUP BY 1",
    "tensor_static": PANEL + TOPO + f" SELECT ce.cell_id, {fixed(*(f'coalesce({c}, 0) AS {c}' for c in NUMBERS))} FROM ce LEFT JOIN st ON st.cell_id = ce.cell_id",
    "tensor_stats": AXIS + TOPO + f", v AS (SELECT ce.cell_id, unnest([{', '.join(f'coalesce({c}, 0)' for c in NUMBERS)}]) AS v FROM ce LEFT JOIN st ON st.cell_id = ce.cell_id), s AS (SELECT min(v) AS static_min, max(v) AS static_max, avg(v) AS static_mean, count(*) FILTER (v IS NULL) AS static_nulls, count(DISTINCT cell_id) AS static_nodes FROM v), x AS (SELECT min(least(frp_sum, t2m_mean, wind_speed_mean, u10_mean, v10_mean))::DOUBLE AS x_min, max(greatest(frp_sum, t2m_mean, wind_speed_mean, u10_mean, v10_mean))::DOUBLE AS x_max, (avg(frp_sum::DOUBLE) + avg(t2m_mean::DOUBLE) + avg(wind_speed_mean::DOUBLE) + avg(u10_mean::DOUBLE) + avg(v10_mean::DOUBLE)) / 5 AS x_mean, CAST(sum(ahead) AS BIGINT) AS positives, avg(ahead) AS positive_share, count(DISTINCT cell_id) AS nodes, count(DISTINCT t) AS times, count(*) AS n FROM tl) SELECT {fixed('x_min', 'x_max', 'x_mean', 'positive_share', 'static_min', 'static_max', 'static_mean', digits=4)}, CAST(0 AS BIGINT) AS x_nulls, positives, nodes, times, static_nulls, static_nodes, nodes = static_nodes AS same_nodes, n = nodes * times AS full_axis FROM x, s",
}
