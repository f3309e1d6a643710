"""Independent SQL for every registered query (DuckDB dialect).

The SQL computes from the raw test tables directly: windows instead of
max_by, relational joins against a taps table instead of array
expressions, column arithmetic instead of parsed JSON.
"""

from __future__ import annotations

# The published db4 scaling filter; the other one is its mirror with alternating signs.
DB4_LOW = [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
           -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965]
DB4_HIGH = [(-1) ** (j + 1) * v for j, v in enumerate(reversed(DB4_LOW))]

SR = """sr AS (SELECT user_id AS segment_index, event_id AS seq,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS speed, ts AS ingested_at FROM events)"""

LATEST = """latest AS (SELECT segment_index, speed, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_index ORDER BY seq DESC) AS rn FROM sr) WHERE rn = 1)"""


def _hist(n: int = 96) -> str:
    return f"""hist AS (SELECT segment_index, seq, rn - 1 AS age, speed FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_index ORDER BY seq DESC) AS rn FROM sr)
  WHERE rn <= {n} AND speed IS NOT NULL)"""


def _pt(i: int) -> str:
    return (f"""'{{"lat": 10.' || lpad(CAST((c_custkey * 7919 + 104729 * {i}) % 1000000 AS VARCHAR), 6, '0')"""
            f""" || ', "lng": 106.' || lpad(CAST((c_custkey * 6151 + 7717 * {i}) % 1000000 AS VARCHAR), 6, '0') || '}}'""")


RG = f"""rg AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS shape_hash, c_custkey AS segment_index,
  CASE WHEN c_custkey % 20 = 3 THEN '' WHEN c_custkey % 20 = 7 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_custkey % 25 = 4 THEN NULL
       WHEN c_custkey % 25 = 9 THEN '[' || {_pt(0)} || ']'
       ELSE '[' || {_pt(0)} || ', ' || {_pt(1)} || ', ' || {_pt(2)} || ']' END AS shape
  FROM customer)"""

PR = """pr AS (SELECT TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(vec_id AS INTEGER)) AS time,
  CAST(label AS BIGINT) AS segment_index,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS speed, vec_id AS seq FROM embeddings)"""

LATEST_PRED = """lp AS (SELECT segment_index, speed AS predict, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_index ORDER BY seq DESC) AS rn FROM pr) WHERE rn = 1)"""

REQ = """req AS (SELECT event_id AS request_id, CASE event_type
    WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN CAST(user_id - 100 AS VARCHAR)
    WHEN 'signup' THEN CAST(user_id + 1400 AS VARCHAR)
    WHEN 'purchase' THEN CAST(user_id AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '.0' ELSE '.5' END
    ELSE 'abc' END AS raw FROM events),
  req1 AS (SELECT request_id, regexp_replace(trim(raw), '\\.0*$', '') AS txt FROM req),
  req2 AS (SELECT request_id, txt, coalesce(TRY_CAST(txt AS BIGINT) >= 1
    AND TRY_CAST(txt AS DOUBLE) = CAST(TRY_CAST(txt AS BIGINT) AS DOUBLE), false) AS ok FROM req1),
  req3 AS (SELECT request_id, ok, CASE WHEN ok THEN TRY_CAST(txt AS BIGINT) END AS segment_index FROM req2)"""

VIEW = """view AS (SELECT rg.segment_index, rg.name, round(l.speed * 3.6, 2) AS current, lp.predict
  FROM rg LEFT JOIN latest l ON l.segment_index = rg.segment_index
  LEFT JOIN lp ON lp.segment_index = rg.segment_index)"""

GP = """gp0 AS (SELECT c_custkey AS point_id,
  CAST(8.0 AS DOUBLE) + ((c_custkey * 7919) % 4000) / CAST(1000.0 AS DOUBLE) AS lat,
  CAST(104.0 AS DOUBLE) + ((c_custkey * 6151) % 4000) / CAST(1000.0 AS DOUBLE) AS lng FROM customer),
  gp AS (SELECT point_id,
  CASE WHEN point_id % 50 = 0 THEN lat + CAST(90.0 AS DOUBLE) ELSE lat END AS lat,
  CASE WHEN point_id % 70 = 0 THEN lng + CAST(90.0 AS DOUBLE) ELSE lng END AS lng FROM gp0)"""

TAPS = "taps(j, lo, hi) AS (VALUES " + ", ".join(
    f"({j}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))" for j, (lo, hi) in enumerate(zip(DB4_LOW, DB4_HIGH))) + ")"

# Series in km/h, positions among the non-null readings (0 = newest).
XS = """xs AS (SELECT segment_index, row_number() OVER (PARTITION BY segment_index ORDER BY age) - 1 AS t,
  speed * 3.6 AS x FROM hist)"""

# Zero-padded to the longest series of the network (325 series per network).
PADDED = """lens AS (SELECT segment_index, count(*) AS n FROM hist GROUP BY 1),
  net AS (SELECT segment_index, n, (dense_rank() OVER (ORDER BY segment_index) - 1) // 325 AS network,
          (dense_rank() OVER (ORDER BY segment_index) - 1) % 325 AS variate FROM lens),
  netlen AS (SELECT network, max(n) AS L FROM net GROUP BY 1),
  grid AS (SELECT net.segment_index, net.network, net.variate, net.n, netlen.L, unnest(range(netlen.L)) AS t
           FROM net JOIN netlen USING (network)),
  pad_raw AS (SELECT g.segment_index, g.network, g.variate, g.n, g.L, g.t, coalesce(h.speed, 0.0) AS v
           FROM grid g LEFT JOIN (SELECT segment_index, row_number() OVER (PARTITION BY segment_index ORDER BY age) - 1 AS t, speed FROM hist) h
           ON h.segment_index = g.segment_index AND h.t = g.t)"""


def _ext(i: str, n: str) -> str:
    m = f"((({i}) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    return f"least({m}, 2 * {n} - 1 - {m})"


def _coef(src: str, n: str) -> str:
    """ca/cd per (segment, k) from a (segment_index, t, x) table ``src`` with length ``n`` column."""
    return f"""kk AS (SELECT DISTINCT segment_index, {n} AS n FROM {src}),
  kk2 AS (SELECT segment_index, n, unnest(range((n + 7) // 2)) AS k FROM kk),
  coef AS (SELECT kk2.segment_index, kk2.n, kk2.k, sum(taps.lo * s.x) AS ca, sum(taps.hi * s.x) AS cd
    FROM kk2 CROSS JOIN taps JOIN {src} s ON s.segment_index = kk2.segment_index
     AND s.t = {_ext('2 * kk2.k + 1 - taps.j', 'kk2.n')}
    GROUP BY 1, 2, 3),
  thr AS (SELECT segment_index, median(abs(cd)) / 0.6745 AS sigma,
    median(abs(cd)) / 0.6745 * sqrt(ln(any_value(n)) * 2) AS threshold FROM coef GROUP BY 1),
  soft AS (SELECT c.segment_index, c.n, c.k, c.ca,
    sign(c.cd) * greatest(abs(c.cd) - thr.threshold, 0.0) AS cds FROM coef c JOIN thr USING (segment_index))"""


def _denoised(src: str) -> str:
    """Reconstruction per (segment, t) from ``soft`` over positions of ``src``."""
    return f"""rec AS (SELECT s.segment_index, s.t, sum(c.ca * taps.lo + c.cds * taps.hi) AS y
    FROM {src} s CROSS JOIN taps JOIN soft c ON c.segment_index = s.segment_index
     AND 2 * c.k = s.t + taps.j - 1
    GROUP BY 1, 2)"""


def _multilevel(taps: list[float], levels: int, keep: str) -> str:
    """Denoised series of ``levels`` levels, level by level over rows (segment_index, t, x); ``keep`` thresholds x by h."""
    f = len(taps)
    ctes = [SR, _hist(96), XS, "tp(j, lo, hi) AS (VALUES " + ", ".join(
        f"({j}, CAST({v!r} AS DOUBLE), CAST({taps[f - 1 - j] * (1 if j % 2 else -1)!r} AS DOUBLE))" for j, v in enumerate(taps)) + ")",
        "l0 AS (SELECT segment_index, t, x, count(*) OVER (PARTITION BY segment_index) AS n FROM xs)"]
    for k in range(1, levels + 1):
        ctes += [f"c{k} AS (SELECT q.segment_index, q.k, q.n, sum(tp.lo * s.x) AS a, sum(tp.hi * s.x) AS d FROM (SELECT segment_index, n, "
                 f"unnest(range((n + {f - 1}) // 2)) AS k FROM (SELECT DISTINCT segment_index, n FROM l{k - 1})) q CROSS JOIN tp "
                 f"JOIN l{k - 1} s ON s.segment_index = q.segment_index AND s.t = {_ext('2 * q.k + 1 - tp.j', 'q.n')} GROUP BY 1, 2, 3)",
                 f"l{k} AS (SELECT segment_index, k AS t, a AS x, (n + {f - 1}) // 2 AS n FROM c{k})"]
    ctes.append("th AS (SELECT segment_index, median(abs(d)) / 0.6745 * sqrt(ln(any_value(n)) * 2) AS h FROM c1 GROUP BY 1)")
    low = f"l{levels}"
    for k in range(levels, 0, -1):
        shrunk = keep.format(x="c.d", h="th.h")
        ctes.append(f"r{k} AS (SELECT s.segment_index, s.t, sum(b.x * tp.lo + ({shrunk}) * tp.hi) AS x FROM l{k - 1} s CROSS JOIN tp "
                    f"JOIN c{k} c ON c.segment_index = s.segment_index AND 2 * c.k = s.t + tp.j - 1 JOIN {low} b ON b.segment_index = c.segment_index "
                    f"AND b.t = c.k JOIN th ON th.segment_index = s.segment_index GROUP BY 1, 2)")
        low = f"r{k}"
    return _with(*ctes) + "SELECT segment_index, t AS pos, round(x, 4) + 0.0 AS value FROM r1"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n  ".join(ctes) + "\n"


def _forecast_base() -> list[str]:
    return [SR, _hist(96), RG,
            PADDED.replace("FROM hist GROUP BY 1", "FROM hist WHERE segment_index IN (SELECT segment_index FROM rg) GROUP BY 1"),
            "px AS (SELECT segment_index, L AS n, t, v * 3.6 AS x FROM pad_raw)",
            TAPS, _coef("px", "n"), _denoised("px")]


SQL: dict[str, str] = {}

SQL["latest_speed"] = _with(SR, LATEST) + "SELECT segment_index, speed, seq FROM latest"
SQL["current_speed"] = _with(SR, LATEST, RG) + """SELECT l.segment_index, round(l.speed * 3.6, 2) AS current
  FROM latest l JOIN rg ON rg.segment_index = l.segment_index WHERE l.speed IS NOT NULL"""
SQL["recent_history"] = _with(SR, _hist(96)) + "SELECT segment_index, seq, age, speed FROM hist"
SQL["recent_history_short"] = _with(SR, _hist(24)) + "SELECT segment_index, seq, age, speed FROM hist"
SQL["recent_history_incremental"] = SQL["recent_history"]
SQL["series_array"] = _with(SR, _hist(96)) + """SELECT segment_index, list(speed ORDER BY age) AS series,
  count(*) AS n FROM hist GROUP BY 1"""
SQL["max_history"] = _with(SR, _hist(96)) + "SELECT max(n) AS max_len FROM (SELECT segment_index, count(*) AS n FROM hist GROUP BY 1)"
SQL["speed_kmh"] = _with(SR) + "SELECT segment_index, seq, round(speed * 3.6, 2) AS speed_kmh FROM sr"
SQL["latest_prediction"] = _with(PR, LATEST_PRED) + "SELECT segment_index, predict, seq FROM lp"
SQL["segments_with_history"] = _with(SR, _hist(96), RG) + """SELECT segment_index, name FROM rg
  WHERE segment_index IN (SELECT segment_index FROM hist)"""
SQL["silent_segments"] = _with(SR, _hist(96), RG) + """SELECT segment_index FROM rg
  WHERE segment_index NOT IN (SELECT segment_index FROM hist)"""
SQL["prediction_view"] = _with(SR, LATEST, RG, PR, LATEST_PRED, VIEW) + "SELECT segment_index, name, current, predict FROM view"
SQL["speed_band"] = _with(SR, LATEST, RG, PR, LATEST_PRED, VIEW) + """SELECT segment_index, current,
  CASE WHEN current IS NULL OR isnan(current) THEN 'unknown' WHEN current < 15 THEN 'slow'
       WHEN current < 25 THEN 'medium' ELSE 'fast' END AS band FROM view"""
SQL["forecast_summary"] = _with(PR, LATEST_PRED) + """SELECT segment_index,
  CAST(floor((predict[1] + predict[2]) / 2 + 0.5) AS BIGINT) AS next_10,
  CAST(floor(list_sum(predict) / len(predict) + 0.5) AS BIGINT) AS next_60
  FROM lp WHERE len(predict) > 0"""
SQL["forecast_steps"] = _with(PR) + """SELECT pred_seq, segment_index, step,
  time + to_minutes(CAST(step * 5 AS INTEGER)) AS target_time, speed FROM (
  SELECT seq AS pred_seq, segment_index, time, unnest(range(1, len(speed) + 1)) AS step, unnest(speed) AS speed FROM pr)"""
SQL["request_status"] = _with(SR, LATEST, RG, PR, LATEST_PRED, VIEW, REQ) + """SELECT request_id, segment_index, status,
  CASE WHEN status = 200 THEN current END AS current FROM (
  SELECT r.request_id, r.segment_index,
    CASE WHEN NOT r.ok THEN 400 WHEN v.current IS NULL THEN 404 ELSE 200 END AS status, v.current
  FROM req3 r LEFT JOIN view v ON v.segment_index = r.segment_index)"""
SQL["answer_predict"] = _with(SR, LATEST, RG, PR, LATEST_PRED, VIEW, REQ) + """SELECT request_id, segment_index, status,
  CASE WHEN status = 200 THEN name END AS name, CASE WHEN status = 200 THEN current END AS current,
  CASE WHEN status = 200 THEN predict END AS predict FROM (
  SELECT r.request_id, r.segment_index,
    CASE WHEN NOT r.ok THEN 400 WHEN v.name IS NULL AND v.current IS NULL THEN 404 ELSE 200 END AS status,
    v.name, v.current, v.predict
  FROM req3 r LEFT JOIN view v ON v.segment_index = r.segment_index)"""
SQL["registry_scan"] = _with(RG) + "SELECT shape_hash, segment_index, name, shape FROM rg"
SQL["segment_count"] = _with(RG) + "SELECT count(*) AS segment_count FROM rg"
SQL["name_fallback"] = _with(RG) + """SELECT segment_index,
  CASE WHEN name IS NULL OR name = '' THEN 'segment_' || CAST(segment_index AS VARCHAR) ELSE name END AS registry_name,
  coalesce(name, '') AS api_name,
  CASE WHEN name IS NULL OR name = '' THEN 'Segment #' || CAST(segment_index AS VARCHAR) ELSE name END AS display_name
  FROM rg"""
SHAPES = """shp AS (SELECT segment_index, coalesce(name, '') AS name,
  json_transform(coalesce(shape, '[]'), '[{"lat":"DOUBLE","lng":"DOUBLE"}]') AS pts FROM rg)"""
SQL["list_segments"] = _with(RG, SHAPES) + """SELECT segment_index, name,
  list_transform(pts, lambda p: p.lat) AS lats, list_transform(pts, lambda p: p.lng) AS lngs FROM shp"""
SQL["search_segments"] = _with(RG) + """SELECT segment_index, name FROM rg
  WHERE contains(lower(coalesce(name, '')), '12') OR contains(CAST(segment_index AS VARCHAR), '12')"""
SQL["answer_location_bodies"] = """WITH r AS (SELECT event_id AS request_id, (user_id % 120) + 0.25 AS lat,
    -((user_id % 240) + 0.5) AS lng, event_type IN ('click', 'view') AS whole FROM events),
  k AS (SELECT *, whole AND lat <= 90 AND lng >= -180 AS ok FROM r)
SELECT request_id, CAST(CASE WHEN ok THEN 200 ELSE 400 END AS BIGINT) AS status,
  CAST(CASE WHEN ok THEN lat END AS DOUBLE) AS lat, CAST(CASE WHEN ok THEN lng END AS DOUBLE) AS lng FROM k"""
SQL["point_reads"] = _with(RG) + "SELECT shape_hash, segment_index, name FROM rg WHERE segment_index IN (0, 7, 77, 1000000000)"
SQL["search_indexed"] = _with(RG) + """SELECT s.q, segment_index, name
  FROM rg, (VALUES ('', ''), ('7', '7'), ('12', '12'), (' 012 ', '012'), ('ER#00000012', 'er#00000012'),
    ('segment', 'segment')) s(q, txt)
  WHERE contains(lower(coalesce(name, '')), txt) OR contains(CAST(segment_index AS VARCHAR), txt)"""
SQL["drawable_segments"] = _with(RG, SHAPES) + """SELECT segment_index, CAST(len(pts) AS BIGINT) AS n_points
  FROM shp WHERE len(pts) >= 2"""
SQL["lookup_segments"] = _with(SR, RG) + """SELECT k.segment_index, rg.name, rg.shape
  FROM (SELECT DISTINCT segment_index FROM sr) k JOIN rg ON rg.segment_index = k.segment_index"""
SQL["valid_location"] = _with(GP) + """SELECT point_id, lat, lng,
  coalesce(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, false) AS is_valid FROM gp"""
_HAV = """2 * 6371008.8 * asin(sqrt(least(
  pow(sin(radians(lat - 10.776889) / 2), 2)
  + cos(radians(CAST(10.776889 AS DOUBLE))) * cos(radians(lat)) * pow(sin(radians(lng - 106.695278) / 2), 2), 1.0)))"""
SQL["geo_circle"] = _with(GP) + f"""SELECT point_id, round(d, 3) + 0.0 AS dist_m FROM (
  SELECT point_id, {_HAV} AS d FROM gp) WHERE d <= 50000.0"""
SQL["geo_circles"] = """WITH p AS (SELECT c_custkey AS point_id,
    ((c_custkey * 7919) % 18101) / CAST(100 AS DOUBLE) - 90 AS lat, ((c_custkey * 6151) % 36001) / CAST(100 AS DOUBLE) - 180 AS lng
    FROM customer),
  c AS (SELECT s_suppkey AS circle_id,
    CASE WHEN s_suppkey % 7 = 0 THEN 90 - (s_suppkey % 11) / CAST(2 AS DOUBLE)
         WHEN s_suppkey % 7 = 1 THEN (s_suppkey % 11) / CAST(2 AS DOUBLE) - 90
         ELSE ((s_suppkey * 911) % 18001) / CAST(100 AS DOUBLE) - 90 END AS lat0,
    CASE WHEN s_suppkey % 5 = 0 THEN 180 - (s_suppkey % 9) / CAST(4 AS DOUBLE)
         ELSE ((s_suppkey * 6151) % 36001) / CAST(100 AS DOUBLE) - 180 END AS lng0,
    CASE WHEN s_suppkey % 10 = 3 THEN 2430000.0 ELSE 30000 * pow(3, s_suppkey % 4) END AS radius FROM supplier),
  d AS (SELECT point_id, circle_id, radius, 2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(lat - lat0) / 2), 2)
    + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2), 1.0))) AS m
    FROM p, c WHERE lat BETWEEN -90 AND 90)
SELECT point_id, circle_id, round(m, 2) + 0.0 AS dist_m FROM d WHERE m <= radius"""

# series
SQL["variate_position"] = _with(SR, _hist(96), PADDED) + "SELECT segment_index, network, variate FROM net"
SQL["pad_series"] = _with(SR, _hist(96), PADDED) + """SELECT segment_index, list(v ORDER BY t) AS series,
  any_value(n) AS n FROM pad_raw GROUP BY 1"""
SQL["series_matrix_long"] = _with(SR, _hist(96), PADDED) + "SELECT segment_index, t AS pos, v AS value FROM pad_raw"
SQL["pad_width"] = _with(SR, _hist(96), PADDED) + """,
  shape AS (SELECT network, max(variate) + 1 AS w, max(L) AS L FROM net JOIN netlen USING (network) GROUP BY 1),
  tw AS (SELECT network, w, L, CASE WHEN w <= 325 THEN 325 ELSE CAST(pow(2, ceil(log2(w))) AS BIGINT) END AS target FROM shape)
SELECT network, variate, t AS pos, v AS value FROM pad_raw
UNION ALL
SELECT network, variate, pos, 0.0 AS value FROM (
  SELECT network, unnest(range(w, target)) AS variate, L FROM tw) z, LATERAL (SELECT unnest(range(z.L)) AS pos)"""
SQL["series_matrix_wide"] = SQL["pad_width"].replace("WITH ", "WITH pw AS (WITH ", 1) + """)
PIVOT pw ON variate IN (""" + ", ".join(str(i) for i in range(325)) + """) USING first(value) GROUP BY network, pos"""
STATS = """stats AS (SELECT segment_index, avg(speed) AS mean, sqrt(var_pop(speed) + 1e-5) AS stdev FROM hist GROUP BY 1)"""
SQL["instance_norm"] = _with(SR, _hist(96), STATS) + """SELECT h.segment_index, (round(any_value(s.mean), 6) + 0.0) AS mean,
  (round(any_value(s.stdev), 6) + 0.0) AS stdev,
  list(round((h.speed - s.mean) / s.stdev, 6) + 0.0 ORDER BY h.age) AS normed
  FROM hist h JOIN stats s USING (segment_index) GROUP BY 1"""
SQL["denormalize"] = _with(SR, _hist(96), STATS, PR, LATEST_PRED) + """SELECT lp.segment_index,
  list_transform(lp.predict, lambda v: round(v * s.stdev + s.mean, 6) + 0.0) AS forecast
  FROM lp JOIN stats s ON s.segment_index = lp.segment_index"""
SQL["patches"] = _with(SR, _hist(96)) + """, pos AS (SELECT segment_index, speed,
  row_number() OVER (PARTITION BY segment_index ORDER BY age) - 1 AS t,
  count(*) OVER (PARTITION BY segment_index) AS n FROM hist)
SELECT segment_index, t // 12 AS patch, list(speed ORDER BY t) AS "values"
  FROM pos WHERE t < (n // 12) * 12 GROUP BY 1, 2"""

# wavelet (own length per series, km/h)
_XS_N = """xsn AS (SELECT xs.segment_index, xs.t, xs.x, c.n FROM xs JOIN
  (SELECT segment_index, count(*) AS n FROM xs GROUP BY 1) c USING (segment_index))"""
SQL["dwt_coeffs"] = _with(SR, _hist(96), XS, _XS_N, TAPS, _coef("xsn", "n")) + """SELECT segment_index, k,
  round(ca, 6) + 0.0 AS ca, round(cd, 6) + 0.0 AS cd FROM coef"""
SQL["denoise_sigma"] = _with(SR, _hist(96), XS, _XS_N, TAPS, _coef("xsn", "n")) + """SELECT segment_index,
  round(sigma, 6) + 0.0 AS sigma, round(threshold, 6) + 0.0 AS threshold FROM thr"""
SQL["soft_threshold"] = _with(SR, _hist(96), XS, _XS_N, TAPS, _coef("xsn", "n")) + """SELECT segment_index, k,
  round(cds, 6) + 0.0 AS cd_soft FROM soft"""
SQL["denoise_series"] = _with(SR, _hist(96), PADDED, "px AS (SELECT segment_index, L AS n, t, v * 3.6 AS x FROM pad_raw)",
                              TAPS, _coef("px", "n"), _denoised("px")) + """SELECT segment_index, t AS pos,
  round(y, 4) + 0.0 AS value FROM rec"""

_DB2 = [(1 - 3 ** 0.5) / 32 ** 0.5, (3 - 3 ** 0.5) / 32 ** 0.5, (3 + 3 ** 0.5) / 32 ** 0.5, (1 + 3 ** 0.5) / 32 ** 0.5]
SQL["denoise_levels"] = _multilevel(DB4_LOW, 3, "IF(abs({x}) < {h}, 0.0, {x})")
SQL["denoise_levels_db2"] = _multilevel(_DB2, 2, "sign({x}) * greatest(abs({x}) - {h}, 0.0)")

_FC_TIME = "TIMESTAMP '2024-02-01 00:00:00'"
SQL["forecast_persistence"] = _with(*_forecast_base()) + f"""SELECT {_FC_TIME} AS "Time", segment_index,
  list_transform(range(12), lambda i: round(y, 2) + 0.0) AS "Speed" FROM rec WHERE t = 0"""
_TREND = _with(*_forecast_base()) + f""", fit AS (SELECT segment_index,
  coalesce(regr_slope(y, t), 0.0) AS slope, avg(y) AS ym, avg(t) AS tm FROM rec GROUP BY 1)
SELECT {_FC_TIME} AS "Time", segment_index,
  list_transform(range(1, 13), lambda h: round((ym - slope * tm) - slope * h, 2) + 0.0) AS "Speed" FROM fit"""
SQL["forecast_trend"] = _TREND
SQL["forecast_network"] = _TREND


# --- snapshots (computed from the order columns, no JSON) -----------------

def _coord(base: str, mult: int, add: int, i: int, key: str = "k") -> str:
    return (f"round(CAST({base} AS DOUBLE) + (({key} * {mult} + {i} * {add}) % {400000 if base == '10.6' else 500000})"
            f" / CAST(1e6 AS DOUBLE) + CAST(3e-8 AS DOUBLE), 6)")


def _lat(i: int) -> str:
    v = _coord("10.6", 7919, 104729, i)
    return f"CASE WHEN k % 19 = 0 THEN CAST(11.0 AS DOUBLE) ELSE {v} END" if i == 0 else v


def _lat_txt(i: int) -> str:
    return f"CASE WHEN k % 19 = 0 THEN '11' ELSE CAST({_lat(i)} AS VARCHAR) END" if i == 0 else f"CAST({_lat(i)} AS VARCHAR)"


def _lng(i: int) -> str:
    return _coord("106.5", 6151, 7717, i)


def _pt_json(i: int) -> str:
    return f"""'{{"lat": ' || {_lat_txt(i)} || ', "lng": ' || CAST({_lng(i)} AS VARCHAR) || '}}'"""


SN = f"""sn0 AS (SELECT o_orderkey AS okey, o_custkey + p AS k, o_orderkey * 1000000 + p AS seq, CAST(p AS BIGINT) AS pos,
    strftime(o_orderdate, '%Y%m%dT%H%M%S') AS snapshot_ts, o_orderstatus, o_totalprice
    FROM (SELECT *, unnest(range(o_orderkey % 3 + 1)) AS p FROM orders)),
  sn AS (SELECT okey, k, seq, pos, snapshot_ts,
    (k % 23 <> 0 AND k % 13 <> 0) AS has_links,
    (k % 23 <> 0 AND k % 13 <> 0 AND k % 17 <> 0) AS has_points,
    CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN '' ELSE 'Road ' || CAST(k AS VARCHAR) END AS name,
    CASE WHEN okey % 37 = 0 OR okey % 29 = 0 THEN 0.0 WHEN okey % 31 = 0 THEN NULL
         ELSE o_totalprice / CAST(2e4 AS DOUBLE) END AS speed_ms,
    CASE WHEN okey % 37 = 0 THEN 0.0 ELSE CAST(okey % 11 AS DOUBLE) END AS jam_factor,
    CASE WHEN okey % 37 = 0 THEN 0.0 ELSE CAST(k % 20 + 10 AS DOUBLE) END AS free_flow_speed,
    CASE WHEN okey % 37 = 0 OR o_orderstatus = 'P' THEN 0.0
         ELSE CAST(0.5 AS DOUBLE) + (okey % 50) / CAST(100.0 AS DOUBLE) END AS confidence,
    CASE WHEN k % 23 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN []
         ELSE [{_lat(0)}, {_lat(1)}, {_lat(2)}] END AS lats,
    CASE WHEN k % 23 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN []
         ELSE [{_lng(0)}, {_lng(1)}, {_lng(2)}] END AS lngs,
    CASE WHEN k % 23 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN '[]'
         ELSE '[' || {_pt_json(0)} || ', ' || {_pt_json(1)} || ', ' || {_pt_json(2)} || ']' END AS shape_json
    FROM sn0),
  recs AS (SELECT *, sha256(shape_json) AS shape_hash FROM sn WHERE has_links)"""

# Spark rounds the decimal text of a double HALF_UP; DuckDB's round works on
# the binary value. Rounding the decimal form reproduces Spark's rule.
def _spark_round(x: str, d: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 17)), {d}) AS DOUBLE)"


FIRST = """fs AS (SELECT shape_hash, min(seq) AS first_seq, arg_min(name, seq) AS name,
    arg_min(shape_json, seq) AS shape_json FROM recs GROUP BY 1)"""
REG_ALL = """reg AS (SELECT shape_hash, row_number() OVER (ORDER BY first_seq) AS segment_index,
    name AS raw_name, first_seq FROM fs),
  reg2 AS (SELECT shape_hash, segment_index,
    CASE WHEN raw_name IS NULL OR raw_name = '' THEN 'segment_' || CAST(segment_index AS VARCHAR) ELSE raw_name END AS name,
    first_seq FROM reg)"""

SQL["parse_results"] = _with(SN) + "SELECT seq, snapshot_ts, pos FROM sn"
SQL["filter_links"] = _with(SN) + "SELECT seq FROM sn WHERE has_links"
SQL["flow_fields"] = _with(SN) + """SELECT seq, name, speed_ms, jam_factor, free_flow_speed, confidence FROM sn"""
_NAME = "CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN '' WHEN k % 10 = 5 THEN {} ELSE 'Road ' || CAST(k AS VARCHAR) END AS name"
SQL["flow_fields_strict"] = _with(SN) + f"""SELECT seq, {_NAME.format("NULL")}, speed_ms, jam_factor, free_flow_speed,
  confidence FROM sn"""
SQL["flow_fields_default"] = _with(SN) + f"""SELECT seq, {_NAME.format("''")}, coalesce(speed_ms, 0.0) AS speed_ms,
  jam_factor, free_flow_speed, confidence FROM sn"""
SQL["shape_points"] = _with(SN) + """SELECT seq, CAST(len(lats) AS BIGINT) AS n_points, lats, lngs FROM sn"""
SQL["shape_json"] = _with(SN) + "SELECT seq, shape_json FROM recs"
SQL["shape_hash"] = _with(SN) + "SELECT seq, shape_hash FROM recs"
SQL["shape_parse"] = _with(SN) + """SELECT seq, CAST(len(lats) AS BIGINT) AS n_points, lats, lngs FROM recs"""
SQL["shape_center"] = _with(SN) + """SELECT seq,
  CASE WHEN len(lats) = 0 THEN 10.776889 ELSE (list_min(lats) + list_max(lats)) / 2 END AS center_lat,
  CASE WHEN len(lngs) = 0 THEN 106.695278 ELSE (list_min(lngs) + list_max(lngs)) / 2 END AS center_lng FROM sn"""
SQL["run_metrics"] = _with(SN) + """SELECT snapshot_ts, count(*) AS extracted, count_if(has_links) AS written
  FROM sn GROUP BY 1"""
SQL["first_seen"] = _with(SN, FIRST) + "SELECT shape_hash, first_seq, name, shape_json FROM fs"
_EARLY = """early AS (SELECT shape_hash, min(seq) AS first_seq, arg_min(name, seq) AS name FROM recs
    WHERE snapshot_ts < '19980415T000000' GROUP BY 1)"""
SQL["new_shapes"] = _with(SN, _EARLY) + """SELECT seq, shape_hash FROM recs
  WHERE snapshot_ts >= '19980415T000000' AND shape_hash NOT IN (SELECT shape_hash FROM early)"""
SQL["register_segments"] = _with(SN, FIRST, REG_ALL) + "SELECT shape_hash, segment_index, name, first_seq FROM reg2"
SQL["register_incremental"] = _with(SN, _EARLY) + """,
  late AS (SELECT shape_hash, min(seq) AS first_seq, arg_min(name, seq) AS name FROM recs
    WHERE snapshot_ts >= '19980415T000000' AND shape_hash NOT IN (SELECT shape_hash FROM early) GROUP BY 1),
  allreg AS (
    SELECT shape_hash, row_number() OVER (ORDER BY first_seq) AS segment_index, name, first_seq FROM early
    UNION ALL
    SELECT shape_hash, (SELECT count(*) FROM early) + row_number() OVER (ORDER BY first_seq) AS segment_index,
      name, first_seq FROM late)
SELECT shape_hash, segment_index,
  CASE WHEN name IS NULL OR name = '' THEN 'segment_' || CAST(segment_index AS VARCHAR) ELSE name END AS name,
  first_seq FROM allreg"""
SQL["attach_segment"] = _with(SN, FIRST, REG_ALL) + """SELECT r.seq, g.segment_index FROM recs r
  JOIN reg2 g ON g.shape_hash = r.shape_hash"""
SQL["stamp_ingest"] = _with(SN) + "SELECT seq, TIMESTAMP '2024-02-01 00:00:00' AS ingested_at FROM recs"
SQL["speed_record_projection"] = _with(SN, FIRST, REG_ALL) + f"""SELECT g.segment_index, r.seq, r.speed_ms AS "Speed",
  {_spark_round('r.speed_ms * 3.6', 2)} AS "SpeedKmh", r.jam_factor AS "JamFactor",
  r.free_flow_speed AS "FreeFlow", r.confidence AS "Confidence", TIMESTAMP '2024-02-01 00:00:00' AS "IngestedAt"
  FROM recs r JOIN reg2 g ON g.shape_hash = r.shape_hash"""
_TRANSFORMED = _with(SN, FIRST, REG_ALL) + f"""SELECT r.seq, g.segment_index, r.shape_hash, r.name, r.speed_ms,
  {_spark_round('r.speed_ms * 3.6', 2)} AS speed_kmh, r.snapshot_ts
  FROM recs r JOIN reg2 g ON g.shape_hash = r.shape_hash"""
SQL["etl_transformed"] = _TRANSFORMED
SQL["sink_transformed_roundtrip"] = _TRANSFORMED
SQL["src_snapshot_json"] = _with(SN) + "SELECT seq, snapshot_ts, name, speed_ms, shape_hash FROM recs"
SQL["sink_speed_records"] = _with(SR) + """SELECT segment_index, seq, speed AS "Speed",
  round(speed * 3.6, 2) AS "SpeedKmh" FROM sr"""
SQL["sink_predictions"] = SQL["forecast_persistence"]
SQL["stream_latest"] = SQL["latest_speed"]
SQL["stream_ingest"] = _with(SN) + """SELECT seq, shape_hash, speed_ms AS "Speed" FROM recs"""
SQL["stream_ingest_replayed"] = SQL["stream_ingest"]
SQL["compact_records"] = SQL["sink_speed_records"]
SQL["stream_recent"] = SQL["recent_history"]

_BODY = """req AS (SELECT event_id AS request_id, json_extract_string(CASE event_type
    WHEN 'click' THEN '{"segment_index": ' || CAST(user_id AS VARCHAR) || '}'
    WHEN 'view' THEN '{"segment_index": "' || CAST(user_id AS VARCHAR) || '"}'
    WHEN 'signup' THEN '{}'
    WHEN 'purchase' THEN '{"segment_index": ' || CAST(user_id - 100 AS VARCHAR) || '}'
    ELSE '{"segment_index": ' || CAST(user_id AS VARCHAR) || '.0}' END, '$.segment_index') AS raw FROM events),
  req1 AS (SELECT request_id, regexp_replace(trim(raw), '\\.0*$', '') AS txt FROM req),
  req2 AS (SELECT request_id, txt, coalesce(TRY_CAST(txt AS BIGINT) >= 1
    AND TRY_CAST(txt AS DOUBLE) = CAST(TRY_CAST(txt AS BIGINT) AS DOUBLE), false) AS ok FROM req1),
  req3 AS (SELECT request_id, ok, CASE WHEN ok THEN TRY_CAST(txt AS BIGINT) END AS segment_index FROM req2)"""
SQL["answer_request_bodies"] = _with(SR, LATEST, RG, PR, LATEST_PRED, VIEW, _BODY) + """SELECT request_id, segment_index,
  status, CASE WHEN status = 200 THEN current END AS current FROM (
  SELECT r.request_id, r.segment_index,
    CASE WHEN NOT r.ok THEN 400 WHEN v.current IS NULL THEN 404 ELSE 200 END AS status, v.current
  FROM req3 r LEFT JOIN view v ON v.segment_index = r.segment_index)"""

SQL["src_snapshot_quarantine"] = """SELECT CASE WHEN o_orderkey % 41 = 0 THEN 'rejected' ELSE 'read' END AS status,
  CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderkey % 3 + 1 AS BIGINT) END AS n_results FROM orders"""


def _forecastable(where: str) -> str:
    """Shapes with a value among their newest 96 records of those that ``where`` admits."""
    return f"""SELECT DISTINCT shape_hash FROM (SELECT shape_hash, speed_ms,
    row_number() OVER (PARTITION BY shape_hash ORDER BY seq DESC) AS rn FROM recs WHERE {where})
    WHERE rn <= 96 AND speed_ms IS NOT NULL"""


SQL["run_pipeline"] = _with(SN) + f"""SELECT c.shape_hash, c.n AS n_records, c.n AS n_transformed,
  CASE WHEN f.shape_hash IS NOT NULL THEN (SELECT count(*) FROM recs) END AS seq
  FROM (SELECT shape_hash, count(*) AS n FROM recs GROUP BY 1) c
  LEFT JOIN ({_forecastable('TRUE')}) f ON f.shape_hash = c.shape_hash"""
_E, _L = "snapshot_ts < '19980415T000000'", "snapshot_ts >= '19980415T000000'"
SQL["run_counters"] = _with(SN) + f"""SELECT * FROM (VALUES
  (0::BIGINT, (SELECT count(*) FROM sn WHERE {_E}), (SELECT count(*) FROM recs WHERE {_E}),
   (SELECT count(*) FROM recs WHERE {_E}), (SELECT count(*) FROM ({_forecastable(_E)}))),
  (1::BIGINT, (SELECT count(*) FROM sn WHERE {_L}), (SELECT count(*) FROM recs WHERE {_L}),
   (SELECT count(*) FROM recs WHERE {_L}), (SELECT count(*) FROM ({_forecastable('TRUE')}))),
  (2::BIGINT, (SELECT count(*) FROM sn WHERE {_L}), (SELECT count(*) FROM recs WHERE {_L}), 0::BIGINT, 0::BIGINT))
  v(run, extracted, written, inserted, forecasted)"""
SQL["answer_notice"] = _with(*_forecast_base()) + """SELECT event_id AS request_id,
  CASE WHEN event_type = 'click' THEN 200 ELSE 400 END::BIGINT AS status,
  CASE WHEN event_type = 'click' THEN (SELECT count(*) FROM rec WHERE t = 0) END AS forecasted FROM events"""
