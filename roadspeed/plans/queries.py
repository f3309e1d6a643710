"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables (through the stand-ins of ``standins``). Output columns are
named exactly as in the SQL oracle (``oracle.py``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.metrics import kmh, speed_band
from ..functions.names import api_name, display_name, registry_name
from ..functions.shape import parse_shape, shape_center
from ..functions.wavelet import explode_positions, soft
from ..operators import circles as CI
from ..operators import denoise as D
from ..operators import forecast as FC
from ..operators import history as H
from ..operators import name_index as NI
from ..operators import parse as P
from ..operators import raw_flow as RF
from ..operators import records as RC
from ..operators import registry as R
from ..operators import serving as SV
from ..operators import series as S
from ..session import kept, scratch_path
from ..sources import snapshots as SS
from ..sources import tables as TB
from . import etl as ETL
from . import standins as SI

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TIME = "2024-02-01 00:00:00"
SHORT_N = 24          # a history length that cuts at every scale
SEARCH_TEXT = " 12 "  # padded on purpose: the search trims


def query(fn: Query | None = None, *, name: str | None = None):
    """Register ``fn`` under its own name (or ``name``)."""
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        return f
    return add(fn) if fn is not None else add


def _r(col, digits: int = 6) -> F.Column:
    """Round for comparison; ``+ 0.0`` folds -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def _ra(col, digits: int = 6) -> F.Column:
    return F.transform(col, lambda v: F.round(v, digits) + F.lit(0.0))


# --- history and aggregates over speed records --------------------------

@query
def latest_speed(spark, sf):
    return H.latest_speed(SI.speed_records(spark, sf))


@query
def current_speed(spark, sf):
    return SV.current_speed(SI.registry(spark, sf), SI.speed_records(spark, sf))


@query
def recent_history(spark, sf):
    return H.recent_history(SI.speed_records(spark, sf))


@query
def recent_history_short(spark, sf):
    return H.recent_history(SI.speed_records(spark, sf), SHORT_N)


@query
def recent_history_incremental(spark, sf):
    """Newest-N state kept over two halves of the records, then read as
    history: equals ``recent_history`` over everything."""
    sr = SI.speed_records(spark, sf)
    cut = F.col("IngestedAt") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    state = H.update_recent(H.empty_recent(spark), sr.filter(cut))
    state = H.update_recent(state, sr.filter(~cut))
    return H.recent_history(state)


@query
def series_array(spark, sf):
    return H.series_array(H.recent_history(SI.speed_records(spark, sf)))


@query
def max_history(spark, sf):
    return H.max_history(H.series_array(H.recent_history(SI.speed_records(spark, sf))))


@query
def speed_kmh(spark, sf):
    sr = SI.speed_records(spark, sf)
    return sr.select("segment_index", "seq", kmh(F.col("Speed")).alias("speed_kmh"))


@query
def latest_prediction(spark, sf):
    return H.latest_prediction(SI.predictions(spark, sf))


# --- serving --------------------------------------------------------------

@query
def segments_with_history(spark, sf):
    return SV.segments_with_history(SI.registry(spark, sf), SI.speed_records(spark, sf)) \
        .select("segment_index", "name")


@query
def silent_segments(spark, sf):
    return SV.silent_segments(SI.registry(spark, sf), SI.speed_records(spark, sf)) \
        .select("segment_index")


@query
def prediction_view(spark, sf):
    return SV.prediction_view(SI.registry(spark, sf), SI.speed_records(spark, sf),
                              SI.predictions(spark, sf))


@query(name="speed_band")
def speed_band_view(spark, sf):
    v = SV.prediction_view(SI.registry(spark, sf), SI.speed_records(spark, sf),
                           SI.predictions(spark, sf))
    return v.select("segment_index", "current", speed_band(F.col("current")).alias("band"))


@query
def forecast_summary(spark, sf):
    return FC.forecast_summary(H.latest_prediction(SI.predictions(spark, sf))) \
        .select("segment_index", F.col("next_10").cast("long").alias("next_10"),
                F.col("next_60").cast("long").alias("next_60"))


@query
def forecast_steps(spark, sf):
    return FC.forecast_steps(SI.predictions(spark, sf)).withColumnRenamed("seq", "pred_seq")


def _requests(spark, sf) -> DataFrame:
    """A request log derived from events: valid, unknown and malformed ids."""
    ev = SI.table(spark, sf, "events")
    uid = F.col("user_id")
    raw = (F.when(F.col("event_type") == "click", uid.cast("string"))
           .when(F.col("event_type") == "view", (uid - 100).cast("string"))
           .when(F.col("event_type") == "signup", (uid + 1400).cast("string"))
           .when(F.col("event_type") == "purchase",
                 F.concat(uid.cast("string"), F.when(uid % 2 == 0, F.lit(".0")).otherwise(F.lit(".5"))))
           .otherwise(F.lit("abc")))
    return ev.select(F.col("event_id").alias("request_id"), raw.alias("segment_index"))


def _request_bodies(spark, sf) -> DataFrame:
    """Raw JSON request bodies derived from events: numbers, strings,
    zero-decimal numbers, empty bodies and non-positive ids."""
    ev = SI.table(spark, sf, "events")
    uid = F.col("user_id").cast("string")
    et = F.col("event_type")
    body = (F.when(et == "click", F.concat(F.lit('{"segment_index": '), uid, F.lit("}")))
            .when(et == "view", F.concat(F.lit('{"segment_index": "'), uid, F.lit('"}')))
            .when(et == "signup", F.lit("{}"))
            .when(et == "purchase", F.concat(F.lit('{"segment_index": '),
                                             (F.col("user_id") - 100).cast("string"), F.lit("}")))
            .otherwise(F.concat(F.lit('{"segment_index": '), uid, F.lit(".0}"))))
    return ev.select(F.col("event_id").alias("request_id"), body.alias("body"))


@query
def answer_request_bodies(spark, sf):
    view = SV.prediction_view(SI.registry(spark, sf), SI.speed_records(spark, sf),
                              SI.predictions(spark, sf))
    return SV.answer_requests(SV.parse_request_body(_request_bodies(spark, sf)), view, "current")


@query
def answer_location_bodies(spark, sf):
    """Nested location bodies: numbers, numeric texts, missing and null parts, out of bounds, no JSON."""
    ev = SI.table(spark, sf, "events")
    et, uid = F.col("event_type"), F.col("user_id")
    lat = F.concat((uid % 120).cast("string"), F.lit(".25"))
    lng = F.concat(F.lit("-"), (uid % 240).cast("string"), F.lit(".5"))
    body = (F.when(et == "click", F.concat(F.lit('{"location": {"lat": '), lat, F.lit(', "lng": '), lng, F.lit("}}")))
            .when(et == "view", F.concat(F.lit('{"location": {"lat": "'), lat, F.lit('", "lng": "'), lng, F.lit('"}}')))
            .when(et == "signup", F.concat(F.lit('{"location": {"lat": '), lat, F.lit("}}")))
            .when(et == "purchase", F.concat(F.lit('{"location": {"lng": '), lng, F.lit(', "lat": null}}')))
            .otherwise(F.concat(F.lit('{"location": '), lat)))
    out = SV.answer_locations(ev.select(F.col("event_id").alias("request_id"), body.alias("body")))
    return out.withColumn("status", F.col("status").cast("long"))


@query
def request_status(spark, sf):
    view = SV.prediction_view(SI.registry(spark, sf), SI.speed_records(spark, sf),
                              SI.predictions(spark, sf))
    return SV.answer_requests(_requests(spark, sf), view, "current")


@query
def answer_predict(spark, sf):
    view = SV.prediction_view(SI.registry(spark, sf), SI.speed_records(spark, sf),
                              SI.predictions(spark, sf))
    return SV.answer_requests(_requests(spark, sf), view, "predict")


def _with_counter(spark, sf) -> DataFrame:
    """Registry as imported from a key-value store, counter row included."""
    rg = SI.registry(spark, sf)
    counter = rg.agg(F.max("segment_index").alias("segment_index")).select(
        F.lit(R.COUNTER_KEY).alias("shape_hash"), "segment_index",
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("shape"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("long").alias("first_seq"))
    return rg.unionByName(counter)


@query
def registry_scan(spark, sf):
    return R.drop_sentinel(_with_counter(spark, sf)).select("shape_hash", "segment_index", "name", "shape")


@query
def segment_count(spark, sf):
    return SV.segment_count(R.drop_sentinel(_with_counter(spark, sf)))


@query
def name_fallback(spark, sf):
    rg = SI.registry(spark, sf)
    idx, name = F.col("segment_index"), F.col("name")
    return rg.select("segment_index", registry_name(name, idx).alias("registry_name"),
                     api_name(name).alias("api_name"), display_name(name, idx).alias("display_name"))


def _flat_shape(df: DataFrame) -> DataFrame:
    return (df.withColumn("lats", F.transform("shape", lambda p: p["lat"]))
              .withColumn("lngs", F.transform("shape", lambda p: p["lng"])).drop("shape"))


@query
def list_segments(spark, sf):
    return _flat_shape(SV.list_segments(SI.registry(spark, sf)))


@query
def search_segments(spark, sf):
    rg = SI.registry(spark, sf).select("segment_index", "name")
    return SV.search_segments(rg, SEARCH_TEXT)


SEARCHED = ["", "7", "12", " 012 ", "ER#00000012", "segment"]


@query
def search_indexed(spark, sf):
    """Searches answered from the gram index: empty, short, long and unknown texts."""
    path = scratch_path(spark, "name-index")
    NI.write_index(SI.registry(spark, sf, dealt=True).select("segment_index", "name"), path)
    found = [NI.search_index(spark, path, q).select(F.lit(q).alias("q"), "segment_index", "name") for q in SEARCHED]
    return reduce(DataFrame.unionByName, found)


@query
def drawable_segments(spark, sf):
    segs = SV.list_segments(SI.registry(spark, sf))
    return SV.drawable(segs).select("segment_index", F.size("shape").cast("long").alias("n_points"))


@query
def lookup_segments(spark, sf):
    keys = H.latest_speed(SI.speed_records(spark, sf)).select("segment_index")
    return R.lookup_segments(keys, SI.registry(spark, sf))


# --- geography ------------------------------------------------------------

@query
def valid_location(spark, sf):
    gp = SI.geo_points(spark, sf)
    return gp.select("point_id", "lat", "lng", G.valid_location(F.col("lat"), F.col("lng")).alias("is_valid"))


GEO_RADIUS_M = 50_000.0


@query
def geo_circle(spark, sf):
    gp = SI.geo_points(spark, sf)
    lat0, lng0 = G.DEFAULT_CENTER
    inside = gp.filter(G.within_circle(F.col("lat"), F.col("lng"), lat0, lng0, GEO_RADIUS_M))
    return inside.select("point_id", _r(G.haversine_m(F.col("lat"), F.col("lng"), lat0, lng0), 3).alias("dist_m"))


@query
def geo_circles(spark, sf):
    """Every point of the globe's stand-in within every supplier's circle."""
    out = CI.within_circles(SI.globe_points(spark, sf), SI.globe_circles(spark, sf))
    return out.select("point_id", "circle_id", _r(F.col("dist_m"), 2).alias("dist_m"))


# --- series ---------------------------------------------------------------

def _series(spark, sf, n: int = H.HISTORY_LEN) -> DataFrame:
    return H.series_array(H.recent_history(SI.speed_records(spark, sf), n))


@query
def variate_position(spark, sf):
    return S.variate_position(_series(spark, sf)).select("segment_index", "network", "variate")


@query
def pad_series(spark, sf):
    ser = S.variate_position(_series(spark, sf))
    return S.pad_series(ser, by="network").select("segment_index", "series", "n")


@query
def series_matrix_long(spark, sf):
    ser = S.pad_series(S.variate_position(_series(spark, sf)), by="network")
    return S.series_matrix(ser).select("segment_index", F.col("pos").cast("long").alias("pos"), "value")


@query
def pad_width(spark, sf):
    ser = S.pad_series(S.variate_position(_series(spark, sf)), by="network")
    m = S.pad_width(S.series_matrix(ser))
    return m.select("network", "variate", F.col("pos").cast("long").alias("pos"), "value")


@query
def series_matrix_wide(spark, sf):
    ser = S.pad_series(S.variate_position(_series(spark, sf)), by="network")
    m = S.pad_width(S.series_matrix(ser)).withColumn("pos", F.col("pos").cast("long"))
    return S.series_matrix_wide(m)


@query
def instance_norm(spark, sf):
    out = S.instance_norm(_series(spark, sf))
    return out.select("segment_index", _r(F.col("mean")).alias("mean"),
                      _r(F.col("stdev")).alias("stdev"), _ra(F.col("normed")).alias("normed"))


@query
def denormalize(spark, sf):
    stats = S.instance_norm(_series(spark, sf)).select("segment_index", "mean", "stdev")
    fc = H.latest_prediction(SI.predictions(spark, sf)).select("segment_index", F.col("predict").alias("forecast"))
    out = S.denormalize(fc.join(stats, "segment_index"))
    return out.select("segment_index", _ra(F.col("forecast")).alias("forecast"))


@query
def patches(spark, sf):
    return S.patches(_series(spark, sf)).select(
        "segment_index", F.col("patch").cast("long").alias("patch"), "values")


# --- wavelet ----------------------------------------------------------------

def _kmh_series(spark, sf) -> DataFrame:
    return _series(spark, sf).withColumn("series", F.transform("series", lambda v: v * F.lit(3.6)))


@query
def dwt_coeffs(spark, sf):
    c = D.dwt_coeffs(_kmh_series(spark, sf))
    return c.select("segment_index", explode_positions(F.arrays_zip("ca", "cd"), "k", "c")) \
        .filter(F.col("k").isNotNull()) \
        .select("segment_index", F.col("k").cast("long").alias("k"),
                _r(F.col("c.ca")).alias("ca"), _r(F.col("c.cd")).alias("cd"))


@query
def denoise_sigma(spark, sf):
    c = D.with_threshold(D.dwt_coeffs(_kmh_series(spark, sf)))
    return c.select("segment_index", _r(F.col("sigma")).alias("sigma"), _r(F.col("threshold")).alias("threshold"))


@query
def soft_threshold(spark, sf):
    c = D.with_threshold(D.dwt_coeffs(_kmh_series(spark, sf)))
    c = c.withColumn("cds", soft(F.col("cd"), F.col("threshold")))
    return c.select("segment_index", explode_positions(F.col("cds"), "k", "v")) \
        .filter(F.col("k").isNotNull()) \
        .select("segment_index", F.col("k").cast("long").alias("k"), _r(F.col("v")).alias("cd_soft"))


@query
def denoise_series(spark, sf):
    ser = S.pad_series(S.variate_position(_series(spark, sf)), by="network")
    out = D.denoise(ser, "series")
    return out.select("segment_index", explode_positions(F.col("denoised"), "pos", "v")) \
        .filter(F.col("pos").isNotNull()) \
        .select("segment_index", F.col("pos").cast("long").alias("pos"), _r(F.col("v"), 4).alias("value"))


# --- forecasting ------------------------------------------------------------

def _levels(spark, sf, **how) -> DataFrame:
    out = D.denoise(_series(spark, sf), "series", **how)
    return out.select("segment_index", explode_positions(F.col("denoised"), "pos", "v")).filter(F.col("pos").isNotNull()) \
        .select("segment_index", F.col("pos").cast("long").alias("pos"), _r(F.col("v"), 4).alias("value"))


@query
def denoise_levels(spark, sf):
    """Three levels of db4 with hard thresholds."""
    return _levels(spark, sf, level=3, mode="hard")


@query
def denoise_levels_db2(spark, sf):
    """Two levels of db2 with soft thresholds."""
    return _levels(spark, sf, wavelet="db2", level=2)


def _forecast(spark, sf, scorer) -> DataFrame:
    return FC.forecast(SI.speed_records(spark, sf), SI.registry(spark, sf), scorer=scorer,
                       run_time=RUN_TIME).select("Time", "segment_index", "Speed")


@query
def forecast_persistence(spark, sf):
    return _forecast(spark, sf, "persistence")


@query
def forecast_trend(spark, sf):
    return _forecast(spark, sf, "trend")


@query
def forecast_network(spark, sf):
    return _forecast(spark, sf, FC.trend_matrix)


# --- snapshots: parsing, shapes, registration -----------------------------


SPLIT_SNAPSHOT = "19980415T000000"   # early / late halves of the snapshots


def _parsed(spark, sf, reused: bool = False) -> DataFrame:
    """Parsed stand-in snapshots; kept when read twice, with what registration reads."""
    parsed = P.parse_snapshot(SI.snapshots(spark, sf))
    return kept(parsed.select("seq", "snapshot_ts", "name", "shape_json", "shape_hash"), "parsed") if reused else parsed


def _lat_lng(df: DataFrame, col: str = "shape") -> DataFrame:
    return df.select("seq", F.size(col).cast("long").alias("n_points"),
                     F.transform(col, lambda p: p["lat"]).alias("lats"),
                     F.transform(col, lambda p: p["lng"]).alias("lngs"))


@query
def parse_results(spark, sf):
    return P.explode_results(SI.snapshots(spark, sf)).select("seq", "snapshot_ts", "pos")


@query
def filter_links(spark, sf):
    return P.has_links(P.explode_results(SI.snapshots(spark, sf))).select("seq")


@query
def flow_fields(spark, sf):
    return P.flow_fields(P.explode_results(SI.snapshots(spark, sf))).select(
        "seq", "name", "speed_ms", "jam_factor", "free_flow_speed", "confidence")


def _flow_of_texts(spark, sf, strict: bool) -> DataFrame:
    """Flow fields of the raw texts; descriptions of keys that end in 5 are an explicit null."""
    docs = SI.snapshot_docs(spark, sf)
    docs = docs.withColumn("value", F.regexp_replace("value", r'"Road \d*5"', "null"))
    return RF.flow_fields_of_texts(RF.explode_texts(docs), strict).select(
        (F.col("seq") * P.SEQ_SLOTS + F.col("pos")).alias("seq"),
        "name", "speed_ms", "jam_factor", "free_flow_speed", "confidence")


@query
def flow_fields_default(spark, sf):
    return _flow_of_texts(spark, sf, strict=False)


@query
def flow_fields_strict(spark, sf):
    return _flow_of_texts(spark, sf, strict=True)


@query
def shape_points(spark, sf):
    return _lat_lng(P.shape_columns(P.explode_results(SI.snapshots(spark, sf))))


@query
def shape_json(spark, sf):
    return _parsed(spark, sf).select("seq", "shape_json")


@query
def shape_hash(spark, sf):
    return _parsed(spark, sf).select("seq", "shape_hash")


@query
def shape_parse(spark, sf):
    return _lat_lng(_parsed(spark, sf).withColumn("back", parse_shape(F.col("shape_json"))), "back")


@query(name="shape_center")
def shape_center_view(spark, sf):
    c = P.shape_columns(P.explode_results(SI.snapshots(spark, sf))).select(
        "seq", shape_center(F.col("shape")).alias("c"))
    return c.select("seq", F.col("c.lat").alias("center_lat"), F.col("c.lng").alias("center_lng"))


@query
def run_metrics(spark, sf):
    return RC.run_metrics(P.explode_results(SI.snapshots(spark, sf)))


@query
def first_seen(spark, sf):
    return R.first_seen(_parsed(spark, sf))


@query
def new_shapes(spark, sf):
    parsed = _parsed(spark, sf, reused=True)
    early = R.register_segments(parsed.filter(F.col("snapshot_ts") < SPLIT_SNAPSHOT),
                                R.empty_registry(spark), created_at=RUN_TIME)
    late = parsed.filter(F.col("snapshot_ts") >= SPLIT_SNAPSHOT)
    return R.new_shapes(late, early).select("seq", "shape_hash")


def _registry_cols(df: DataFrame) -> DataFrame:
    return df.select("shape_hash", "segment_index", "name", "first_seq")


@query
def register_segments(spark, sf):
    return _registry_cols(R.register_segments(_parsed(spark, sf, reused=True), R.empty_registry(spark), created_at=RUN_TIME))


@query
def register_incremental(spark, sf):
    parsed = _parsed(spark, sf, reused=True)
    early = R.register_segments(parsed.filter(F.col("snapshot_ts") < SPLIT_SNAPSHOT),
                                R.empty_registry(spark), created_at=RUN_TIME)
    full = R.register_segments(parsed.filter(F.col("snapshot_ts") >= SPLIT_SNAPSHOT), early,
                               created_at=RUN_TIME)
    return _registry_cols(full)


@query
def attach_segment(spark, sf):
    parsed = _parsed(spark, sf, reused=True)
    reg = R.register_segments(parsed, R.empty_registry(spark), created_at=RUN_TIME)
    return R.attach_segment(parsed, reg).select("seq", "segment_index")


@query
def stamp_ingest(spark, sf):
    return RC.stamp_ingest(_parsed(spark, sf), RUN_TIME).select("seq", "ingested_at")


@query(name="speed_record_projection")
def etl_records(spark, sf):
    out = ETL.transform_run(SI.snapshots(spark, sf), R.empty_registry(spark), ingested_at=RUN_TIME)
    return out.records.drop("snapshot_ts", "doc_key", "pos")


@query
def etl_transformed(spark, sf):
    out = ETL.transform_run(SI.snapshots(spark, sf), R.empty_registry(spark), ingested_at=RUN_TIME)
    return out.transformed.select("seq", "segment_index", "shape_hash", "name", "speed_ms", "speed_kmh",
                                  "snapshot_ts")


# --- sources and sinks (round trips through the shared checkpoint folder) --

@query
def src_snapshot_json(spark, sf):
    path = scratch_path(spark, "raw")
    SS.write_raw(SI.snapshot_docs(spark, sf), path, by_snapshot=False)
    docs = SS.read_snapshots(spark, path)
    return P.parse_snapshot(docs).select("seq", "snapshot_ts", "name", "speed_ms", "shape_hash")


@query
def sink_transformed_roundtrip(spark, sf):
    path = scratch_path(spark, "transformed")
    out = ETL.transform_run(SI.snapshots(spark, sf), R.empty_registry(spark), ingested_at=RUN_TIME)
    TB.write_transformed(out.transformed, path)
    back = TB.read_transformed(spark, path)
    return back.select("seq", "segment_index", "shape_hash", "name", "speed_ms", "speed_kmh", "snapshot_ts")


@query
def sink_speed_records(spark, sf):
    path = scratch_path(spark, "records")
    sr = SI.speed_records(spark, sf)
    TB.append_speed_records(sr, path)
    TB.append_speed_records(sr, path)        # a replay adds nothing
    return TB.speed_records(spark, path).select("segment_index", "seq", "Speed", "SpeedKmh")


@query
def point_reads(spark, sf):
    """Registry rows by shape hash from a stored registry: known and unknown ones."""
    path = scratch_path(spark, "registry")
    rg = SI.registry(spark, sf)
    TB.extend_registry(spark, path, lambda known: rg.join(known, "segment_index", "left_anti"))
    asked = [hashlib.sha256(str(k).encode()).hexdigest() for k in (0, 7, 77, 10**9)]
    return TB.registry_of(spark, path, asked).select("shape_hash", "segment_index", "name")


@query
def sink_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    newest = SI.speed_records(spark, sf).agg(F.max("seq").alias("seq"))  # one row
    fc = _forecast(spark, sf, "persistence").crossJoin(F.broadcast(newest))
    TB.append_predictions(fc, path)
    TB.append_predictions(fc, path)        # a repeated run adds nothing
    return TB.predictions(spark, path).select("Time", "segment_index", "Speed")


@query
def stream_latest(spark, sf):
    from ..streaming.ingest import maintain_latest, read_latest
    src = scratch_path(spark, "records-src")
    sr = SI.speed_records(spark, sf)
    # Land the records as several files so the stream sees several batches.
    sr.repartitionByRange(4, "seq").write.parquet(src)
    out = scratch_path(spark, "latest")
    q = maintain_latest(spark, src, sr.schema, out, scratch_path(spark, "ckpt-latest"), max_files=1)
    q.awaitTermination()
    return read_latest(spark, out)


@query
def stream_recent(spark, sf):
    """Newest-96 state kept by a stream over four landed record files;
    read back as history it equals ``recent_history`` over everything."""
    from ..streaming.ingest import RECENT_SCHEMA, maintain_recent
    src = scratch_path(spark, "records-src")
    sr = SI.speed_records(spark, sf)
    sr.repartitionByRange(4, "seq").write.parquet(src)
    state = scratch_path(spark, "recent-state")
    q = maintain_recent(spark, src, sr.schema, state, scratch_path(spark, "ckpt-recent"), max_files=1)
    q.awaitTermination()
    return H.recent_history(TB.read_state(spark, state, RECENT_SCHEMA))


def _ingested(spark, raw: str, **how) -> DataFrame:
    """(seq, shape_hash, Speed) of the records that a stream over the landed files has stored, in about four batches."""
    from ..streaming.ingest import stream_ingest as start
    landed = len(spark.read.text(raw).inputFiles())
    reg, tr, rec = (scratch_path(spark, n) for n in ("registry", "transformed", "records"))
    q = start(spark, raw, reg, tr, rec, scratch_path(spark, "ckpt-ingest"), trigger=None, max_files=max(1, -(-landed // SI.BATCHES)), **how)
    q.awaitTermination()
    registry = TB.registry(spark, reg)
    return (TB.speed_records(spark, rec).join(registry.select("segment_index", "shape_hash"), "segment_index")
            .select("seq", "shape_hash", "Speed"))


@query
def stream_ingest(spark, sf):
    raw = scratch_path(spark, "landing")
    SI.land(SI.snapshot_docs(spark, sf, order="o_orderkey"), raw)
    return _ingested(spark, raw)


@query
def stream_ingest_replayed(spark, sf):
    """Every document lands twice, in other files: the stream's state and the store keep one of each."""
    raw = scratch_path(spark, "landing")
    SI.land(SI.snapshot_docs(spark, sf, order="o_orderkey"), raw)
    SI.land(SI.snapshot_docs(spark, sf, order="o_custkey"), raw)
    return _ingested(spark, raw, dedup_within="1 day")


@query
def compact_records(spark, sf):
    """Four writes of records, packed into one folder in Z-order: the same rows as before."""
    path = scratch_path(spark, "records")
    sr = SI.speed_records(spark, sf)
    for k in range(4):
        TB.append_speed_records(sr.where(F.col("seq") % 4 == k), path)
    TB.compact_records(spark, path)
    TB.append_speed_records(sr, path)        # the store still knows what it holds
    return TB.speed_records(spark, path).select("segment_index", "seq", "Speed", "SpeedKmh")


@query
def src_snapshot_quarantine(spark, sf):
    """Every landed document is read or set apart, malformed ones included."""
    path = scratch_path(spark, "raw-bad")
    docs = SI.snapshot_docs(spark, sf)
    cut = F.when(F.col("seq") % 41 == 0, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value"))
    SS.write_raw(docs.withColumn("value", cut), path, by_snapshot=False)
    good, bad = SS.read_with_quarantine(spark, path)
    return (good.select(F.lit("read").alias("status"), F.size("results").cast("long").alias("n_results"))
            .unionByName(bad.select(F.lit("rejected").alias("status"), F.lit(None).cast("long").alias("n_results"))))


def _three_runs(spark, sf):
    """The early half, the late half, and the late half once more at another time: (paths, counters)."""
    docs = SI.snapshot_docs(spark, sf)
    # Halved as texts: a half parsed first would build and parse the other half's documents, too.
    early = SI.parsed_docs(docs.filter(F.col("snapshot_ts") < SPLIT_SNAPSHOT))
    late = SI.parsed_docs(docs.filter(F.col("snapshot_ts") >= SPLIT_SNAPSHOT))
    paths = {n: scratch_path(spark, n) for n in ("registry", "transformed", "records", "state", "predictions")}
    counters = []
    for part, at in (early, "2024-02-01 00:00:00"), (late, "2024-02-01 23:59:59"), (late, "2024-02-02 00:00:01"):
        counters.append(ETL.run_batch(part, paths["registry"], paths["transformed"], paths["records"], ingested_at=at,
                                      state_path=paths["state"], predictions_path=paths["predictions"]))
    return paths, counters


@query
def run_pipeline(spark, sf):
    """Two runs and a replay: every segment's newest forecast is the second run's, and nothing is stored twice."""
    paths, _ = _three_runs(spark, sf)
    registry = TB.registry(spark, paths["registry"])
    rows = TB.speed_records(spark, paths["records"]).groupBy("segment_index").agg(F.count("*").alias("n_records"))
    kept = TB.read_transformed(spark, paths["transformed"]).groupBy("segment_index").agg(F.count("*").alias("n_transformed"))
    newest = H.latest_prediction(TB.predictions(spark, paths["predictions"]))
    return (registry.select("segment_index", "shape_hash").join(rows, "segment_index").join(kept, "segment_index")
            .join(newest, "segment_index", "left").select("shape_hash", "n_records", "n_transformed", "seq"))


@query
def run_counters(spark, sf):
    """The four counters of two runs and a replay."""
    _, counters = _three_runs(spark, sf)
    names = ["extracted", "written", "inserted", "forecasted"]
    return spark.createDataFrame([(k, *(c[n] for n in names)) for k, c in enumerate(counters)],
                                 "run long, " + ", ".join(f"{n} long" for n in names))


@query
def answer_notice(spark, sf):
    ev = SI.table(spark, sf, "events")
    et = F.col("event_type")
    notice = F.when(et == "click", "update").when(et == "view", "UPDATE").when(et == "purchase", "delete")
    return SV.answer_notices(ev.select(F.col("event_id").alias("request_id"), notice.alias("notice")),
                             _forecast(spark, sf, "persistence")).withColumn("status", F.col("status").cast("long"))
