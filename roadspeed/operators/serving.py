"""Serving queries as set joins (no per-key lookups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import segment_text, valid_location, valid_segment
from ..functions.metrics import kmh
from ..functions.names import api_name
from ..functions.shape import parse_shape
from . import history as H


def segments_with_history(registry: DataFrame, sr: DataFrame, n: int = H.HISTORY_LEN) -> DataFrame:
    """Registered segments with at least one non-null value among their
    newest n records."""
    return registry.join(_with_values(sr, n), "segment_index", "left_semi")


def _with_values(sr: DataFrame, n: int) -> DataFrame:
    """Segments with a value among their newest n records, one row each."""
    return H.recent_history(sr, n).groupBy("segment_index").agg(F.count(F.lit(1)).alias("_n")).select("segment_index")


def silent_segments(registry: DataFrame, sr: DataFrame, n: int = H.HISTORY_LEN) -> DataFrame:
    """Registered segments without usable history."""
    return registry.join(_with_values(sr, n), "segment_index", "left_anti")


def current_speed(registry: DataFrame, sr: DataFrame) -> DataFrame:
    """km/h of each registered segment's newest record; a null newest
    speed means no answer for that segment."""
    latest = H.latest_speed(sr).filter(F.col("speed").isNotNull())
    return (registry.select("segment_index").join(latest, "segment_index", "inner")
            .select("segment_index", kmh(F.col("speed")).alias("current")))


def prediction_view(registry: DataFrame, sr: DataFrame, pr: DataFrame) -> DataFrame:
    """Name, current km/h and newest forecast per registered segment."""
    cur = H.latest_speed(sr).select("segment_index", kmh(F.col("speed")).alias("current"))
    pred = H.latest_prediction(pr).select("segment_index", "predict")
    return (registry.select("segment_index", "name")
            .join(cur, "segment_index", "left")
            .join(pred, "segment_index", "left"))


def parse_request_body(df: DataFrame, body: str = "body") -> DataFrame:
    """Raw JSON request bodies -> (request_id, segment_index text).

    A body that is not JSON, or lacks the key, yields a null index (answered
    400); numbers and strings are both kept as their text.
    """
    m = F.from_json(F.col(body), "map<string,string>")
    return df.select("request_id", m["segment_index"].alias("segment_index"))


def answer_locations(df: DataFrame, body: str = "body") -> DataFrame:
    """Answer JSON bodies ``{"location": {"lat": .., "lng": ..}}``: request_id, status, lat, lng.

    200 with the two numbers (numeric texts count) if both are there and within
    bounds, ends included; else 400 and nulls, as for a body that is no JSON.
    """
    doc = F.try_parse_json(F.col(body))
    found = df.select("request_id", *[F.try_variant_get(doc, f"$.location.{k}", "double").alias(k) for k in ("lat", "lng")])
    ok = valid_location(F.col("lat"), F.col("lng"))
    return found.select("request_id", F.when(ok, 200).otherwise(400).alias("status"),
                        *[F.when(ok, F.col(k)).alias(k) for k in ("lat", "lng")])


def answer_requests(requests: DataFrame, view: DataFrame, kind: str = "predict") -> DataFrame:
    """Answer a batch of requests (``request_id``, raw ``segment_index``).

    400 when the index is not an integer >= 1; for ``current`` 404 when the
    segment is unknown or has no current speed; for ``predict`` 404 when
    both name and current are missing; else 200.
    """
    req = requests.select("request_id", F.col("segment_index").cast("string").alias("_raw"))
    req = req.withColumn("_ok", valid_segment(F.col("_raw")))
    req = req.withColumn("segment_index", F.when(F.col("_ok"), segment_text(F.col("_raw")).try_cast("long")))
    # Rejected requests share no key and take no part in the join; the view is
    # cut to the requested segments first.
    asked = req.filter(F.col("segment_index").isNotNull())
    rejected = req.filter(F.col("segment_index").isNull())
    wanted = view.join(asked.select("segment_index").distinct(), "segment_index", "left_semi")
    joined = asked.join(wanted, "segment_index", "left").unionByName(rejected, allowMissingColumns=True)
    if kind == "current":
        found = F.col("current").isNotNull()
        cols = ["current"]
    else:
        found = F.col("name").isNotNull() | F.col("current").isNotNull()
        cols = ["name", "current", "predict"]
    status = (F.when(~F.col("_ok"), F.lit(400)).when(~found, F.lit(404)).otherwise(F.lit(200)))
    return joined.select("request_id", "segment_index", status.alias("status"),
                         *[F.when(status == 200, F.col(c)).alias(c) for c in cols])


def answer_notices(requests: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Answer update notices (``request_id``, ``notice``): 400 unless the notice is
    ``update``, else 200 with the number of forecasts of the run it starts.

    ``forecasts`` is that run's output; a batch of notices starts one run.
    """
    count = forecasts.agg(F.count(F.lit(1)).alias("_n"))  # one row
    ok = F.coalesce(F.col("notice") == "update", F.lit(False))
    return (requests.crossJoin(F.broadcast(count))
            .select("request_id", F.when(ok, 200).otherwise(400).alias("status"), F.when(ok, F.col("_n")).alias("forecasted")))


def list_segments(registry: DataFrame) -> DataFrame:
    """(segment_index, name, shape points) ordered by index."""
    return (registry.select("segment_index", api_name(F.col("name")).alias("name"),
                            parse_shape(F.col("shape")).alias("shape"))
            .orderBy("segment_index"))


def search_segments(df: DataFrame, q: str) -> DataFrame:
    """Case-insensitive, trimmed substring search on name or index text."""
    s = (q or "").strip().lower()
    if not s:
        return df
    return df.filter(F.lower(F.coalesce(F.col("name"), F.lit(""))).contains(s)
                     | F.col("segment_index").cast("string").contains(s))


def drawable(df: DataFrame, col: str = "shape") -> DataFrame:
    """Shapes with at least two points."""
    return df.filter(F.coalesce(F.size(col), F.lit(0)) >= 2)


def segment_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("segment_count"))
