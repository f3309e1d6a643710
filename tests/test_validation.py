"""Bounds and request checks (cases from the reference's schema tests)."""

from pyspark.sql import functions as F

from roadspeed.functions.geo import valid_location, valid_segment
from roadspeed.operators.serving import answer_requests


def test_location_bounds(spark):
    rows = [(10.776889, 106.695278, True), (90.0, 180.0, True), (-90.0, -180.0, True),
            (91.0, 0.0, False), (-91.0, 0.0, False), (0.0, 181.0, False), (0.0, -181.0, False),
            (None, 0.0, False)]
    df = spark.createDataFrame(rows, "lat double, lng double, expect boolean")
    got = df.select(valid_location(F.col("lat"), F.col("lng")).alias("ok"), "expect").collect()
    assert all(r.ok == r.expect for r in got)


def test_segment_index_check(spark):
    rows = [("1", True), ("999999", True), ("0", False), ("-1", False), ("1.5", False),
            ("abc", False), (None, False), ("5.0", True), ("5.", True), ("-1.0", False), (" 7 ", True)]
    df = spark.createDataFrame(rows, "raw string, expect boolean")
    got = df.select(valid_segment(F.col("raw")).alias("ok"), "expect").collect()
    assert all(r.ok == r.expect for r in got)


def test_request_status(spark):
    view = spark.createDataFrame(
        [(1, "A", 36.0, [1.0] * 12), (2, "B", None, None), (3, None, None, None)],
        "segment_index long, name string, current double, predict array<double>")
    req = spark.createDataFrame([(1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, None), (6, "-1")],
                                "request_id long, segment_index string")
    cur = {r.request_id: r.status for r in answer_requests(req, view, "current").collect()}
    assert cur == {1: 200, 2: 404, 3: 404, 4: 404, 5: 400, 6: 400}
    pred = {r.request_id: r.status for r in answer_requests(req, view, "predict").collect()}
    # predict answers 404 only when both name and current are missing
    assert pred == {1: 200, 2: 200, 3: 404, 4: 404, 5: 400, 6: 400}


def test_bounding_box_never_drops_points_inside_the_circle(spark):
    import random

    from roadspeed.functions.geo import haversine_m, within_circle
    rnd = random.Random(3)
    centres = [(10.776889, 106.695278), (60.0, 10.0), (-45.0, -70.0), (85.0, 0.0),
               (60.0, 175.0), (-20.0, -178.0), (88.0, 10.0)]
    for lat0, lng0 in centres:
        for radius in (15_000.0, 200_000.0, 1_000_000.0):
            span = min(radius / 111_000.0 * 3, 60)
            pts = [(max(-90.0, min(90.0, lat0 + rnd.uniform(-span, span))),
                    (lng0 + rnd.uniform(-span * 3, span * 3) + 180.0) % 360.0 - 180.0) for _ in range(400)]
            df = spark.createDataFrame(pts, "lat double, lng double")
            got = df.select(
                within_circle(F.col("lat"), F.col("lng"), lat0, lng0, radius).alias("fast"),
                (haversine_m(F.col("lat"), F.col("lng"), lat0, lng0) <= radius).alias("exact")).collect()
            assert all(r.fast == r.exact for r in got), (lat0, lng0, radius)


def test_request_bodies(spark):
    from roadspeed.operators.serving import parse_request_body
    view = spark.createDataFrame([(5, "A", 36.0, None)],
                                 "segment_index long, name string, current double, predict array<double>")
    bodies = spark.createDataFrame(
        [(1, "{}"), (2, '{"segment_index": -1}'), (3, '{"segment_index": 5}'), (4, '{"segment_index": "5"}'),
         (5, '{"segment_index": 5.0}'), (6, "not json"), (7, '{"segment_index": 6}')],
        "request_id long, body string")
    got = {r.request_id: r.status for r in answer_requests(parse_request_body(bodies), view, "current").collect()}
    assert got == {1: 400, 2: 400, 3: 200, 4: 200, 5: 200, 6: 400, 7: 404}
