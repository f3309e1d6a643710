"""Bloom filters at point reads, and nested location bodies."""

import hashlib

import pytest
from pyspark.sql import functions as F

from roadspeed.operators.serving import answer_locations
from roadspeed.schemas import REGISTRY
from roadspeed.sources import tables as TB

ROWS = 60_000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registry") / "r")
    # Hashes are spread over all files, so minima and maxima rule nothing out; too many for a dictionary.
    rows = spark.range(0, ROWS, 1, 2).select(F.sha2(F.col("id").cast("string"), 256).alias("shape_hash"), F.col("id").alias("segment_index"))
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in REGISTRY])
    TB.extend_registry(spark, path, lambda known: full)
    return path


def scanned(df):
    """(rows of the result, rows that the scan gave)."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, leaves.head().metrics().get("numOutputRows").get().value()


def digest(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def test_absent_hash_reads_no_row_group(spark, stored):
    rows, read = scanned(TB.registry_of(spark, stored, [digest(10**9)]))
    assert rows == [] and read == 0


def test_without_filters_all_would_be_read(spark, stored):
    spark.conf.set("parquet.filter.bloom.enabled", "false")
    try:
        rows, read = scanned(TB.registry_of(spark, stored, [digest(10**9)]))
    finally:
        spark.conf.unset("parquet.filter.bloom.enabled")
    assert rows == [] and read > 0


def test_known_hashes_are_found(spark, stored):
    rows, read = scanned(TB.registry_of(spark, stored, [digest(5), digest(10**9)]))
    assert [r.segment_index for r in rows] == [5] and 0 < read < ROWS
    assert TB.registry_of(spark, stored, []).collect() == []


def test_location_bodies(spark):
    bodies = ['{"location": {"lat": 10.776889, "lng": 106.695278}}', '{"location": {"lat": 90, "lng": -180}}',
              '{"location": {"lat": "1.5", "lng": "2"}}', '{"location": {"lat": 90.0001, "lng": 0}}', '{"location": {"lat": 0, "lng": 181}}',
              '{"location": {"lat": 0}}', '{"location": {"lat": null, "lng": 0}}', '{"location": null}', "{}", "[]", "", "x", None,
              '{"location": {"lat": "north", "lng": 0}}', '{"location": {"lat": "NaN", "lng": 0}}', '{"lat": 0, "lng": 0}']
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    got = {r.request_id: (r.status, r.lat, r.lng) for r in answer_locations(df).collect()}
    want = {0: (200, 10.776889, 106.695278), 1: (200, 90.0, -180.0), 2: (200, 1.5, 2.0)}
    assert got == {k: want.get(k, (400, None, None)) for k in range(len(bodies))}
