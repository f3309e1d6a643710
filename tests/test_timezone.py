"""Results do not depend on the session time zone."""

import collections

import pytest

from roadspeed.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parse_results", "forecast_steps", "stamp_ingest", "speed_record_projection"])
def test_same_result_in_other_time_zone(spark, name):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    a = collections.Counter(tuple(r) for r in QUERIES[name](spark, SF).collect())
    b = collections.Counter(tuple(r) for r in QUERIES[name](other, SF).collect())
    assert a == b
