"""Absent keys and explicit nulls in document texts."""

import pytest

from roadspeed.operators.raw_flow import explode_texts, flow_fields_of_texts

FIELDS = ["name", "speed_ms", "jam_factor", "free_flow_speed", "confidence"]
DOCS = [
    '{"results": [{"location": {"description": "A"}, "currentFlow": {"speed": 3, "jamFactor": 0.55, "freeFlow": null}}, {}]}',
    '{"results": [{"location": {"description": null}, "currentFlow": null}, {"location": null, "currentFlow": {"speed": "x"}}]}',
    '{"results": []}', '{"results": null}', "{}", '{"results": 5}', None,
]


def rows(spark, strict):
    df = spark.createDataFrame(list(enumerate(DOCS)), "seq long, value string").selectExpr("*", "'z' as pos")
    out = flow_fields_of_texts(explode_texts(df), strict)
    return {(r.seq, r.pos): tuple(r[f] for f in FIELDS) for r in out.collect()}


def test_default_gives_defaults_for_both(spark):
    assert rows(spark, False) == {(0, 0): ("A", 3.0, 0.55, 0.0, 0.0), (0, 1): ("", 0.0, 0.0, 0.0, 0.0),
                                  (1, 0): ("", 0.0, 0.0, 0.0, 0.0), (1, 1): ("", None, 0.0, 0.0, 0.0)}


def test_strict_keeps_explicit_nulls(spark):
    assert rows(spark, True) == {(0, 0): ("A", 3.0, 0.55, None, 0.0), (0, 1): ("", 0.0, 0.0, 0.0, 0.0),
                                 (1, 0): (None, 0.0, 0.0, 0.0, 0.0), (1, 1): ("", None, 0.0, 0.0, 0.0)}


def test_text_that_is_no_json_raises(spark):
    with pytest.raises(Exception, match="MALFORMED"):
        explode_texts(spark.createDataFrame([("{",)], "value string")).collect()
