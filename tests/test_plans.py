"""Plan shapes that the design relies on at scale."""

import re

from pyspark.sql import functions as F

from roadspeed.operators import forecast as FC
from roadspeed.operators import history as H
from roadspeed.operators import registry as R
from roadspeed.plans import standins as SI

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _before_exchange(plan: str, marker: str) -> bool:
    """True when ``marker`` appears below (i.e. before) the first Exchange."""
    lines = plan.split("\n")
    ex = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    return any(marker in l for l in lines[ex + 1:])


def test_recent_history_limits_before_shuffle(spark):
    plan = _plan(H.recent_history(SI.speed_records(spark, SF), 24))
    assert "WindowGroupLimit" in plan and _before_exchange(plan, "WindowGroupLimit")


def test_latest_speed_is_partial_aggregate(spark):
    plan = _plan(H.latest_speed(SI.speed_records(spark, SF)))
    assert _before_exchange(plan, "partial_max_by")


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(H.latest_speed(SI.speed_records(spark, SF)))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert "props" not in schema and "ts:" not in schema


def test_network_scorer_shares_one_network_shuffle(spark):
    df = FC.forecast(SI.speed_records(spark, SF), SI.registry(spark, SF), scorer=FC.trend_matrix,
                     run_time="2024-02-01 00:00:00")
    plan = _plan(df.select(F.col("segment_index")))
    assert plan.count("hashpartitioning(network") == 1


def test_forecast_deals_small_series_to_all_tasks(spark):
    ser = FC.prepared_series(SI.speed_records(spark, SF), SI.registry(spark, SF))
    assert ser.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert ser.count() == ser.select("segment_index").distinct().count() > 0


def test_halves_of_documents_are_cut_before_their_texts(spark):
    half = SI.parsed_docs(SI.snapshot_docs(spark, SF).where(F.col("snapshot_ts") < "19980415T000000"))
    lines = _plan(half).split("\n")
    parse = next(i for i, l in enumerate(lines) if "from_json" in l)
    assert "from_json" not in "".join(l for l in lines if re.search(r"\bFilter\b", l))
    assert any(re.search(r"\bFilter\b", l) for l in lines[parse + 1:])
    assert sorted(map(str, half.collect())) == sorted(map(str, SI.snapshots(spark, SF).where("snapshot_ts < '19980415T000000'").collect()))


def test_snapshot_texts_are_written_once(spark):
    plan = _plan(SI.snapshot_docs(spark, SF))
    assert plan.count('{"links": [{"points": [{"lat": ') == 1


def test_dealt_registry_has_the_same_rows_in_more_tasks(spark):
    dealt = SI.registry(spark, SF, dealt=True)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(str, dealt.collect())) == sorted(map(str, SI.registry(spark, SF).collect()))


def test_first_seen_reads_its_records_once(spark, tmp_path):
    rows = [("a", 3, "x", "[1]"), ("a", 2, None, "[1]"), ("a", None, "n", "[1]"), ("b", None, "n", "[2]"), (None, 1, "n", "[3]"),
            ("c", 5, "y", "[4]"), ("c", 5, "y", "[4]")]
    spark.createDataFrame(rows, "shape_hash string, seq long, name string, shape_json string").write.parquet(str(tmp_path / "r"))
    got = R.first_seen(spark.read.parquet(str(tmp_path / "r")))
    assert sorted(map(tuple, got.collect())) == [("a", 2, None, "[1]"), ("c", 5, "y", "[4]")]
    assert _plan(got).split("Initial Plan")[0].count("Scan parquet") == 1
