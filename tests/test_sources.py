"""Landing layouts and sinks on small inputs."""

import json

from pyspark.sql import functions as F

from roadspeed.operators import parse as P
from roadspeed.session import scratch_path
from roadspeed.sources import snapshots as SS
from roadspeed.sources import tables as TB


def _doc(speed):
    return json.dumps({"results": [{"location": {"description": "R", "shape": {"links": [
        {"points": [{"lat": 10.1, "lng": 106.2}]}]}}, "currentFlow": {"speed": speed}}]})


def test_raw_by_snapshot_folder_and_file_name(spark, tmp_path):
    docs = spark.createDataFrame([("20240101T000000", _doc(1.0)), ("20240101T000500", _doc(2.0))],
                                 "snapshot_ts string, value string")
    path = scratch_path(spark, "raw-test")
    SS.write_raw(docs, path)
    got = P.parse_snapshot(SS.read_snapshots(spark, path)).select("snapshot_ts", "speed_ms", "seq").collect()
    by_ts = {r.snapshot_ts: (r.speed_ms, r.seq) for r in got}
    assert by_ts["20240101T000000"] == (1.0, 1704067200 * 1_000_000)
    assert by_ts["20240101T000500"][0] == 2.0
    # a provider response landed as one pretty-printed file named by its run
    f = tmp_path / "20240101T001000.json"
    f.write_text(json.dumps(json.loads(_doc(3.0)), indent=2))
    one = SS.read_snapshots(spark, str(f), multi_line=True)
    row = P.parse_snapshot(one).select("snapshot_ts", "speed_ms").first()
    assert (row.snapshot_ts, row.speed_ms) == ("20240101T001000", 3.0)


def test_speed_record_append_is_replay_safe(spark):
    sr = spark.createDataFrame(
        [(1, 10, 5.0, 18.0, 0.0, 10.0, 0.9, "2024-01-01 00:00:00")],
        "segment_index long, seq long, Speed double, SpeedKmh double, JamFactor double, "
        "FreeFlow double, Confidence double, IngestedAt string"
    ).withColumn("IngestedAt", F.col("IngestedAt").cast("timestamp_ntz"))
    path = scratch_path(spark, "sr-test")
    TB.append_speed_records(sr, path)
    TB.append_speed_records(sr, path)
    assert TB.speed_records(spark, path).count() == 1


def _batch(spark, docs):
    text = spark.createDataFrame([(json.dumps(d),) for d in docs], "v string")
    return text.select(F.from_json("v", SS.raw_read_schema()).alias("d")).select("d.*")


def _result(lat, speed):
    return {"location": {"description": "A", "shape": {"links": [{"points": [{"lat": lat, "lng": 106.2}]}]}},
            "currentFlow": {"speed": speed}}


def test_documents_of_one_snapshot_in_two_batches_are_all_kept(spark):
    from roadspeed.operators import history as H
    from roadspeed.plans.etl import run_batch
    reg, tr, rec, st, pr = (scratch_path(spark, n) for n in ("reg", "tr", "rec", "st", "pr"))
    one = [{"results": [_result(10.1, 5.0), _result(10.2, 6.0)], "snapshot_ts": "20240101T000000"}]
    two = [{"results": [_result(10.3, 7.0)], "snapshot_ts": "20240101T000000"}]
    runs = [(one, "2024-01-01 23:59:58"), (two, "2024-01-01 23:59:59"), (two, "2024-01-02 00:00:01"), (one, "2024-01-02 00:00:02")]
    got = [run_batch(_batch(spark, d), reg, tr, rec, ingested_at=at, state_path=st, predictions_path=pr) for d, at in runs]
    assert [c["inserted"] for c in got] == [2, 1, 0, 0] and [c["extracted"] for c in got] == [2, 1, 1, 2]
    assert [c["forecasted"] for c in got] == [2, 3, 0, 0]
    assert sorted(r.Speed for r in TB.speed_records(spark, rec).collect()) == [5.0, 6.0, 7.0]
    assert sorted(r.speed_ms for r in TB.read_transformed(spark, tr).collect()) == [5.0, 6.0, 7.0]
    newest = H.latest_prediction(TB.predictions(spark, pr)).collect()
    assert len(newest) == 3 and {r.seq for r in newest} == {3}


def test_malformed_documents_fail_or_are_set_apart(spark, tmp_path):
    import pytest
    (tmp_path / "a.json").write_text(_doc(1.0) + "\n" + _doc(2.0)[:-4] + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        SS.read_snapshots(spark, str(tmp_path)).collect()
    good, bad = SS.read_with_quarantine(spark, str(tmp_path))
    assert good.count() == 1 and [r.value for r in bad.collect()] == [_doc(2.0)[:-4]]
    with pytest.raises(Exception):
        TB.registry(spark, str(tmp_path / "nowhere"))
    assert TB.registry(spark, str(tmp_path / "nowhere"), create=True).count() == 0


def test_wide_export_and_scorer_shape_are_checked(spark):
    import numpy as np
    import pytest
    from roadspeed.operators import series as S
    from roadspeed.operators.forecast import _network_scorer
    m = spark.range(400).selectExpr("0L as network", "id as variate", "0 as pos", "1.0D as value")
    assert len(S.series_matrix_wide(m).columns) == 402
    with pytest.raises(ValueError):
        S.series_matrix_wide(m, 325)
    import pandas as pd
    pdf = pd.DataFrame({"variate": [0], "segment_index": [1], "denoised": [np.zeros(4)]})
    with pytest.raises(ValueError):
        _network_scorer(lambda a: np.zeros((3, 325)), 12, 325)(pdf)


def test_notices(spark):
    from roadspeed.operators import serving as SV
    req = spark.createDataFrame([(1, "update"), (2, "Update"), (3, None), (4, "")], "request_id long, notice string")
    got = {r.request_id: (r.status, r.forecasted) for r in SV.answer_notices(req, spark.range(7)).collect()}
    assert got == {1: (200, 7), 2: (400, None), 3: (400, None), 4: (400, None)}


def test_run_batch_replay_adds_nothing(spark):
    from roadspeed.plans.etl import run_batch
    docs = [{"results": [
        {"location": {"description": "A", "shape": {"links": [{"points": [{"lat": 10.1, "lng": 106.2}]}]}},
         "currentFlow": {"speed": 5.0}},
        {"location": {"description": "", "shape": {"links": [{"points": [{"lat": 10.3, "lng": 106.4}]}]}},
         "currentFlow": {"speed": 6.0}}], "seq": 7, "snapshot_ts": "20240101T000000"}]
    text = spark.createDataFrame([(json.dumps(d),) for d in docs], "v string")
    batch = text.select(F.from_json("v", SS.raw_read_schema()).alias("d")).select("d.*")
    reg, tr, rec = (scratch_path(spark, n) for n in ("reg", "tr", "rec"))
    for _ in range(2):
        run_batch(batch, reg, tr, rec, ingested_at="2024-01-01 00:00:00")
    registry = TB.registry(spark, reg)
    assert sorted((r.segment_index, r.name) for r in registry.collect()) == [(1, "A"), (2, "segment_2")]
    records = TB.speed_records(spark, rec)
    assert sorted((r.segment_index, r.Speed) for r in records.collect()) == [(1, 5.0), (2, 6.0)]
    assert TB.read_transformed(spark, tr).count() == 2


def test_documents_of_one_snapshot_share_seq_and_stay_apart_in_the_state(spark):
    from roadspeed.operators import history as H
    from roadspeed.plans.etl import run_batch
    from roadspeed.streaming.ingest import RECENT_SCHEMA
    reg, tr, rec, st, pr = (scratch_path(spark, n) for n in ("reg", "tr", "rec", "st", "pr"))
    docs = [[{"results": [_result(10.1, v)], "snapshot_ts": "20240101T000000"}] for v in (5.0, 9.0, 6.0)]
    for d in docs + docs[:2]:
        run_batch(_batch(spark, d), reg, tr, rec, ingested_at="2024-01-01 00:00:00", state_path=st, predictions_path=pr)
    store, state = TB.speed_records(spark, rec), TB.read_state(spark, st, RECENT_SCHEMA)
    assert store.select("seq").distinct().count() == 1 and store.count() == state.count() == 3
    for n in (96, 2):
        want = sorted(H.recent_history(store, n).collect())
        assert len(want) == min(n, 3) and sorted(H.recent_history(H.update_recent(state, store, n), n).collect()) == want


def test_texts_are_built_in_tasks_by_the_size_of_the_files(spark, monkeypatch, tmp_path):
    from roadspeed.plans import standins
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(standins, "SHARE", 500)
    assert standins.spread(rows).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in standins.spread(rows, "id").collect()) == list(range(1000))


def test_transformed_rows_move_once(spark, monkeypatch, tmp_path):
    """One shuffle ranges and dedups the rows; what is stored is what it was, hashes of any form included."""
    rows = spark.createDataFrame(
        [(1, h, "n", 1.0, 1.0, 1.0, 1.0, 3.6, k, ts, str(k), 0) for k, (h, ts) in enumerate(
            [("ab" * 32, "20240101T000000"), ("AB" * 32, "20240101T000000"), ("x", None), (None, "20240102T000000"), ("0", "")])],
        "segment_index long, shape_hash string, name string, speed_ms double, jam_factor double, free_flow_speed double, "
        "confidence double, speed_kmh double, seq long, snapshot_ts string, doc_key string, pos long").selectExpr(
        "*", "timestamp_ntz '2024-01-01 00:00:00' as ingested_at")
    real, plans = TB.C.append, []

    def append(df, path, by, keys, span, arrange, checked):
        plans.append(arrange(df)._jdf.queryExecution().executedPlan().toString())
        return real(df, path, by, keys, span, arrange, checked)
    monkeypatch.setattr(TB.C, "append", append)
    path = f"{tmp_path}/transformed"
    assert TB.write_transformed(rows.unionByName(rows), path) == 5
    assert plans[0].count("Exchange ") == 1
    back = TB.read_transformed(spark, path)
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_a_run_removes_what_it_keeps_for_itself(spark, tmp_path):
    import os

    from roadspeed.plans.etl import run_batch
    from roadspeed.session import FREES_SHUFFLES, ensure_checkpoint_dir
    place = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, setting = set(os.listdir(place)), spark.conf.get(FREES_SHUFFLES, None)
    reg, tr, rec, st, pr = (f"{tmp_path}/{n}" for n in ("reg", "tr", "rec", "st", "pr"))
    doc = {"results": [_result(10.1, 5.0)], "snapshot_ts": "20240101T000000"}
    for _ in range(2):
        got = run_batch(_batch(spark, [doc]), reg, tr, rec, ingested_at="2024-01-01 00:00:00", state_path=st, predictions_path=pr)
    assert (got["extracted"], got["inserted"]) == (1, 0)
    left = {n for n in set(os.listdir(place)) - before if not n.startswith("rdd-")}
    assert left == set() and spark.conf.get(FREES_SHUFFLES, None) == setting
