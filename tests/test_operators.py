"""History, parsing and registration invariants."""

import json

from pyspark.sql import functions as F

from roadspeed.operators import history as H
from roadspeed.operators import parse as P
from roadspeed.operators import registry as R
from roadspeed.operators import series as S
from roadspeed.plans.ordinal import dense_ordinal
from roadspeed.sources.snapshots import raw_read_schema


def test_latest_keeps_null_and_recent_cut_before_null_filter(spark):
    sr = spark.createDataFrame(
        [(1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (2, 1, 3.0), (2, 2, None)],
        "segment_index long, seq long, Speed double")
    latest = {r.segment_index: r.speed for r in H.latest_speed(sr).collect()}
    assert latest == {1: 7.0, 2: None}
    hist = H.recent_history(sr, 2).collect()
    got = sorted((r.segment_index, r.age, r.speed) for r in hist)
    # segment 2: the newest two are (None, 3.0) -> only 3.0 survives, age 1
    assert got == [(1, 0, 7.0), (2, 1, 3.0)]
    arr = {r.segment_index: r.series for r in H.series_array(H.recent_history(sr, 96)).collect()}
    assert arr == {1: [7.0, 5.0], 2: [3.0]}


def _docs(spark, docs):
    text = spark.createDataFrame([(json.dumps(d),) for d in docs], "v string")
    return text.select(F.from_json("v", raw_read_schema()).alias("d")).select("d.*")


def test_parse_defaults_and_links(spark):
    pts = [{"lat": 10, "lng": 106.7000004}]
    docs = [{"seq": 1, "snapshot_ts": "20240101T000000", "results": [
        {"location": {"description": "A", "shape": {"links": [{"points": pts}]}},
         "currentFlow": {"speed": 8.5, "jamFactor": 3, "freeFlow": None}},
        {"location": {"shape": {"links": []}}, "currentFlow": {"speed": 1.0}},
        {"location": {"shape": {"links": [{"points": []}]}}},
    ]}]
    out = P.parse_snapshot(_docs(spark, docs)).orderBy("pos").collect()
    assert [r.pos for r in out] == [0, 2]          # empty links dropped, pointless kept
    a, c = out
    assert (a.name, a.speed_ms, a.jam_factor, a.free_flow_speed, a.confidence) == ("A", 8.5, 3.0, None, 0.0)
    assert a.shape_json == '[{"lat": 10, "lng": 106.7}]'
    assert (c.name, c.speed_ms, c.shape_json) == ("", 0.0, "[]")
    assert a.seq == 1_000_000 and c.seq == 1_000_002


def test_registration_dense_stable_replay_safe(spark):
    recs = spark.createDataFrame(
        [("h1", 5, "", "[]"), ("h2", 3, "B", "[]"), ("h1", 1, "A", "[]"), ("h3", 9, "C", "[]")],
        "shape_hash string, seq long, name string, shape_json string")
    reg = R.register_segments(recs, R.empty_registry(spark))
    got = {r.shape_hash: (r.segment_index, r.name) for r in reg.collect()}
    assert got == {"h1": (1, "A"), "h2": (2, "B"), "h3": (3, "C")}
    again = R.register_segments(recs, reg)
    assert again.count() == 3
    more = spark.createDataFrame([("h4", 0, "", "[]")], "shape_hash string, seq long, name string, shape_json string")
    reg2 = {r.shape_hash: (r.segment_index, r.name) for r in R.register_segments(more, reg).collect()}
    assert reg2["h4"] == (4, "segment_4") and reg2["h1"] == (1, "A")


def test_dense_ordinal_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"))
    got = dense_ordinal(df, "k", "o", start=10, buckets=16).orderBy("k").select("o").collect()
    assert [r.o for r in got] == list(range(10, 5010))


def test_target_width_and_patches(spark):
    df = spark.createDataFrame([(1,), (325,), (326,), (600,), (1000,)], "n long")
    got = [r.w for r in df.select(S.target_width(F.col("n")).alias("w")).collect()]
    assert got == [325, 325, 512, 1024, 1024]
    s = spark.createDataFrame([(1, [float(i) for i in range(30)])], "segment_index long, series array<double>")
    p = S.patches(s).orderBy("patch").collect()
    assert len(p) == 2 and p[1]["values"][0] == 12.0


def test_hot_segment_matches_brute_force(spark):
    """One segment holds a third of the rows; results equal a plain Python pass."""
    import random
    rnd = random.Random(7)
    rows = []
    for seq in range(6000):
        seg = 0 if seq % 3 == 0 else rnd.randrange(1, 200)
        v = None if rnd.random() < 0.2 else round(rnd.uniform(0, 30), 2)
        rows.append((seg, seq, v))
    sr = spark.createDataFrame(rows, "segment_index long, seq long, Speed double").repartition(8)
    got_latest = {r.segment_index: r.speed for r in H.latest_speed(sr).collect()}
    got_hist = {}
    for r in H.recent_history(sr, 96).collect():
        got_hist.setdefault(r.segment_index, []).append((r.age, r.speed))
    by_seg = {}
    for seg, seq, v in rows:
        by_seg.setdefault(seg, []).append((seq, v))
    for seg, vals in by_seg.items():
        vals.sort(reverse=True)
        assert got_latest[seg] == vals[0][1]
        want = [(age, v) for age, (_, v) in enumerate(vals[:96]) if v is not None]
        assert sorted(got_hist.get(seg, [])) == want


def test_update_recent_is_replay_safe_and_bounded(spark):
    rows = [(s, q, float(q)) for s in (1, 2) for q in range(10)]
    batch = spark.createDataFrame(rows, "segment_index long, seq long, Speed double")
    once = H.update_recent(H.empty_recent(spark), batch, 4)
    twice = H.update_recent(once, batch, 4)
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    assert a == sorted((s, q, float(q)) for s in (1, 2) for q in range(6, 10))


def test_empty_series_give_nulls_not_errors(spark):
    from roadspeed.operators import forecast as FC
    df = spark.createDataFrame([(1, []), (2, [3.0, 5.0])], "segment_index long, series array<double>")
    norm = {r.segment_index: (r.mean, r.stdev) for r in S.instance_norm(df).collect()}
    assert norm[1] == (None, None) and norm[2][0] == 4.0
    tr = {r.segment_index: r.f for r in df.select("segment_index", FC.trend(F.col("series"), 2).alias("f")).collect()}
    assert tr[2] == [1.0, -1.0]          # line 3 + 2p, steps at p = -1, -2
