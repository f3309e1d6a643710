import hashlib
from collections import defaultdict

import pytest

from roadspeed.llm import exact_dedup as X


def brute(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é" * 70000), (6, "é" * 70000), (7, "a "), (8, "A"), (9, "a")]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_matches_brute_force(docs, keep):
    rows = ROWS + [(100 + i, f"t{i % 7}") for i in range(60)] + [(1000 + i, "hot") for i in range(200)]
    got = X.exact_dedup(docs(rows, 5), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert result(got) == brute(rows, max if keep == "max" else min)


def test_null_and_repeated_identifiers(docs):
    rows = [(None, "x"), (None, "x"), (5, "x"), (None, "only"), (7, "r"), (7, "r")]
    assert result(X.exact_dedup(docs(rows))) == brute(rows)


def test_empty_table_and_clashing_columns(docs, spark):
    assert X.exact_dedup(docs([])).collect() == []
    rows = docs(ROWS).selectExpr("doc_id", "text", "1 as digest", "2 as n", "3 as slot", "'k' as keep_id", "4 as kept")
    assert result(X.exact_dedup(rows)) == brute(ROWS)
    kept = X.drop_copies(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(ROWS) if r[3])


@pytest.mark.parametrize("slots", [1, 5, 16, 17, 50, 211, 5000])
def test_cube_covers_the_slots(slots):
    fan, rounds = X.cube(slots)
    assert fan ** rounds >= slots and fan <= 16 and rounds >= 2


def test_one_record_per_text_whatever_the_cube(docs):
    rows = [(i, f"t{i % 11}") for i in range(99)]
    for slots in (4, 9, 30):
        got = X.text_groups(docs(rows, 6), slots=slots).collect()
        assert len(got) == 11 and all(r.n == 9 and r.hi - r.lo == 88 for r in got)


def test_stage_decides_each_row(docs):
    def kept(rows, **how):
        return sorted(((r.doc_id or 0, r.text) for r in X.drop_copies(docs(rows), **how).collect()))
    assert kept([(7, "A"), (9, "A"), (7, "B")]) == [(7, "B"), (9, "A")]
    assert kept([(7, "A"), (7, "A")]) == [(7, "A")] and kept([(None, "A"), (None, "A"), (None, "B")]) == [(0, "A"), (0, "B")]
    assert kept([(7, "A"), (None, "A"), (7, "A"), (8, None), (9, "")], keep="min") == [(7, "A"), (8, None)]


def test_partitions_of_many_batches(docs, spark):
    rows = ROWS + [(100 + i, f"t{i % 37}") for i in range(150)] + [(1000 + i, "hot") for i in range(40)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10)
    try:
        assert result(X.exact_dedup(docs(rows, 2))) == brute(rows)
        assert sorted(r.doc_id for r in X.drop_copies(docs(rows, 2)).collect()) == sorted(r[0] for r in brute(rows) if r[3])
    finally:
        spark.conf.set(name, before)
