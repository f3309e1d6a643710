"""Gram index of names against the scanning search."""

import pytest

from roadspeed.operators.name_index import search_index, write_index
from roadspeed.operators.serving import search_segments

ROWS = [(1, "Lê Lợi"), (2, "Nguyễn Huệ 12"), (12, None), (121, ""), (4, "aaaaaa"), (5, "A%_\\ road"), (6, "abcab"), (7, "😀 Road 121"), (9, "x" * 3000)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    names = spark.createDataFrame(ROWS, "segment_index long, name string")
    path = str(tmp_path_factory.mktemp("index") / "grams")
    write_index(names, path, files=4)
    return names, path


@pytest.mark.parametrize("q", [None, "", "  ", "1", "12", "121", "LÊ LỢI", "nguyễn h", "aaa", "aaaa", "aaaaaaa", "%_\\", "abcabc", "bcab",
                               "😀 r", "road 121", "road", "zzzz", "x" * 3000, "x" * 3001])
def test_equals_scan(spark, index, q):
    names, path = index
    got = sorted(tuple(r) for r in search_index(spark, path, q).collect())
    assert got == sorted(tuple(r) for r in search_segments(names, q).collect())


def test_reads_postings_of_its_grams(spark, index):
    plan = search_index(spark, index[1], "road 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_empty_table(spark, tmp_path):
    write_index(spark.createDataFrame([], "segment_index long, name string"), str(tmp_path / "none"))
    assert search_index(spark, str(tmp_path / "none"), "").collect() == []
