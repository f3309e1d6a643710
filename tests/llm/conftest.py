"""Fixtures of the corpus operator tests."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """A documents frame from (doc_id, text) or (doc_id, text, lang) rows, over a few partitions."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts, F.rand(7))
    return make
