"""Every stage against a brute-force version on its own input, and run() against the chain."""

import random

import pytest
from .test_decontaminate import brute as leaks
from .test_exact_dedup import brute as copies
from .test_jaccard_join import brute as near

import corpus_pipeline
from roadspeed.llm import pieces, quality
from roadspeed.llm.frames import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(i, " ".join(f"b{rng.randint(0, 50)}" for _ in range(25))) for i in range(5)]
    rows = []
    for i in range(160):
        w = [rng.choice(["the", "cat", "sat", "on", "mat"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(60, 90))]
        if i % 10 == 0:
            w = [rng.choice("#%&$|*@") * 3 for _ in w]
        if i % 17 == 0:
            w[5:5] = items[i % 5][1].split()[:14]
        rows.append((i, " ".join(w), "en", "s", 0))
        if i % 11 == 0:
            rows.append((1000 + i, rows[-1][1], "en", "s", 0))
        if i % 13 == 0:
            w[3] = "cat7" if w[3] != "cat7" else "mat1"
            rows.append((2000 + i, " ".join(w), "en", "s", 0))
    rows += [(5000, None, None, None, None), (5001, "", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, 160, 3)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return folder


def test_stages_and_run(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    wanted = {
        "quality classifier": lambda rows: {r.doc_id for r in quality.quality_scores(
            docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.accepted},
        "exact dedup": lambda rows: {r[0] for r in copies(rows) if r[3]},
        "n-gram Jaccard join": lambda rows: {r[0] for r in near(rows) if r[0] == r[1]},
        "benchmark decontamination": lambda rows: {r[0] for r in leaks(rows, bench) if not r[5]},
    }
    model = pieces.Pieces(tokenizer("piece_bpe_32k.model"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name in wanted:
            assert out.columns == docs.columns
            keep = wanted[name](rows)
            assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(x for x in rows if x[0] in keep)
            assert 0 < len(keep) < len(rows)
        else:
            assert {r.doc_id: r.scores for r in out.collect()} == {i: [s for s, _ in model.encode(t or "")] for i, t in rows}
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
