import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadspeed.llm import quality as Q
from roadspeed.llm.frames import scan_only


def classes(text):
    """A text's symbols after those before its start."""
    return [0] * (Q.ORDER - 1) + [0xFFFF if not ord(c) else ord(c) if ord(c) <= 0xFFFF else 0xE000 + ord(c) % 6400 for c in text]


def number(w):
    x = sum(s << 16 * k for k, s in enumerate(reversed(w)))
    return x - (1 << 64) if x >> 63 else x


def gram(code):
    return tuple((code % (1 << 64)) >> 16 * k & 0xFFFF for k in range(Q.ORDER - 1, -1, -1))


def model(texts):
    """The textbook recursion over tuples of classes."""
    top = Counter(tuple(c[i:i + Q.ORDER]) for t in texts for c in [classes(t)] for i in range(len(c) - Q.ORDER + 1))
    grams = {Q.ORDER: top}
    for k in range(Q.ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {k: Q.discounts(Counter(g.values())) for k, g in grams.items()}
    followers = {k: defaultdict(list) for k in grams}
    for k, g in grams.items():
        for w, c in g.items():
            followers[k][w[:-1]].append(c)

    def take(k, c):
        return d[k][min(c, 3) - 1]

    def p(w):
        k = len(w)
        if not k:
            return 1 / Q.SIZE
        own = followers[k].get(w[:-1])
        if not own:
            return p(w[1:])
        c = grams[k].get(w, 0)
        return (max(c - take(k, c), 0) * (c > 0) + sum(take(k, x) for x in own) * p(w[1:])) / sum(own)
    return p


def made(seed, n=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(["the ", "Cat", "ré", "s. ", "12", "\n", "世", "a", "😀", "\0"]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def trained(spark):
    texts = made(1)
    counts = Q.ngram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    return texts, counts.cache()


def test_log_probabilities_match_the_recursion(spark, trained):
    texts, counts = trained
    p = model(texts)
    met = {r.code for r in counts.collect()}
    some = sorted({s for c in met for s in gram(c)})
    rng = random.Random(3)
    asked = met | {number([rng.choice(some) for _ in range(Q.ORDER)]) for _ in range(200)} | {number([7, 8, 9, 10])}
    got = {r.code: r.logp for r in Q.log_probabilities(counts, spark.createDataFrame([(c,) for c in asked], "code long")).collect()}
    assert set(got) == asked
    for c in asked:
        assert got[c] == pytest.approx(math.log(p(gram(c))), abs=1e-9), gram(c)


def test_probabilities_sum_to_one(spark, trained):
    _, counts = trained
    some = spark.createDataFrame([(r.code,) for r in counts.limit(3).collect()] + [(number([5, 6, 7, 8]),)], "code long")
    asked = some.select(F.explode(F.sequence(F.lit(0), F.lit(Q.SIZE - 1))).alias("s"), "code").select(
        F.col("code").bitwiseAND(F.lit(-Q.SIZE)).bitwiseOR(F.col("s").cast("long")).alias("code")).distinct()
    sums = Q.log_probabilities(counts, asked).groupBy(F.shiftrightunsigned("code", 16)).agg(F.sum(F.exp("logp")).alias("p")).collect()
    assert len(sums) >= 3 and all(r.p == pytest.approx(1, abs=1e-9) for r in sums)


def test_codes_do_not_cross_texts_and_are_the_same_in_any_chunks():
    texts = ["ab", "", "é", "xyz w\0", "😀b"]
    syms, offsets = Q.symbols(texts)
    want = [number(c[i:i + Q.ORDER]) for t in texts for c in [classes(t)] for i in range(len(c) - Q.ORDER + 1)]
    for step in (1, 2, 3, 100):
        assert [x for a in range(0, len(syms), step) for x in Q.codes(syms, offsets, a, min(a + step, len(syms))).tolist()] == want
    p = {c: -float(k + 1) for k, c in enumerate(sorted(set(want)))}
    known = np.array(sorted(p))
    logp = np.array([p[c] for c in known.tolist()], np.float32)
    own = [sum(p[number(c[i:i + Q.ORDER])] for i in range(len(c) - Q.ORDER + 1)) for t in texts for c in [classes(t)]]
    assert Q._sums(syms, offsets, known, logp).tolist() == own
    with pytest.raises(RuntimeError):
        Q._sums(syms, offsets, known[1:], logp[1:])


def test_pieces_do_not_depend_on_the_batches(monkeypatch):
    monkeypatch.setattr(Q, "PIECE", 10)
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 14) for _ in range(60)]
    def cut(sizes):
        rows = pa.table({"i": list(range(60)), "t": texts}).combine_chunks().to_batches()[0]
        parts, a = [], 0
        while a < 60:
            n = next(sizes)
            parts.append(rows.slice(a, n))
            a += n
        return [(k, b.column(0).to_pylist()) for k, b in Q.pieces(parts, 1)]
    whole = cut(iter([60]))
    assert sum((ids for _, ids in whole), []) == list(range(60)) and len(whole) > 10
    for _ in range(20):
        assert cut(iter(lambda: rng.randint(1, 9), None)) == whole


def corpus(seed, n=200):
    rng = random.Random(seed)
    good, bad = ["the ", "cat ", "sat ", "on ", "mat. "], "#%&$|*@"
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        text = "".join(rng.choice(bad if junk else good) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, ["en", "fr", None][i % 3]))
        if i % 2:
            labels.append((i, int(not junk), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus(1)
    df = docs(rows).selectExpr("*", "1 as threshold", "'x' as key")
    labelled = spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in Q.quality_scores(df, labelled).collect()}
    held = [i for i in range(len(rows)) if i % 2 == 0]
    assert sum(out[i].accepted == bool(i % 5) for i in held) >= 0.95 * len(held)
    texts = [t for i, t, _ in rows if i % 2 and i % 5]
    p = model(texts)
    for i, text, _ in rows[:12]:
        c = classes(text)
        total = sum(math.log(p(tuple(c[k:k + Q.ORDER]))) for k in range(len(c) - Q.ORDER + 1))
        assert out[i].n_symbols == len(text)
        raw = Q.quality_scores(df, labelled, prior=0).where(f"doc_id = {i}").first().perplexity if i == 1 else None
        assert raw is None or raw == pytest.approx(math.exp(-total / len(text)), rel=1e-5)
    kept = Q.keep_accepted(df, labelled)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.accepted}


def test_small_blocks_and_chunks_give_the_same(spark, docs, monkeypatch):
    rows, labels = corpus(3, 80)
    labelled = spark.createDataFrame(labels, LABELS)
    def run():
        return {(r.doc_id, r.accepted): r.perplexity for r in Q.quality_scores(docs(rows, 2), labelled).collect()}
    want = run()
    assert all(x is not None for x in want.values())
    p = model([t for i, t, _ in rows if i % 2 and i % 5])
    monkeypatch.setattr(Q, "PIECE", 500)
    monkeypatch.setattr(Q, "PIECES", 2)
    monkeypatch.setattr(Q, "CHUNK", 70)
    got = Q.document_scores(docs(rows, 2).selectExpr("doc_id", "lang", "cast(null as binary) digest", f"{Q.FOLDS} model", "text"),
                            Q.ngram_counts(spark.createDataFrame([(t,) for i, t, _ in rows if i % 2 and i % 5], "text string"))
                            .withColumn("model", F.lit(Q.FOLDS)))
    for r in got.collect():
        c = classes(rows[r.doc_id][1])
        assert r.total == pytest.approx(sum(math.log(p(tuple(c[k:k + Q.ORDER]))) for k in range(len(c) - Q.ORDER + 1)), rel=1e-5)
    assert len(want) == 80


def test_only_scans_of_files_are_read_twice(spark, docs, tmp_path):
    docs([(1, "a"), (2, "b")]).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert scan_only(df.where("doc_id > 0").selectExpr("doc_id", "upper(text) t"))
    assert not scan_only(df.repartition(2)) and not scan_only(docs([(1, "a")])) and not scan_only(df.join(df.select("doc_id"), "doc_id"))


def test_stage_decides_each_row(spark, docs):
    rows, labels = corpus(1)
    bad, good = next(r for r in rows if r[0] % 10 == 0), next(r for r in rows if r[0] % 10 == 2)
    extra = [(7000, bad[1]), (7000, good[1]), (7001, good[1]), (7001, good[1]), (None, good[1]), (None, bad[1])]
    df = docs([*rows, *extra]).withColumn("_gone", F.lit(1)).withColumn("digest", F.lit(2))
    kept = Q.keep_accepted(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id >= 7000) == sorted(
        [(0, good[1]), (7000, good[1]), (7001, good[1]), (7001, good[1])])


def test_edges(spark, docs):
    rows, labels = corpus(2, 60)
    edge = rows + [(900, None), (901, ""), (902, "the cat " * 60000), (None, "the cat sat on "), (7, rows[7][1]), (903, "the cat sat ", "xx")]
    out = Q.quality_scores(docs(edge), spark.createDataFrame(labels + labels[:3] + [(None, 1, 0), (902, None, None)], LABELS)).collect()
    assert len(out) == len(edge)
    by = {r.doc_id: r for r in out}
    assert not by[900].accepted and by[901].perplexity is None and by[902].accepted and by[903].threshold is not None
    assert Q.quality_scores(docs([]), spark.createDataFrame([], LABELS)).collect() == []
    none = Q.quality_scores(docs(rows[:4]), spark.createDataFrame([], LABELS)).collect()
    assert all(r.accepted for r in none)


def test_discounts():
    assert Q.discounts({}) == (0.5, 1.0, 1.5)
    d = Q.discounts({1: 100, 2: 40, 3: 20, 4: 12})
    assert all(0 < x <= k for k, x in zip((1, 2, 3), d)) and d[0] < d[1] < d[2]


@pytest.mark.parametrize("few", [3, 20])
def test_held_out_documents_of_every_language(spark, docs, few):
    # Varied words in several languages; clean documents without a label must pass whatever the language's share.
    rng = random.Random(9)
    rows, labels = [], []
    for lang, letters, n in (("en", "etaoinshr", 300), ("es", "ñáéíóúlmq", few)):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)]
        for k in range(n + 100):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(rng.randint(30, 80))), lang))
            if k < n:
                labels.append((len(rows) - 1, 1, 0))
    rows += [(len(rows) + i, "".join(rng.choice("#%&$|*@") for _ in range(300)), lang) for i, lang in enumerate(["en", "es"] * 20)]
    held = {r[0] for r in rows} - {r[0] for r in labels}
    got = Counter((r.lang, r.doc_id < len(rows) - 40) for r in Q.quality_scores(docs(rows), spark.createDataFrame(labels, LABELS)).collect()
                  if r.doc_id in held and r.accepted)
    assert got["en", True] >= 90 and got["es", True] >= 90
    assert not got["en", False] and not got["es", False]


def test_every_trusted_document_trains(spark, docs):
    rows = [(i, f"text {i}", "en" if i % 3 else None) for i in range(25_000)]
    dealt = Q.deal(docs([(i, "x", lang) for i, _, lang in rows]).select("doc_id", "lang")).collect()
    assert sorted(r.doc_id for r in dealt) == list(range(25_000))
    order = [r.id for r in spark.range(25_000).orderBy(F.xxhash64("id"), "id").collect()]
    place = {i: k for some in (True, False) for k, i in enumerate(j for j in order if (j % 3 > 0) == some)}
    assert all(r.fold == place[r.doc_id] % Q.FOLDS for r in dealt)
    sizes = Counter((r.doc_id % 3 > 0, r.fold) for r in dealt)
    for some in (True, False):
        own = [sizes[some, k] for k in range(Q.FOLDS)]
        assert max(own) - min(own) <= 1


def test_texts_are_not_shuffled_and_held_out_scores_lack_the_own_fold(spark, docs, tmp_path, monkeypatch):
    rows, labels = corpus(4, 60)
    docs(rows, 3).write.parquet(str(tmp_path / "d"))
    df, labelled = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(labels, LABELS)
    monkeypatch.setattr(Q, "PIECE", 500)
    seen = []
    plain = Q.scored
    monkeypatch.setattr(Q, "scored", lambda *a: seen.append(plain(*a)) or seen[-1])
    assert len(Q.quality_scores(df, labelled).collect()) == 60
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    good = {i for i, quality, _ in labels if quality}
    fold = {r.doc_id: r.fold for r in Q.deal(df.where(F.col("doc_id").isin(good)).select("doc_id", "lang")).collect()}
    got = {r.doc_id: r.held for r in seen[0].collect()}
    assert {i for i, held in got.items() if held is not None} == good
    for k in range(Q.FOLDS):
        p = model([t for i, t, _ in rows if i in good and fold[i] != k])
        for i in [i for i in sorted(good) if fold[i] == k][:2]:
            c = classes(rows[i][1])
            assert got[i] == pytest.approx(sum(math.log(p(tuple(c[j:j + Q.ORDER]))) for j in range(len(c) - Q.ORDER + 1)), rel=1e-5)


def test_a_training_document_outside_its_part_raises(spark, docs, tmp_path):
    rows = Q.blocks(docs([(1, "a"), (2, "b")]).selectExpr("doc_id", "lang", "cast(null as binary) digest", "5 model", "text"))
    folds = Q.by_part(rows.selectExpr("doc_id + 10 as doc_id", "part", "0 as fold"), "folds")
    with pytest.raises(Exception, match="was not met in its part"):
        Q.fold_counts(rows, folds).collect()
