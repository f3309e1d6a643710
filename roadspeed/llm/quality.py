"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model predicts a text's characters from the three before. It is trained on trusted
text: all documents labelled good and not toxic.

Counts live in tables sharded by n-gram. Documents are taken in blocks; each block asks
for the n-grams that it holds, once each, and their distinct set is joined with the
counts, context sums and continuation counts of all orders, order by order, which gives
one log-probability per n-gram and model. The answers are joined with what was asked and
dealt to the parts of the documents that asked, where a document's perplexity is a sum
over its n-grams. What is asked and answered grows with the documents; nothing but
numbers of counts passes through the driver. A document is rejected if its perplexity is
beyond a quantile of all trusted documents' perplexities in its language.

Texts are never shuffled or copied if they come from files: folds and answers are written
to the shared folder by part, that is by task of the scan, and a task reads its own.

Those perplexities are held out: the trusted documents are dealt into folds, language
by language, and a document of one fold is scored by a model of the others. With
too few trusted documents to tell the quantile, a language takes the spread about
the mean of all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadspeed.llm.frames import digest_of, place, release, same, scan_only, session, text_of
from roadspeed.session import kept, scratch_path

ORDER = 4
QUANTILE = 0.998
#: Parts of the training documents, each scored by a model of the other parts.
FOLDS = 5
#: Symbols that are added to each text at the language's mean, so that short texts are not judged by a few symbols.
PRIOR = 200
#: A symbol has so many bits, an n-gram of four 64; symbol 0 is the place before a text's first character.
BITS = 16
SIZE = 1 << BITS
#: Bytes of texts that are held at once (a longer text is alone), such pieces of the documents that ask together,
#: and n-grams that are looked at at once.
PIECE, PIECES, CHUNK = 2 << 20, 8, 1 << 20
#: Languages up to which their thresholds are broadcast.
FEW_LANGUAGES = 10_000

U64 = np.uint64


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of texts, one symbol for each character.

    Characters beyond the basic plane share the symbols of the private use area, and
    the character 0 has the last one.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    points = np.where(points > 0xFFFF, 0xE000 + points % 6400, points)
    points[points == 0] = 0xFFFF
    return points.astype(np.uint16), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def codes(syms: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """The n-grams that end at places a to b-1, as signed 64-bit numbers; symbol 0 before a text's start."""
    low = max(0, a - ORDER + 1)
    part = syms[low:b].astype(U64)
    first = offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, b)] - low
    out, before = part.copy(), part
    for k in range(1, ORDER):
        before = np.concatenate((np.zeros(1, U64), before[:-1]))[:len(part)]
        before[first] = 0
        out |= before << U64(BITS * k)
    return out[a - low:].view(np.int64)


def distinct_codes(syms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.int64)] + [np.unique(codes(syms, offsets, a, min(a + CHUNK, len(syms))))
                                                               for a in range(0, len(syms), CHUNK)]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: n-gram counts by fold; an n-gram comes once for each chunk that holds it."""
    release()
    for batch in batches:
        folds = batch.column(1).to_numpy(zero_copy_only=False)
        for fold in np.unique(folds).tolist():
            for _, part in pieces([batch.filter(pa.array(folds == fold))], 0):
                syms, offsets = symbols(part.column(0).to_pylist())
                for a in range(0, len(syms), CHUNK):
                    u, n = np.unique(codes(syms, offsets, a, min(a + CHUNK, len(syms))), return_counts=True)
                    for k in range(0, len(u), 1 << 16):
                        some = u[k:k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), fold, np.int32)), pa.array(some),
                                                          pa.array(n[k:k + (1 << 16)])], ["fold", "code", "c"])


def pieces(batches: Iterator[pa.RecordBatch] | list[pa.RecordBatch], text: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of runs of rows whose texts have PIECE bytes or little more, whatever the batches they come in."""
    held, size, number = [], 0, 0
    for batch in batches:
        ends = _ends(batch.column(text))
        a = 0
        while a < batch.num_rows:
            base = int(ends[a - 1]) if a else 0
            b = int(np.searchsorted(ends, base + PIECE - size)) + 1  # the row that fills the piece is its last
            if b > batch.num_rows:
                held.append(batch.slice(a))
                size += int(ends[-1]) - base
                break
            held.append(batch.slice(a, b - a))
            yield number, _joined(held)
            held, size, number, a = [], 0, number + 1, b
    if held:
        yield number, _joined(held)


def _ends(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return offsets[1:] - offsets[0]


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(code, c) over all rows of a one-column text frame."""
    session(texts)
    return (texts.select(F.coalesce(texts.columns[0], F.lit("")).alias("text"), F.lit(0).alias("fold")).mapInArrow(_counts, "fold int, code long, c long")
            .groupBy("code").agg(F.sum("c").alias("c")))


def fold_counts(rows: DataFrame, folds: str) -> DataFrame:
    """(code, f0, f1, ...): counts by fold over the documents of ``blocks`` that ``folds`` names, by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trained() -> Iterator[pa.RecordBatch]:
            for batch in _with_folds(batches, folds):
                some = batch.filter(pa.array(batch.column("fold").to_numpy() >= 0))
                if some.num_rows:
                    yield some.select(["text", "fold"])
        yield from _counts(trained())
    return (rows.select("doc_id", "text", "part").mapInArrow(run, "fold int, code long, c long").groupBy("code").agg(*[
        F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)).alias(f"f{k}") for k in range(FOLDS)]))


def discounts(freq: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more from the numbers of n-grams with counts 1 to 4.

    Where a number is 0, as in tiny training sets, the discount is half the count it is taken from.
    """
    n = [freq.get(k, 0) for k in range(1, 5)]
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), raw))  # type: ignore[return-value]


def _discount(c: Column, d: tuple[Column, Column, Column]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _last(code: Column, k: int) -> Column:
    """The last k symbols of an n-gram."""
    return code if k == ORDER else code.bitwiseAND(F.lit((1 << BITS * k) - 1))


def _context(code: Column) -> Column:
    """An n-gram without its last symbol."""
    return F.shiftrightunsigned(code, BITS)


def log_probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(code, logp) for every asked n-gram: log of the probability of its last symbol after the others."""
    return model_log_probabilities(counts.select("code", F.col("c").alias("c0")), asked, 1).withColumnRenamed("l0", "logp")


def by_model(counts: DataFrame, models: int) -> DataFrame:
    """(code, c0, c1, ...) of (model, code, c)."""
    return counts.groupBy("code").agg(*[F.sum(F.when(F.col("model") == m, F.col("c")).otherwise(0)).alias(f"c{m}") for m in range(models)])


def model_log_probabilities(counts: DataFrame, asked: DataFrame, models: int) -> DataFrame:
    """(code, l0, l1, ...) for every asked n-gram, under each of several models with the counts (code, c0, c1, ...), 0 where it is not met.

    An order's probabilities are made of the next lower order's, for the n-grams that
    end what is asked; so few rows go through the joins of the lower orders.
    """
    cs = [f"c{m}" for m in range(models)]
    grams = {ORDER: counts.select(F.col("code").alias("g"), *cs)}
    wanted = {ORDER: asked.select(F.col("code").alias("g"))}
    for k in range(ORDER - 1, 0, -1):
        shorter = _last(F.col("g"), k).alias("g")
        # In how many n-grams of the next order it ends: the continuation count.
        grams[k] = kept(grams[k + 1].groupBy(shorter).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in cs]), "grams")
        wanted[k] = kept(wanted[k + 1].select(shorter).distinct(), "wanted")
    tally = reduce(DataFrame.unionAll, [t.agg(*[F.count_if(F.col(c) == n).alias(f"{c}_{n}") for c in cs for n in range(1, 5)]).withColumn("k", F.lit(k))
                                        for k, t in grams.items()])
    freq = {r.k: r for r in tally.collect()}  # four numbers per order and model

    def bounded(table: DataFrame, length: int) -> DataFrame:
        # One row per symbol at most where the key is one symbol or none: some MB. Such keys are hot, too.
        return F.broadcast(table) if length <= 1 else table
    below, lower = None, [F.lit(1.0 / SIZE)] * models
    for k in range(1, ORDER + 1):
        d = [discounts({n: freq[k][f"{c}_{n}"] for n in range(1, 5)}) for c in cs]
        context = grams[k].groupBy(_context(F.col("g")).alias("x")).agg(
            *[F.sum(c).alias(f"s{m}") for m, c in enumerate(cs)],
            *[F.sum(F.when(F.col(c) > 0, _discount(F.col(c), d[m])).otherwise(0.0)).alias(f"d{m}") for m, c in enumerate(cs)])
        out = wanted[k].join(bounded(grams[k], k), "g", "left")
        if below is not None:
            out = out.withColumn("u", _last(F.col("g"), k - 1)).join(bounded(below, k - 1), "u")
        out = out.withColumn("x", _context(F.col("g"))).join(bounded(context, k - 1), "x", "left")
        probabilities = []
        for m in range(models):
            c, s = F.coalesce(f"c{m}", F.lit(0)), F.col(f"s{m}")
            own = F.greatest(c - _discount(c, d[m]), F.lit(0.0))
            probabilities.append(F.when(F.coalesce(s, F.lit(0)) == 0, lower[m]).otherwise((own + F.col(f"d{m}") * lower[m]) / s))
        if k == ORDER:
            break
        below = kept(out.select(F.col("g").alias("u"), *[p.alias(f"p{m}") for m, p in enumerate(probabilities)]), "probabilities")
        lower = [F.col(f"p{m}") for m in range(models)]
    return out.select(F.col("g").alias("code"), *[F.log(p).alias(f"l{m}") for m, p in enumerate(probabilities)])


#: Columns of the documents while they are scored.
DOC = ["doc_id", "lang", "digest", "model", "text"]


def blocks(rows: DataFrame) -> DataFrame:
    """Documents (``DOC``) with their ``part``, the number of the task that scans them.

    They are read several times and have to come in the same parts and order. A scan of
    files gives them so; other frames are written first.
    """
    spark = session(rows)
    rows = rows.select(*DOC)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = rows.rdd.getNumPartitions()
    if scan_only(rows):
        # Many small partitions would ask for the same n-grams again and again.
        few = max(spark.sparkContext.defaultParallelism, -(-size // (PIECE * PIECES)))
        if parts > 4 * few:
            rows = kept(rows.coalesce(few), "documents")
    else:
        rows = kept(rows, "documents")
    return rows.withColumn("part", F.spark_partition_id())


def by_part(rows: DataFrame, name: str, *order: str) -> str:
    """A folder with the rows, those of a ``part`` in a folder of their own and in order."""
    folder = scratch_path(rows.sparkSession, name)
    rows.repartition("part").sortWithinPartitions("part", *order).write.option("compression", "zstd").partitionBy("part").parquet(folder)
    return folder


def _own(folder: str, part: int) -> Iterator[pa.RecordBatch]:
    """The rows of a part that ``by_part`` has written."""
    store, base = place(folder)
    files = store.get_file_info(fs.FileSelector(f"{base}/part={part}", allow_not_found=True))
    for path in sorted(x.path for x in files if x.path.endswith(".parquet")):
        with store.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(1 << 16)


def _with_folds(batches: Iterator[pa.RecordBatch], folder: str | None) -> Iterator[pa.RecordBatch]:
    """The batches with each document's fold, -1 for one that trains no model; a document that should be in the part and is not raises."""
    ids = None
    for batch in batches:
        if batch.num_rows and ids is None:
            own = [x for x in _own(folder, batch.column("part")[0].as_py())] if folder else []
            ids, first = np.unique(np.concatenate([np.zeros(0, np.int64), *[x.column("doc_id").to_numpy() for x in own]]), return_index=True)
            folds = np.concatenate([np.zeros(0, np.int32), *[x.column("fold").to_numpy() for x in own]])[first]
            met = np.zeros(len(ids), bool)
        fold = np.full(batch.num_rows, -1, np.int32)
        if batch.num_rows and len(ids):
            doc = batch.column("doc_id")
            wanted = doc.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            hit = (ids[at] == wanted) & doc.is_valid().to_numpy(zero_copy_only=False)
            fold[hit] = folds[at[hit]]
            met[at[hit]] = True
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fold)], [*batch.schema.names, "fold"])
    if ids is not None and not met.all():
        raise RuntimeError("a training document was not met in its part: the scans differ")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, piece): a block is named by its place in the part."""
    for number, piece in pieces(batches, 4):
        yield number // PIECES, piece


def _runs(piece: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(model, places, rows) of a piece, by model; those with none are left out."""
    models = piece.column(column).to_numpy()
    for m in np.unique(models[models >= 0]).tolist():
        own = models == m
        yield m, np.flatnonzero(own), piece.filter(pa.array(own))


def _ask(folds: str | None):
    """Task function: (part, block, codes, need), the n-grams of a block and the models, as bits, that are asked for them."""
    def rows(part: int, block: int, found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = reduce(np.union1d, found.values(), np.zeros(0, np.int64))
        need = np.zeros(len(own), np.int32)
        for model, some in found.items():
            need[np.searchsorted(own, some)] |= 1 << model
        for a in range(0, len(own), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                                              pa.array([own[a:a + (1 << 16)]], pa.list_(pa.int64())),
                                              pa.array([need[a:a + (1 << 16)]], pa.list_(pa.int32()))], ["part", "block", "codes", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, at, found = 0, 0, {}
        for block, piece in _numbered(_with_folds(batches, folds)):
            part = piece.column("part")[0].as_py()
            if block != at:
                yield from rows(part, at, found)
                at, found = block, {}
            for column in ("model", "fold"):
                for model, _, some in _runs(piece, column):
                    own = distinct_codes(*symbols(some.column("text").to_pylist()))
                    found[model] = np.union1d(found[model], own) if model in found else own
        yield from rows(part, at, found)
    return run


def _answers(folder: str, part: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(block, codes, log-probabilities by model) of a part, codes in order."""
    def joined() -> tuple[int, np.ndarray, list[np.ndarray]]:
        code, *logp = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(code)
        return at, code[order], [x[order] for x in logp]
    at, held = None, []
    for batch in _own(folder, part):
        block = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], np.diff(block) != 0, [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if block[a] != at:
                if held:
                    yield joined()
                at, held = int(block[a]), []
            held.append([x.slice(a, b - a).to_numpy(zero_copy_only=False) for x in batch.columns[1:]])
    if held:
        yield joined()


def _sums(syms: np.ndarray, offsets: np.ndarray, known: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Each text's sum of log-probabilities; an n-gram without an answer raises."""
    out = np.zeros(len(offsets) - 1)
    for a in range(0, len(syms), CHUNK):
        b = min(a + CHUNK, len(syms))
        met = codes(syms, offsets, a, b)
        at = np.searchsorted(known, met)
        if not len(known) or (known[np.minimum(at, len(known) - 1)] != met).any():
            raise RuntimeError("an n-gram of a document was not answered: its block is not the one that asked")
        total = np.concatenate(([0.0], np.cumsum(logp[at].astype(np.float64))))
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        edge = np.clip(offsets[i:j + 1], a, b) - a
        out[i:j] += total[edge[1:]] - total[edge[:-1]]
    return out


SCORED = "doc_id long, lang string, digest binary, model int, n long, total double, held double"


def _score(folds: str | None, answered: str):
    """Task function: each document's sum under its model, and, if it trains one, under the model without its fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        nothing = np.zeros(0, np.int64), [np.zeros(0, np.float32)] * (FOLDS + 1)
        answers, ahead, at, table = None, None, None, nothing
        for block, piece in _numbered(_with_folds(batches, folds)):
            if answers is None:
                answers = _answers(answered, piece.column("part")[0].as_py())
                ahead = next(answers, None)
            if block != at:
                at, table = block, nothing
                if ahead is not None and ahead[0] == block:
                    table, ahead = ahead[1:], next(answers, None)
            n = np.zeros(piece.num_rows, np.int64)
            sums = {column: np.full(piece.num_rows, np.nan) for column in ("model", "fold")}
            for column, out in sums.items():
                for m, places, part in _runs(piece, column):
                    syms, offsets = symbols(part.column("text").to_pylist())
                    n[places], out[places] = np.diff(offsets), _sums(syms, offsets, table[0], table[1][m])
                    if np.isnan(out[places]).any():
                        raise RuntimeError("an n-gram of a document was not answered under its model")
            yield pa.RecordBatch.from_arrays([*piece.columns[:4], pa.array(n), pa.array(sums["model"]), pa.array(sums["fold"], from_pandas=True)],
                                             ["doc_id", "lang", "digest", "model", "n", "total", "held"])
    return run


def document_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, lang, digest, model, n, total, held) of documents (``DOC``), each under its model of (model, code, c); ``held`` is null."""
    return scored(blocks(rows), by_model(counts, FOLDS + 1))


def scored(rows: DataFrame, counts: DataFrame, folds: str | None = None) -> DataFrame:
    """The scores of documents in ``blocks`` under the models of (code, c0, c1, ...); ``folds`` names other models of some, by part."""
    asked = kept(rows.mapInArrow(_ask(folds), "part int, block int, codes array<long>, need array<int>"), "asked").select(
        "part", "block", F.explode(F.arrays_zip("codes", "need")).alias("_one")).select("part", "block", "_one.codes", "_one.need").withColumnRenamed("codes", "code")
    logs = [f"l{m}" for m in range(FOLDS + 1)]
    known = model_log_probabilities(counts, asked.select("code").distinct(), FOLDS + 1)
    known = kept(known.select("code", *[F.col(x).cast("float").alias(x) for x in logs]), "known")
    answered = by_part(asked.join(known, "code").select("part", "block", "code", *[
        F.when(F.col("need").bitwiseAND(F.lit(1 << m)) != 0, F.col(x)).alias(x) for m, x in enumerate(logs)]), "answers", "block")
    return rows.mapInArrow(_score(folds, answered), SCORED)


#: Ranges of identifiers' hashes, within each of which a language's documents are dealt in turn.
RANGES = 256


def deal(rows: DataFrame) -> DataFrame:
    """(doc_id, fold) of all training documents; a language's documents are dealt in turn, in the order of their hashes."""
    each = rows.groupBy("doc_id").agg(F.min(F.coalesce("lang", F.lit(""))).alias("key")).withColumn("_h", F.xxhash64("doc_id"))
    each = each.withColumn("_range", F.shiftright("_h", 56).cast("int")).checkpoint()
    # Documents of a language in earlier ranges: RANGES rows a language at most.
    earlier = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("key", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "key", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("key", "_range").orderBy("_h", "doc_id")) - 1
    return (each.withColumn("_place", place).join(before, ["key", "_range"])
            .select("doc_id", ((F.col("_place") + F.col("_before")) % FOLDS).cast("int").alias("fold")).checkpoint())


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Identifiers that are labelled good and not toxic, each once."""
    return (labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("doc_id")).distinct())


def _scores(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents' scores; the trusted ones' held-out scores; and their means by language."""
    rows = blocks(docs)
    dealt = deal(rows.where("text != ''").join(trusted_ids(labels), "doc_id", "left_semi").select("doc_id", "lang"))
    folds = by_part(rows.select("doc_id", "part").join(dealt, "doc_id"), "folds")
    by_fold = kept(fold_counts(rows, folds), "fold-counts")
    # The last model is of all folds, the others lack one.
    total = sum((F.col(f"f{k}") for k in range(1, FOLDS)), F.col("f0"))
    counts = by_fold.select("code", *[(total - F.col(f"f{k}")).alias(f"c{k}") for k in range(FOLDS)], total.alias(f"c{FOLDS}"))
    scores = scored(rows, counts, folds).drop("model").checkpoint()
    good = scores.where("n > 0 and held is not null").withColumn("total", F.col("held")).drop("held")
    means = good.groupBy(F.coalesce("lang", F.lit("")).alias("key")).agg((F.sum("total") / F.sum("n")).alias("mean")).checkpoint()
    return scores.drop("held"), good, means


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR,
                   id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, perplexity, threshold, accepted, text_sha256.

    Perplexities are per character, with ``prior`` symbols at the trusted mean of the
    language added. Trusted perplexities, for means and thresholds, are held out. A
    language with under ``1 / (1 - quantile)`` trusted documents has as threshold the
    largest of theirs, or their mean (of logarithms) with the quantile of all trusted
    documents' distances from their languages' means, whichever is more; the distance
    is widened by ``sqrt(1 + 1 / n)``, as a mean of n documents is uncertain itself.
    Null and empty texts have null perplexity and are rejected, as there is nothing to
    train on. A language without trusted documents, null included, is judged by the
    quantile over all of them; without any trusted document nothing but empty texts is
    rejected. Repeated rows are judged each on its own; other columns are ignored.
    """
    scores, good, means = _scores(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                                              digest_of(text_col).alias("digest"), F.lit(FOLDS).alias("model"), text_of(text_col).alias("text")), labels)
    # Whole documents are not dealt by language, as one language may hold most of them; few languages are broadcast.
    few = means.count() <= FEW_LANGUAGES
    overall = good.agg((F.sum("total") / F.sum("n")).alias("all_mean"))

    def told(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    def smoothed(df: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", "all_mean", F.lit(0.0))
        return (df.withColumn("key", F.coalesce("lang", F.lit(""))).join(told(means), "key", "left").crossJoin(F.broadcast(overall))
                .withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-(F.col("total") + prior * mean) / (F.col("n") + prior)))))

    def high(col: str | Column) -> Column:
        return F.percentile_approx(col, F.lit(quantile), 10000)
    judged = smoothed(good)
    limits = judged.groupBy("key").agg(high("perplexity").alias("own"), F.avg(F.log("perplexity")).alias("centre"),
                                       F.count("*").alias("trusted")).checkpoint()
    rest = judged.join(told(limits), "key").agg(high("perplexity").alias("all_limit"), high(F.log("perplexity") - F.col("centre")).alias("spread"))
    out = smoothed(scores).join(told(limits), "key", "left").crossJoin(F.broadcast(rest))
    own = F.when(F.col("trusted") * (1 - quantile) >= 1 - 1e-9, F.col("own")).otherwise(
        F.greatest("own", F.exp(F.col("centre") + F.col("spread") * F.sqrt(1 + 1 / F.col("trusted")))))
    limit = F.coalesce(own, "all_limit")
    return out.select("doc_id", "lang", F.col("n").alias("n_symbols"), "perplexity", limit.alias("threshold"),
                      F.coalesce((F.col("n") > 0) & (F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf")))),
                                 F.lit(False)).alias("accepted"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The accepted documents, all columns unchanged.

    Each row is decided by its identifier, language and text, null as a value like
    others: a rejected text takes no other text of the same identifier with it, and
    rows that agree in all three go or stay together.
    """
    gone = (quality_scores(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **how).where(~F.col("accepted"))
            .select(F.col("doc_id").alias("_gone"), F.col("lang").alias("_gone_lang"), F.unhex("text_sha256").alias("_gone_digest")).distinct())
    rows = docs.withColumns({"_id": F.col(id_col).cast("long"), "_lang": F.col(lang_col).cast("string"), "_digest": digest_of(text_col)})
    return (rows.join(gone, same(rows, gone, {"_id": "_gone", "_lang": "_gone_lang", "_digest": "_gone_digest"}), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
