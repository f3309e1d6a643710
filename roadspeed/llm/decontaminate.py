"""Benchmark decontamination by winnowed fingerprints.

Of every ``window`` consecutive words of a text the smallest hash of its
``gram``-word shingles is kept. Two texts that share ``window`` words share a kept
hash, so joining the fingerprints of documents and items and extending every hit
in both directions finds all shared windows. Items shorter than a window are one
window of their own length: for each such length every shingle of that length
is a fingerprint.

If words and fingerprints of the items are within ``BROADCAST_WORDS``, the join is
a map-side lookup and nothing is shuffled. Beyond that, fingerprints are joined
by a shuffle, only item passages around hits are fetched, and documents meet their
hits again by identifier. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import digest_of, kept, release, same, session, text_of
from roadspeed.llm.words import ALNUM, Words, buffers, chunks, grams, winnow, words

WINDOW, GRAM = 10, 5
#: Items of up to this many words together (some 60 MB with fingerprints) are sent to every task.
BROADCAST_WORDS = 2_000_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, digest binary"
PRINT = "place long, print long, length int"


def prints(w: Words, window: int, gram: int, short: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, hashes) for the full window and every shorter item length."""
    left = w.left()
    g = grams(w.hash, gram)
    at = winnow(g, left, gram, window - gram + 1)
    out = [(window, at, g[at])]
    for n in short:
        g = grams(w.hash, n)
        at = np.flatnonzero(left[:len(g)] >= n)
        out.append((n, at, g[at]))
    return out


class Items:
    """Items with their fingerprints, for lookup from document positions."""

    def __init__(self, rows: list[tuple[int, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        data, offsets = buffers(pa.array([t for _, t in rows], pa.large_string()))
        self.words = words(data, offsets, ALNUM)
        self.ids = [i for i, _ in rows]
        sizes = np.diff(self.words.ends, prepend=0)
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.begin, self.end = self.words.ends - sizes, self.words.ends
        self.short = sorted({int(n) for n in sizes if 0 < n < window})
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, at, h in prints(self.words, window, gram, self.short):
            if length < window:  # an item of n words is one window; longer items have none of n words
                keep = sizes[self.owner[at]] == length
                at, h = at[keep], h[keep]
            order = np.argsort(h, kind="stable")
            self.found[length] = h[order], at[order]

    def hits(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(item row, first, last) word ranges of the documents' words that some window covers."""
        doc = np.repeat(np.arange(len(w.ends)), np.diff(w.ends, prepend=0))
        for length, at, h in prints(w, self.window, self.gram, self.short):
            known, place = self.found[length]
            lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            some = np.flatnonzero(hi > lo)
            # The last extension on a diagonal of a document and the items covers later hits on it.
            done: dict[tuple[int, int], int] = {}
            for p, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                d = int(doc[p])
                first, last = int(w.ends[d - 1]) if d else 0, int(w.ends[d])
                for q in place[a:b].tolist():
                    if done.get((d, p - q), -1) > p:
                        continue
                    i = int(self.owner[q])
                    x, y = self.extend(w, p, q, first, last, int(self.begin[i]), int(self.end[i]))
                    done[d, p - q] = y
                    if y - x >= length:
                        yield i, x, y

    def extend(self, w: Words, p: int, q: int, first: int, last: int, begin: int, end: int) -> tuple[int, int]:
        """The longest range around document word p that equals the item's words around q."""
        n = min(last - p, end - q)
        y = p + _agree(w.hash[p:p + n], self.words.hash[q:q + n])
        n = min(p - first, q - begin)
        x = p - _agree(w.hash[p - n:p][::-1], self.words.hash[q - n:q][::-1])
        if w.text(x, y) == self.words.text(x - p + q, y - p + q):
            return x, y
        # Words that differ under one hash: go word by word.
        same = [w.text(j, j + 1) == self.words.text(j - p + q, j - p + q + 1) for j in range(x, y)]
        if not same[p - x]:
            return p, p
        y = next((j for j in range(p, y) if not same[j - x]), y)
        return next((j + 1 for j in range(p - 1, x - 1, -1) if not same[j - x]), x), y


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


def answer(doc_id: int | None, digest: bytes, n_words: int, ranges: list[tuple[int, int]], items: set[int]) -> tuple:
    """A result row from covered word ranges and item identifiers."""
    n_hit, reach = 0, 0
    for a, b in sorted(ranges):
        n_hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    names = ",".join(sorted(map(str, items)))
    return (doc_id, n_words, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0, sorted(items), digest)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    return _table(rows, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "digest"],
                  [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.binary()])


#: The items that a worker has fingerprinted last, kept from task to task.
_OPEN: dict[tuple, Items] = kept("items")


def _opened(shared, window: int, gram: int) -> Items:
    release("items")
    key = id(shared.value), window, gram
    if key not in _OPEN or _OPEN[key].source is not shared.value:
        _OPEN.clear()
        _OPEN[key] = Items(shared.value, window, gram)
        _OPEN[key].source = shared.value
    return _OPEN[key]


def _scan(shared, window: int, gram: int):
    """Task function of the lookup way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(shared, window, gram)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids, digests = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in chunks(offsets):
                w = words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ALNUM)
                ranges, found = defaultdict(list), defaultdict(set)
                for item, x, y in items.hits(w):
                    d = int(np.searchsorted(w.ends, x, "right"))
                    ranges[d].append((x, y))
                    found[d].add(items.ids[item])
                sizes = np.diff(w.ends, prepend=0).tolist()
                yield _answers([answer(ids[i + d], digests[i + d], n, ranges.get(d, []), found.get(d, set())) for d, n in enumerate(sizes)])
    return run


def _emit_prints(window: int, gram: int, short: list[int], only_own: bool):
    """Task function: a row per fingerprint of (key, text) rows; items give their own length only."""
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys = np.array(batch.column(0).to_pylist(), np.int64)
            for i, j in chunks(offsets):
                w = words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ALNUM)
                sizes = np.diff(w.ends, prepend=0)
                doc = np.repeat(np.arange(j - i), sizes)
                for length, at, h in prints(w, window, gram, short):
                    if only_own and length < window:
                        keep = sizes[doc[at]] == length
                        at, h = at[keep], h[keep]
                    # A text's repeats of a fingerprint are found again when the text is searched.
                    pair = np.unique(np.stack((keys[i:j][doc[at]], h.view(np.int64))), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(
                        np.full(pair.shape[1], length, np.int32))], ["place", "print", "length"])
    return run


def _verify(window: int, gram: int):
    """Task function of the shuffled way: one document with the items that share a fingerprint with it."""
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, digest, near in zip(*(c.to_pylist() for c in batch.columns)):
                data, offsets = buffers(pa.array([text], pa.large_string()))
                w = words(data, offsets, ALNUM)
                ranges, found = [], set()
                # A bounded number of items at a time.
                for k in range(0, len(near or ()), 512):
                    items = Items([(x["item_id"], x["text"]) for x in near[k:k + 512]], window, gram)
                    for item, x, y in items.hits(w):
                        ranges.append((x, y))
                        found.add(items.ids[item])
                out.append(answer(doc_id, digest, len(w.hash), ranges, found))
            yield _answers(out)
    return run


def _short_lengths(window: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            seen |= {int(n) for n in np.diff(words(data, offsets, ALNUM).ends, prepend=0) if 0 < n < window}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["n"])
    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  broadcast_words: int = BROADCAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are lower-cased runs of letters, digits and non-ASCII characters. Null
    and empty texts have no words; items without words match nothing; items that
    are equal are all reported; items with a null identifier are left out. Rows
    that repeat are answered each on its own; other columns are ignored.
    """
    return _judged(docs, items, window, gram, broadcast_words, id_col, text_col, item_col, item_text).drop("digest")


def _judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_words: int = BROADCAST_WORDS,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``decontaminate`` with the digest of the text."""
    if not 0 < gram < window:
        raise ValueError("a shingle is shorter than the window")
    spark = session(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
                       digest_of(text_col).alias("digest"))
    items = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), text_of(item_text).alias("text"))
    # Each word has at least one byte and a gap, so bytes bound words.
    size, longest = items.agg(F.sum((F.octet_length("text") + 1) / 2), F.count("*")).first()
    if (size or 0) + longest <= broadcast_words:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.orderBy("item_id", "text").collect()])
        return docs.mapInArrow(_scan(shared, window, gram), RESULT)
    short = sorted(r.n for r in items.select("text").mapInArrow(_short_lengths(window), "n int").distinct().collect())
    # Row keys, as identifiers may repeat; the table is written so that a lost task finds the same keys.
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "digest").checkpoint()
    items = items.dropDuplicates().select(F.monotonically_increasing_id().alias("row"), "item_id", "text").checkpoint()
    of_docs = keyed.select("key", "text").mapInArrow(_emit_prints(window, gram, short, False), PRINT)
    of_items = items.select("row", "text").mapInArrow(_emit_prints(window, gram, short, True), PRINT)
    pairs = (of_docs.withColumnRenamed("place", "key").join(of_items.withColumnRenamed("place", "row"), ["print", "length"])
             .select("key", "row").distinct())
    near = (pairs.join(items, "row").groupBy("key").agg(F.collect_list(F.struct("item_id", "text")).alias("near")))
    return (keyed.join(near, "key", "left").select("doc_id", "text", "digest", "near").mapInArrow(_verify(window, gram), RESULT))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without any shared window, all columns unchanged.

    Each row is decided by its own text: another text of the same identifier goes or
    stays by itself, and rows that agree in both go or stay together. Rows with a null
    identifier are kept.
    """
    bad = (_judged(docs, items, id_col=id_col, text_col=text_col, **how).where("contaminated and doc_id is not null")
           .select(F.col("doc_id").alias("_bad"), F.col("digest").alias("_bad_digest")).distinct())
    rows = docs.withColumns({"_id": F.col(id_col).cast("long"), "_digest": digest_of(text_col)})
    return (rows.join(bad, same(rows, bad, {"_id": "_bad", "_digest": "_bad_digest"}), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
