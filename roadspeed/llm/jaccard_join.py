"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Equal texts are one node. A node's signature is cut into ``TREES`` labels of
``DEPTH`` hashes, the keys of prefix tries. The nodes below the shortest prefix in
use are one subtrie of a tree. It is sorted by label and walked upwards: nodes of
equal labels are matched first, then the prefix is shortened by one value at a time,
and only nodes that no longer match has connected yet are compared. A subtrie is
left as soon as all its nodes are connected; else the prefix is shortened until the
chance that a pair at the threshold has met in some tree reaches the target recall.
A match compares whole signatures; what is far below the threshold (five standard
errors) is not a candidate. Candidates are joined to classes, and inside a class
the shingle sets of all pairs are compared exactly.

Nodes below a prefix, and nodes of a class, are dealt into blocks, and each pair of
blocks is a group of its own: a group is bounded, and a large one is spread over
many tasks. Pairs are counted where they are found; a group gives one row per
node, with the number of its links and a spanning link, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.components import components
from roadspeed.llm.frames import digest_of, session, text_of
from roadspeed.llm.words import ALNUM, U64, Words, buffers, chunks, grams, mix, words

SHINGLE = 5
#: Similarity of 4/5 or more, as a fraction for exact comparison.
THRESHOLD = (4, 5)
TREES, DEPTH = 16, 6
RECALL = 0.999
#: Nodes in a block, and pairs whose signatures are compared at once.
BLOCK, PAIRS = 256, 8192

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold ** k) ** trees >= recall:
            return k
    raise ValueError("no prefix length reaches the recall")


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): shingle hashes of all texts in a row, and where each text's end.

    A text with fewer words has one shingle of all of them; one without has none.
    """
    count = np.diff(w.ends, prepend=0)
    own = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    ends = np.cumsum(own)
    full = grams(w.hash, size)
    begin = w.ends - count
    at = np.repeat(begin - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
    out = np.zeros(len(at), U64)
    whole = np.repeat(count >= size, own)
    out[whole] = full[at[whole]]
    for d in np.flatnonzero((count > 0) & (count < size)):
        n = int(count[d])
        out[ends[d] - 1] = grams(w.hash[begin[d]:begin[d] + n], n)[0] ^ U64(n)
    return out, ends


def signatures(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of TREES * DEPTH 32-bit minimum hashes per text; texts without shingles have the largest values."""
    own = np.diff(ends, prepend=0)
    some = own > 0
    out = np.full((len(ends), TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    first = (ends - own)[some]
    if len(first):
        for k in range(TREES * DEPTH):
            out[some, k] = np.minimum.reduceat((h * _A[k] + _B[k]) >> U64(32), first)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i, j in chunks(offsets):
            w = words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ALNUM)
            h, ends = shingles(w, SHINGLE)
            sig = signatures(h, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                 pa.array([row.tobytes() if n else None for row, n in zip(sig, np.diff(ends, prepend=0))], pa.binary())],
                ["digest", "doc_id", "sig"])


def _prefixes(length: int):
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            key = np.broadcast_to(np.arange(1, TREES + 1, dtype=U64), sig.shape[:2]).copy()
            for k in range(length):
                key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, :, k])
            nodes = pa.array(np.repeat(np.arange(len(sig)), TREES))
            trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), trees, batch.column(0).take(nodes)], ["key", "tree", "digest"])
    return run


def dealt(df: DataFrame, key: str, size: str) -> DataFrame:
    """Deal groups of ``size`` rows into blocks and each row to all pairs of its block: adds i, j and side."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    return (df.withColumn("side", F.pmod(F.xxhash64("digest", key), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other"))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (key, i, j) from a partition that is sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k, i, j = (np.asarray(t[c]) for c in ("key", "i", "j"))
        cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]):
            name = (k[a], i[a], j[a])
            if held and name != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, z - a))
            last = name
    if held:
        yield pa.concat_tables(held)


def roots(near: np.ndarray) -> np.ndarray:
    """Per row of a symmetric adjacency matrix the smallest index of its component."""
    n = len(near)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _cross(t: pa.Table) -> np.ndarray:
    """Which pairs of a group's rows belong to it: all, or those of two different blocks."""
    side = np.asarray(t["side"])
    alone = t["i"][0].as_py() == t["j"][0].as_py()
    out = np.ones((len(side), len(side)), bool) if alone else side[:, None] != side[None, :]
    np.fill_diagonal(out, False)
    return out


def climb(sig: np.ndarray, tree: int, allowed: np.ndarray, shortest: int, least: int) -> np.ndarray:
    """Per node of a subtrie the first of its component, walking up from full labels to prefixes of ``shortest`` values.

    ``sig`` holds the nodes' signatures (node, tree, place); two nodes of a common prefix are
    connected if they are ``allowed`` and agree in ``least`` places of all trees.
    """
    whole = sig.reshape(len(sig), -1)
    order = np.lexsort(sig[:, tree, ::-1].T)
    label = sig[order, tree]
    near = np.zeros((len(sig), len(sig)), bool)
    root = np.arange(len(sig))
    for depth in range(sig.shape[2], shortest - 1, -1):
        run = np.empty(len(sig), np.int64)
        run[order] = np.concatenate(([0], np.cumsum((label[1:, :depth] != label[:-1, :depth]).any(axis=1))))
        u, v = np.nonzero(np.triu((run[:, None] == run[None, :]) & (root[:, None] != root[None, :]) & allowed))
        for a in range(0, len(u), PAIRS):
            x, y = u[a:a + PAIRS], v[a:a + PAIRS]
            met = (whole[x] == whole[y]).sum(axis=1) >= least
            near[x[met], y[met]] = near[y[met], x[met]] = True
        root = roots(near)
        if not root.any():
            break
    return root


def _candidates(shortest: int, least: int):
    """Task function: spanning links of the nodes of each subtrie, a (key, i, j) group."""
    def run(batches):
        for t in groups(batches):
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            root = climb(sig, t["tree"][0].as_py(), _cross(t), shortest, least)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                digest = t["digest"].combine_chunks()
                yield pa.RecordBatch.from_arrays([digest.take(pa.array(at)), digest.take(pa.array(root[at]))], ["u", "v"])
    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(n), sizes)
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[item] > 1
    _, item = np.unique(item[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    out = np.zeros((n, n), np.float64)
    step = 4096
    for a in range(0, int(item[-1]) + 1 if len(item) else 0, step):
        lo, hi = np.searchsorted(item, [a, a + step])
        block = np.zeros((n, step), np.float32)
        block[owner[lo:hi], item[lo:hi] - a] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _verify(up: int, down: int):
    """Task function: per node of a group of candidates its exact links (rows of linked nodes) and a spanning link."""
    def run(batches):
        for t in groups(batches):
            sets = [np.frombuffer(b, U64) for b in t["set"].to_pylist()]
            size = np.array([len(s) for s in sets])
            both = shared(sets)
            near = (both * (up + down) >= up * (size[:, None] + size[None, :])) & _cross(t)
            root = roots(near)
            digest = t["digest"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [digest, digest.take(pa.array(root)), pa.array(near @ np.asarray(t["copies"]))], ["u", "v", "links"])
    return run


def _sets(batches):
    """Task function: the distinct shingle hashes of each text, sorted."""
    for batch in batches:
        data, offsets = buffers(batch.column(3))
        for i, j in chunks(offsets):
            w = words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ALNUM)
            h, ends = shingles(w, SHINGLE)
            cuts = [0, *ends.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(i, j - i) for c in range(3)]
                + [pa.array([np.unique(h[a:z]).tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())],
                ["digest", "root", "copies", "set"])


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD,
                 recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles (words as lower-cased runs of letters, digits and non-ASCII characters;
    fewer words are one shingle) is ``threshold`` or more. ``n_links`` counts a
    document's linked documents, equal texts included; ``class_id`` is the smallest
    identifier among the documents connected by links. Texts without a word, null
    included, are linked to nothing. Rows that repeat, or have a null identifier, are
    documents like others; a class of null identifiers only has a null class_id.
    Other columns are ignored.
    """
    rows, told = _classes(df, id_col, text_col, threshold, recall)
    told = told.select("digest", "class_id", "n_links")
    return rows.select("digest", "doc_id").join(told, "digest", "left").select(
        F.col("doc_id").alias(id_col), F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(digest, doc_id, text) of the rows, and (digest, class_id, head, n_links) of the texts that are linked or repeat.

    ``head`` is the text of the class that has the smallest identifier; of several the one of the smallest digest.
    """
    session(df)
    up, down = threshold
    length = prefix_length(up / down, recall=recall)
    share = up / down
    least = max(1, int(TREES * DEPTH * (share - 5 * (share * (1 - share) / (TREES * DEPTH)) ** 0.5)))
    text = text_of(text_col)
    rows = df.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"),
                     text.alias("text"))
    # Written once: prefixes, candidates and sizes are all drawn from it.
    nodes = (rows.mapInArrow(_sign, "digest binary, doc_id long, sig binary").where("sig is not null").groupBy("digest")
             .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))).checkpoint()
    keys = nodes.select("digest", "sig").mapInArrow(_prefixes(length), "key long, tree int, digest binary")
    many = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    below = dealt(keys.join(many, "key").join(nodes.select("digest", "sig"), "digest"), "key", "size")
    found = components(_grouped(below).mapInArrow(_candidates(length, least), "u binary, v binary"))
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    chosen = found.join(nodes.select(F.col("digest").alias("node"), "first_id", "copies"), "node").select(
        F.col("node").alias("digest"), "root", "first_id", "copies")
    # One row of each text: that of the first identifier.
    texts = (rows.join(chosen, "digest").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
             .select("digest", "root", "copies", "text").mapInArrow(_sets, "digest binary, root binary, copies long, set binary")
             .dropDuplicates(["digest"]).join(sizes, "root").withColumn("key", F.xxhash64("root")))
    links = _grouped(dealt(texts, "key", "size")).mapInArrow(_verify(up, down), "u binary, v binary, links long").checkpoint()
    classes = components(links.select("u", "v"))
    degree = links.groupBy(F.col("u").alias("digest")).agg(F.sum("links").alias("linked"))
    named = (nodes.select("digest", "first_id", "copies").join(degree, "digest", "left")
             .join(classes.select(F.col("node").alias("digest"), "root"), "digest", "left")
             .withColumn("root", F.coalesce("root", "digest")))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members"), F.min(
        F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "digest")).alias("head"))
    told = (named.join(lowest, "root").where("members > 1 or copies > 1")
            .select("digest", "class_id", F.col("head.digest").alias("head"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return rows, told


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class, all columns unchanged: one of the smallest identifier, and of that the text of the smallest digest.

    Each row is decided by its own identifier and text, so a dropped text takes no other
    text of its identifier with it; of rows that agree in both one stays. A null
    identifier stays only for a class that has no other. Texts without a word are in no
    class and stay.
    """
    _, told = _classes(df, id_col, text_col, **how)
    told = told.select(F.col("digest").alias("_class_digest"), F.col("class_id").alias("_class_id"),
                       (F.col("digest") == F.col("head")).alias("_class_head")).checkpoint()
    rows = df.withColumns({"_id": F.col(id_col).cast("long"), "_digest": F.substring(digest_of(text_col), 1, 16)})
    alone = rows.join(told, F.col("_digest") == F.col("_class_digest"), "left_anti")
    heads = told.where("_class_head")
    best = rows.join(heads, (F.col("_digest") == F.col("_class_digest")) & F.col("_id").eqNullSafe(F.col("_class_id")), "left_semi")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return alone.select(*columns).unionByName(best.dropDuplicates(["_digest"]).select(*columns))
