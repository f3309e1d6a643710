"""Hard negatives of vectors by a GNAT: a tree of split points with distance ranges between siblings.

Vectors are rounded to integers, so scores (inner products) are exact. One more
coordinate, the root of the largest squared norm less the vector's own, puts all rows
on a sphere: the distance to an anchor then falls as the score rises, and a range of
scores is an annulus around the anchor.

The tree is fitted on a bounded sample. Each node has split points far from each
other; a row goes to the nearest (ties: the first), down to a leaf. For every two
siblings i and j the node stores the smallest and largest distance from split point
i to the rows below j, over all rows. An anchor at distance d from split point i meets
nothing below j unless [d - r2, d + r2] reaches that range and the range does not lie
within r1 of d, for some window r1..r2 of the anchor.

Leaves are searched exactly, in blocks of bounded size: rows and the anchors sent to
their block are shuffled together, the block's rows first, and anchors stream past
them. Positives are searched in the anchor's own leaf, then in the leaves within the
distance found; negatives alike, within the windows of the positives' scores. All
eliminations are exact, so the result is that of brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspeed.llm.frames import session

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score is at least 80 hundredths of the positive's and at most the positive's.
LOW, HIGH = 80, 100
#: Rows that the tree is fitted on, those of the smallest identifier hash.
SAMPLE = 16_384
#: Split points of a node, and rows of the sample below which a node is a leaf.
FAN, LEAF = 8, 1024
#: Bytes of the vectors in one block of a leaf.
BLOCK = 16 << 20
#: Scores that are computed at once.
AT_ONCE = 1 << 21
#: Widening of distances against rounding, relative to the sphere.
SLACK = 1e-9


# --- vectors -------------------------------------------------------------------

def integers(vector: Column, scale: int = SCALE) -> Column:
    """The components as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether all components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def _packed(width: str, dim: int):
    """Task function: (vec_id, label, q) with each vector as bytes, shorter ones filled with zeros."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                vectors = part.column(2)
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                out = np.zeros((len(sizes), dim), width)
                out[np.arange(dim) < sizes[:, None]] = flat
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in out], pa.binary())],
                                                 ["vec_id", "label", "q"])
    return run


def _matrix(column: pa.Array, width: str, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, width).reshape(len(column), dim)


def _exact_type(width: str, dim: int) -> type:
    """The fastest type in which sums of ``dim`` products are exact."""
    most = dim * (1 << (8 * np.dtype(width).itemsize - 1)) ** 2
    return np.float32 if most <= 1 << 24 else np.float64 if most <= 1 << 53 else np.int64


# --- the tree ------------------------------------------------------------------

@dataclass
class Node:
    """Split points (one row each, lifted), children (node or leaf numbers as ~leaf) and ranges [i, j, low or high]."""

    points: np.ndarray
    children: list[int] = field(default_factory=list)
    ranges: np.ndarray | None = None


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def lifted(q: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that puts them on the sphere of squared radius ``top``."""
    x = q.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def _spread(x: np.ndarray, fan: int) -> np.ndarray:
    """Up to ``fan`` different rows, each the farthest from those before."""
    chosen = [0]
    gap = _distances(x, x[:1])[:, 0]
    while len(chosen) < fan:
        k = int(gap.argmax())
        if gap[k] <= 1e-6:
            break
        chosen.append(k)
        gap = np.minimum(gap, _distances(x, x[k:k + 1])[:, 0])
    return x[chosen]


def fit(x: np.ndarray, fan: int = FAN, leaf: int = LEAF) -> tuple[list[Node], int]:
    """(nodes, number of leaves) of a tree over the lifted sample; node 0 is the root, without nodes there is one leaf."""
    nodes: list[Node] = []
    leaves = 0

    def build(part: np.ndarray) -> int:
        nonlocal leaves
        points = _spread(part, fan) if len(part) >= max(leaf, 2) else part[:0]
        if len(points) < 2:
            leaves += 1
            return ~(leaves - 1)
        own = len(nodes)
        nodes.append(Node(points))
        nearest = _distances(part, points).argmin(1)
        nodes[own].children = [build(part[nearest == j]) for j in range(len(points))]
        nodes[own].ranges = np.tile(np.array([math.inf, -math.inf]), (len(points), len(points), 1))
        return own
    build(x)
    return nodes, leaves


def descend(nodes: list[Node], x: np.ndarray, learn: bool = False) -> np.ndarray:
    """The leaf of each row; with ``learn`` the ranges are widened to hold all rows."""
    leaf = np.zeros(len(x), np.int32)

    def go(at: int, rows: np.ndarray) -> None:
        if at < 0:
            leaf[rows] = ~at
            return
        node = nodes[at]
        d = _distances(x[rows], node.points)
        nearest = d.argmin(1)
        for j, child in enumerate(node.children):
            own = nearest == j
            if own.any():
                if learn:
                    node.ranges[:, j, 0] = np.minimum(node.ranges[:, j, 0], d[own].min(0))
                    node.ranges[:, j, 1] = np.maximum(node.ranges[:, j, 1], d[own].max(0))
                go(child, rows[own])
    if nodes and len(x):
        go(0, np.arange(len(x)))
    return leaf


def visited(nodes: list[Node], leaves: int, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> np.ndarray:
    """[anchor, leaf]: the leaves that some annulus inner..outer (several for each anchor) of an anchor may reach."""
    out = np.zeros((len(anchors), leaves), bool)

    def go(at: int, rows: np.ndarray) -> None:
        if at < 0:
            out[rows, ~at] = True
            return
        node = nodes[at]
        d = _distances(anchors[rows], node.points)[:, :, None]  # anchor, split point, child
        low, high = node.ranges[:, :, 0], node.ranges[:, :, 1]
        # Bounds of the distance from the anchor to anything below the child, by every split point.
        least = np.maximum(np.maximum(low - d, d - high), 0).max(1) - slack
        most = (d + high).min(1) + slack
        for j, child in enumerate(node.children):
            alive = ((least[:, j, None] <= outer[rows]) & (most[:, j, None] >= inner[rows])).any(1) & (high[0, j] >= 0)
            if alive.any():
                go(child, rows[alive])
    if len(anchors):
        if nodes:
            go(0, np.arange(len(anchors)))
        else:
            out[:] = True
    return out


# --- tasks ---------------------------------------------------------------------

INDEX = "vec_id long, label int, q binary, leaf int, slot long"


def _index(shared, width: str, dim: int, top: float):
    """Task function: rows with their leaf and a running number."""
    def run(batches):
        nodes = shared.value[0]
        slot = 0
        for batch in batches:
            leaf = descend(nodes, lifted(_matrix(batch.column(2), width, dim), top))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaf), pa.array(slot + np.arange(len(leaf)))],
                                             ["vec_id", "label", "q", "leaf", "slot"])
            slot += len(leaf)
    return run


def _ranges(shared, width: str, dim: int, top: float):
    """Task function: (node, i, j, low, high) over the rows of the partition."""
    def run(batches):
        nodes = [Node(n.points, n.children, n.ranges.copy()) for n in shared.value[0]]
        for batch in batches:
            descend(nodes, lifted(_matrix(batch.column(0), width, dim), top), learn=True)
        rows = [(k, i, j, *map(float, n.ranges[i, j])) for k, n in enumerate(nodes) for i in range(len(n.points)) for j in range(len(n.points))
                if n.ranges[i, j, 1] >= 0]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 3 else pa.float64()) for k, c in enumerate(zip(*rows[a:a + 10_000]))],
                                             ["node", "i", "j", "low", "high"])
    return run


#: An anchor on its way: ``win`` numbers its windows of scores lows..highs; ``own`` is its leaf.
ASK = "anchor_id long, label int, q binary, own int, lows array<long>, highs array<long>"


def _route(shared, width: str, dim: int, top: float, near: bool):
    """Task function: an anchor's rows for its own leaf (``near``) or for all others that its windows may reach."""
    def run(batches):
        nodes, leaves = shared.value
        slack = SLACK * max(math.sqrt(top), 1)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                own = part.column(3).to_numpy()
                if near:
                    who, where = np.arange(len(own)), own
                else:
                    q = _matrix(part.column(2), width, dim).astype(np.float64)
                    lows, highs = (_windows(part.column(k)) for k in (4, 5))
                    # |a - x|^2 = |a|^2 + top - 2 score; a window without scores (low > high) has no distances.
                    base = (q * q).sum(1)[:, None] + top
                    outer = np.sqrt(np.maximum(base - 2 * lows, 0)) * (1 + SLACK)
                    inner = np.sqrt(np.maximum(base - 2 * highs, 0)) * (1 - SLACK)
                    outer[lows > highs] = -1 - 2 * slack
                    reach = visited(nodes, leaves, np.hstack([q, np.zeros((len(q), 1))]), inner, outer, slack)
                    reach[np.arange(len(own)), own] = False
                    who, where = np.nonzero(reach)
                for b in range(0, len(who), 8192):
                    rows = part.take(pa.array(who[b:b + 8192]))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:6], pa.array(where[b:b + 8192].astype(np.int32))],
                                                     ["anchor_id", "label", "q", "own", "lows", "highs", "leaf"])
    return run


def _windows(column: pa.Array) -> np.ndarray:
    """Bounds of all anchors as doubles, short lists filled with windows that hold nothing."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), np.nan)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


FOUND = "anchor_id long, label int, q binary, win int, vec_id long, score long"


def _search(width: str, dim: int, same: bool, many: int):
    """Task function over (leaf, block, kind)-sorted rows: the best ``many`` of the block for each window of each anchor."""
    kind = _exact_type(width, dim)

    def run(batches):
        at, ids, labels, vectors = None, [], [], []
        block = None
        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))))
            a = 0
            while a < len(key):
                b = a + 1
                while b < len(key) and key[b] == key[a]:
                    b += 1
                part, place = batch.slice(a, b - a), key[a][:2]
                a = b
                if place != at:
                    at, ids, labels, vectors, block = place, [], [], [], None
                if part.column(2)[0].as_py() == 0:
                    ids.append(part.column(3).to_numpy())
                    labels.append(part.column(4).to_numpy())
                    vectors.append(_matrix(part.column(5), width, dim))
                    continue
                if not ids:
                    continue
                if block is None:
                    # By identifier, so that the first of equal scores is the smallest.
                    ids_, labels_, x = (np.concatenate(v) for v in (ids, labels, vectors))
                    order = np.argsort(ids_, kind="stable")
                    block = ids_[order], labels_[order], x[order].astype(kind).T.copy()
                    vectors = []
                step = max(1, AT_ONCE // len(block[0]))
                for c in range(0, part.num_rows, step):
                    yield from _best(part.slice(c, step), block, kind, width, dim, same, many)
    return run


def _best(asked: pa.RecordBatch, block, kind, width: str, dim: int, same: bool, many: int) -> Iterator[pa.RecordBatch]:
    ids, labels, x = block
    scores = _matrix(asked.column(5), width, dim).astype(kind) @ x
    who, label = asked.column(3).to_numpy(), asked.column(4).to_numpy()
    lows, highs = (asked.column(k).to_pylist() for k in (6, 7))
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(len(who)):
        row = scores[k]
        fits = (labels == label[k]) & (ids != who[k]) if same else labels != label[k]
        some = np.flatnonzero(fits & (row >= min(lows[k], default=0)) & (row <= max(highs[k], default=-1)))
        if not len(some):
            continue
        own = row[some]
        order = np.argsort(-own, kind="stable")
        some, own = some[order], own[order]
        for w, (low, high) in enumerate(zip(lows[k], highs[k])):
            a = int(np.searchsorted(-own, -high, "left"))
            b = min(int(np.searchsorted(-own, -low, "right")), a + many)
            if b > a:
                out.append((np.full(b - a, k), np.full(b - a, w), ids[some[a:b]], own[a:b].astype(np.int64)))
    if out:
        each, win, found, score = (np.concatenate(v) for v in zip(*out))
        rows = asked.take(pa.array(each))
        yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), rows.column(5), pa.array(win.astype(np.int32)),
                                          pa.array(found), pa.array(score)], ["anchor_id", "label", "q", "win", "vec_id", "score"])


# --- the operator --------------------------------------------------------------

@dataclass
class Gnat:
    """All rows by leaf (written), the tree with the ranges of all rows, and the blocks of each leaf."""

    rows: DataFrame
    shared: object
    width: str
    dim: int
    top: float
    blocks: DataFrame

    def ask(self, asks: DataFrame, near: bool, same: bool, many: int) -> DataFrame:
        """(anchor_id, label, q, win, vec_id, score) of the blocks of the anchors' own leaves, or of the others."""
        how = self.width, self.dim
        routed = asks.mapInArrow(_route(self.shared, *how, self.top, near), ASK + ", leaf int").join(F.broadcast(self.blocks), "leaf")
        none = F.array().cast("array<long>")
        questions = routed.select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"),
                                  F.col("anchor_id").alias("id"), "label", "q", "lows", "highs")
        answers = self.rows.join(F.broadcast(self.blocks), "leaf").select(
            "leaf", F.pmod(F.xxhash64("slot"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"),
            F.col("vec_id").alias("id"), "label", "q", none.alias("lows"), none.alias("highs"))
        return (answers.unionByName(questions).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
                .mapInArrow(_search(*how, same, many), FOUND))


def build(spark: SparkSession, vectors: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF, block: int = BLOCK) -> Gnat | None:
    """The index over (vec_id, label, v) with integer vectors; None without rows."""
    vectors = vectors.withColumn("size", F.size("v")).withColumn("norm", F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, dim, top, high = vectors.agg(F.count("*"), F.max("size"), F.max("norm"), F.max(F.array_max(F.transform(
        "v", lambda x: F.greatest(x, -x - 1))))).first()
    if not n:
        return None
    dim = max(1, dim)
    width = next(f"<i{b}" for b in (1, 2, 4, 8) if (high or 0) < 1 << (8 * b - 1))
    if dim * float((high or 0) + 1) ** 2 >= 2.0 ** 56:
        raise ValueError("components are too large for hundredfold scores in 64 bits")
    packed = vectors.select("vec_id", "label", "v").mapInArrow(_packed(width, dim), "vec_id long, label int, q binary")
    # A bounded sample of vectors, to fit the tree on the driver.
    few = packed.orderBy(F.xxhash64("vec_id", "q"), "q").limit(sample).select("q").toArrow()["q"]
    nodes, leaves = fit(lifted(_matrix(few, width, dim), top), fan, leaf)
    sc = spark.sparkContext
    how = width, dim, top
    rows = packed.mapInArrow(_index(sc.broadcast((nodes, leaves)), *how), INDEX).checkpoint()
    found = rows.select("q").mapInArrow(_ranges(sc.broadcast((nodes, leaves)), *how), "node int, i int, j int, low double, high double")
    # As many rows as the tree has pairs of siblings.
    for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        nodes[r.node].ranges[r.i, r.j] = r.low, r.high
    size = max(1, block // (dim * np.dtype(width).itemsize))
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks")).checkpoint()
    return Gnat(rows, sc.broadcast((nodes, leaves)), width, dim, top, blocks)


def _first(found: DataFrame, many: int) -> DataFrame:
    """The best ``many`` by score of each anchor's window, ties by smaller identifier, with their rank."""
    order = Window.partitionBy("anchor_id", "label", "q", "win").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def _hundredth(x: Column) -> Column:
    """floor(x / 100) of whole numbers, without leaving them."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _narrowed(asks: DataFrame, found: DataFrame, many: int) -> DataFrame:
    """The anchors with the lower end of each window raised to its ``many``-th score so far."""
    known = (found.where(F.col("rank") == many).groupBy("anchor_id", "label", "q")
             .agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("reached")))
    return (asks.join(known, ["anchor_id", "label", "q"], "left")
            .withColumn("lows", F.transform("lows", lambda low, w: F.greatest(low, F.col("reached")[w])))
            .select("anchor_id", "label", "q", "own", "lows", "highs"))


def hard_negatives(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   every: int = 100, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", **index) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Anchors are the rows whose identifier ``every`` divides. Their positives are the first
    ``positives`` other rows of the same label by score, ties by smaller identifier;
    the negatives of a positive the first ``negatives`` rows of other labels whose
    score s satisfies low * p <= 100 * s <= high * p, p the positive's score.

    Rows with a null identifier, label or vector, or a null or non-finite component,
    take no part. Shorter vectors are filled up with zeros. An identifier may
    repeat: such rows are rows of their own among candidates, none is a positive of
    an anchor of the same identifier, and anchors that differ in label or vector are
    answered each. Components beyond what scores of 56 bits allow raise. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = session(df)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
                     F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    gnat = build(spark, rows.withColumn("v", integers(F.col("v"), scale)), **index)
    if gnat is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    key = ["anchor_id", "label", "q"]
    anchors = (gnat.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "q", F.col("leaf").alias("own"))
               .distinct().checkpoint())
    # Any score: the window of positives before one is known.
    asks = anchors.select("*", F.array(F.lit(-(2 ** 62))).alias("lows"), F.array(F.lit(2 ** 62)).alias("highs"))
    some = _first(gnat.ask(asks, True, True, positives), positives).checkpoint()
    rest = gnat.ask(_narrowed(asks, some, positives), False, True, positives)
    best = _first(some.drop("rank").unionByName(rest), positives).select(*key, F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"),
                                                                         F.col("score").alias("positive_score")).checkpoint()
    # Window w is the positive of place w + 1; a window may hold no score at all.
    bounds = (-_hundredth(-F.col("positive_score") * low)).alias("low"), _hundredth(F.col("positive_score") * high).alias("high")
    asks = (best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("p", *bounds))).alias("w"))
            .select(*key, F.col("w.low").alias("lows"), F.col("w.high").alias("highs")).join(anchors, key)
            .select("anchor_id", "label", "q", "own", "lows", "highs").checkpoint())
    some = _first(gnat.ask(asks, True, False, negatives), negatives).checkpoint()
    rest = gnat.ask(_narrowed(asks, some, negatives), False, False, negatives)
    found = _first(some.drop("rank").unionByName(rest), negatives).withColumn("p", F.col("win") + 1)
    return found.join(best, [*key, "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                                F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
