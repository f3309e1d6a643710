"""Substring dedup by level-wise doubling of repeated windows.

Documents are dealt into blocks by identifier. A block hashes the windows of the
first length (``window / 4``, 5 words of 20), drops its own repeats and asks, per
hash shard, which hashes other blocks hold too. Only windows that lie in a long
enough run of repeated ones are extended to twice the length and asked again,
until the full length is reached or none survives. The last question also carries
the document of the block's first occurrence, and the shard answers whether some
block has an earlier one. Blocks then strike the words their later windows cover.

A block asks once per distinct hash, so a passage in a third of all documents
gives a shard one entry per block; answers are one bit per question. Texts are
shuffled once, all passes read that exchange. Short hashes only ever add
candidates; the last length compares 80 bits of two independent hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import session, shuffle_partitions, text_of
from roadspeed.llm.words import SPACED, U64, buffers, chunks, grams, words

WINDOW = 20
ASK = "block int, shard int, hashes binary, owners binary"
TOLD = "block int, level int, shard int, bits binary"
LAST = np.iinfo(np.int64).max


def lengths_of(window: int) -> list[int]:
    """Window lengths of the levels: halves of the window, rounded up, down to 4 words or more (2 at least)."""
    if window < 2:
        raise ValueError("a window has two words or more")
    out = [window]
    while (out[-1] + 1) // 2 >= min(4, window - 1) and len(out) < 3 and out[-1] > 2:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


class Block:
    """The documents of one block in identifier order, with their word hashes."""

    def __init__(self, table: pa.Table, both: bool):
        ids = pc.fill_null(table["doc_id"], LAST)
        order = pc.sort_indices(pa.table({"i": ids, "t": table["text"]}), [("i", "ascending"), ("t", "ascending")])
        self.rows = table.take(order)
        self.ids = np.asarray(pc.fill_null(self.rows["doc_id"], LAST)).astype(np.int64)
        self.data, self.offsets = buffers(self.rows["text"])
        parts, seconds, self.start, self.stop, ends = [np.zeros(0, U64)], [np.zeros(0, U64)], [], [], []
        total = 0
        for i, j in chunks(self.offsets):
            d, o = self.data[self.offsets[i]:self.offsets[j]], self.offsets[i:j + 1] - self.offsets[i]
            w = words(d, o, SPACED)
            parts.append(w.hash)
            if both:
                seconds.append(words(d, o, SPACED, 1).hash)
            self.start.append(w.start + self.offsets[i])
            self.stop.append(w.stop + self.offsets[i])
            ends.append(w.ends + total)
            total += len(w.hash)
        self.hash, self.second = np.concatenate(parts), np.concatenate(seconds)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.left = np.repeat(self.ends, self.sizes) - np.arange(total)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, "right")]


def _cuts(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted hashes begins."""
    return np.searchsorted((h >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1, dtype=U64), "left")


def _unpack(cuts: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """One flag per question from the shards' answers."""
    out = np.zeros(cuts[-1], bool)
    for shard, b in bits.items():
        a, z = cuts[shard], cuts[shard + 1]
        out[a:z] = np.unpackbits(np.frombuffer(b, np.uint8), count=z - a)
    return out


def _distinct(block: Block, at: np.ndarray, length: int, exact: bool):
    """(hash, second hash, first position, which of them per candidate, how often) of the windows at ``at``."""
    h = grams(block.hash, length)[at]
    if not exact:
        u, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        return u, None, at[first], back, n
    g = grams(block.second, length)[at]
    order = np.lexsort((at, g, h))
    hs, gs = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return hs[new], gs[new], at[order][new], back, np.bincount(back, minlength=int(new.sum()))


def survivors(block: Block, window: int, shards: int, answers: dict[int, dict[int, bytes]], level: int):
    """The candidates of a level: positions, and their distinct windows as ``_distinct`` gives them."""
    lengths = lengths_of(window)
    at = np.flatnonzero(block.left >= lengths[0])
    for k in range(level + 1):
        found = _distinct(block, at, lengths[k], k == len(lengths) - 1)
        if k == level:
            return at, found
        u, _, _, back, n = found
        repeated = np.zeros(len(block.hash) + 1, bool)
        repeated[at] = ((n > 1) | _unpack(_cuts(u, shards), answers.get(k, {})))[back]
        # A repeated window of full length has only repeated ones in it: keep long runs, and of these what can grow.
        edge = np.flatnonzero(np.diff(repeated.astype(np.int8), prepend=0))
        begin, end = edge[0::2], edge[1::2]
        long = end - begin >= window - lengths[k] + 1
        begin, end = begin[long], end[long] - (lengths[k + 1] - lengths[k])
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _short(h: np.ndarray) -> np.ndarray:
    """The low 5 bytes of each hash; the shard implies more."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]


def _read(b: bytes, width: int = 5) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(U64).ravel()


def _ask(window: int, shards: int, level: int):
    last = level == len(lengths_of(window)) - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, last)
        _, (u, second, first, _, _) = survivors(block, window, shards, _answers(right), level)
        cuts = _cuts(u, shards).tolist()
        owners = block.owners(first) if last else None
        rows = [(s, a, z) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
        # Bytes of equal weight together: the high ones are alike and compress.
        return pa.table({
            "block": pa.array([left["block"][0].as_py()] * len(rows), pa.int32()),
            "shard": pa.array([s for s, _, _ in rows], pa.int32()),
            "hashes": pa.array([_short(u[a:z]).tobytes() + (_short(second[a:z]).tobytes() if last else b"")
                                for _, a, z in rows], pa.binary()),
            "owners": pa.array([np.ascontiguousarray(owners[a:z].view(np.uint8).reshape(-1, 8).T).tobytes() if last else None
                                for _, a, z in rows], pa.binary())})

    def first(left: pa.Table) -> pa.Table:
        return run(left, pa.table({c: [] for c in ("level", "shard", "bits")}))
    return run if level else first


def _answers(right: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, shard, bits in zip(*(right[c].to_pylist() for c in ("level", "shard", "bits"))):
        out.setdefault(level, {})[shard] = bits
    return out


def _tell(level: int, last: bool):
    """Task function of a shard: per question one bit, repeated (or, at the last level, not the first)."""
    def run(asked: pa.Table) -> pa.Table:
        lists = asked["hashes"].to_pylist()
        if last:
            n = [len(b) // 10 for b in lists]
            h = np.concatenate([_read(b[:5 * k]) for b, k in zip(lists, n)])
            g = np.concatenate([_read(b[5 * k:]) for b, k in zip(lists, n)])
            owner = np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
                                    for b in asked["owners"].to_pylist()])
            order = np.lexsort((owner, g, h))
            same = np.zeros(len(h), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
            flag = np.empty(len(h), bool)
            flag[order] = same
        else:
            n = [len(b) // 5 for b in lists]
            h = np.concatenate([_read(b) for b in lists])
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            flag = np.empty(len(h), bool)
            flag[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        ends = np.cumsum(n).tolist()
        return pa.table({"block": asked["block"], "level": pa.array([level] * len(n), pa.int32()), "shard": asked["shard"],
                         "bits": pa.array([np.packbits(flag[z - k:z]).tobytes() for z, k in zip(ends, n)], pa.binary())})
    return run


def _strike(window: int, shards: int, texts: bool):
    """Task function: the block's documents without the words that later windows cover."""
    lengths = lengths_of(window)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, answers = Block(left, True), _answers(right)
        n = len(block.hash)
        at, (u, _, first, back, _) = survivors(block, window, shards, answers, len(lengths) - 1)
        late = _unpack(_cuts(u, shards), answers.get(len(lengths) - 1, {}))
        gone = at[(first[back] != at) | late[back]]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, np.minimum(gone + window, n), -1)
        keep = np.cumsum(cover)[:n] == 0
        kept = np.diff(np.concatenate(([0], np.cumsum(keep)))[block.ends], prepend=0)
        data, ends = _joined(block, keep, kept)
        cuts = np.concatenate(([0], ends)).tolist()
        view = memoryview(data)
        sums = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        out = {"doc_id": block.rows["doc_id"], "n_words": pa.array(block.sizes), "n_removed": pa.array(block.sizes - kept),
               "kept_sha256": pa.array(sums, pa.string())}
        if texts:
            out["kept_text"] = pa.array([bytes(view[a:b]).decode() for a, b in zip(cuts, cuts[1:])], pa.string())
        return pa.table(out)
    return run


def _joined(block: Block, keep: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each document joined by one space: (bytes, ends)."""
    start = np.concatenate([*block.start, np.zeros(0, np.int64)])[keep]
    stop = np.concatenate([*block.stop, np.zeros(0, np.int64)])[keep]
    ends = np.cumsum(kept)
    # A space goes to the byte after a word, which is a gap if another word of the text follows.
    spaced = np.ones(len(start), bool)
    spaced[ends[kept > 0] - 1] = False
    mark = np.zeros(len(block.data) + 1, np.int8)
    mark[start] = 1
    mark[stop] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    data = np.where(inside, block.data, np.uint8(0x20))
    inside[stop[spaced]] = True
    size = np.concatenate(([0], np.cumsum(stop - start + spaced)))
    return data[inside], size[ends]


def substring_dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                    texts: bool = False, blocks: int | None = None, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text if ``texts``).

    Words are runs of anything but space and the controls 9 to 13. A word goes if a
    ``window`` of words covers it whose words also start earlier: in a document
    with a smaller identifier, or earlier in the same one. Windows are judged on the
    input. Null texts have no words; null identifiers come after all others; rows
    that repeat an identifier count as one after the other, by text. Other columns
    are ignored.
    """
    spark = session(df)
    parts = shuffle_partitions(spark)
    blocks, shards = blocks or 2 * parts, shards or max(1, parts // 2)
    docs = df.select(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(blocks)).cast("int").alias("block"),
                     F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).groupBy("block")
    depth = len(lengths_of(window))
    told: DataFrame | None = None
    for level in range(depth):
        asked = (docs.applyInArrow(_ask(window, shards, level), ASK) if told is None else
                 docs.cogroup(told.groupBy("block")).applyInArrow(_ask(window, shards, level), ASK))
        more = asked.groupBy("shard").applyInArrow(_tell(level, level == depth - 1), TOLD).repartition(parts, "block")
        told = more if told is None else told.unionAll(more)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return docs.cogroup(told.groupBy("block")).applyInArrow(_strike(window, shards, texts), schema)
