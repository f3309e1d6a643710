"""SentencePiece encoding and decoding with the N best segmentations.

A text's pieces form a lattice; a segmentation's score is the sum of its pieces'
scores. Forward Viterbi gives the best score of every prefix, which is an exact
heuristic for a backward A-star search: what a partial segmentation loses against
the best one is final, so segmentations leave the agenda in order of their scores.

No piece reaches over some places of a text: between a character and a blank, or
between two characters that follow each other in no piece. The lattice falls into
parts there, whose N best lists are searched one by one, kept in bounded caches of
the worker, and put together by a second search of the same kind.

Scores are the model's piece scores. For a model of type BPE these are merge ranks,
and its N best by score need not hold the merge-by-merge result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib
from bisect import insort
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import kept, release, session, text_of

BLANK = "▁"
N_BEST = 4
PENALTY = 10.0
#: Entries of a generation of the cache; a worker needs some 0.7 KB for each (two generations).
CACHE = 100_000
#: Longer parts are not kept.
LONGEST = 48
#: Characters of a text that is split at once.
STEP = 1_000_000

#: Parts of a text that is escaped: blanks with what follows them.
_PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

Path = tuple[float, tuple[int, ...]]


class Pieces:
    """Lattice search over the pieces of a model file."""

    def __init__(self, path: str, n_best: int = N_BEST, limit: int = CACHE):
        import sentencepiece

        if n_best < 1:
            raise ValueError("n_best is 1 or more")
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, self.bytes_of, self.byte_id = {}, [], {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                normal[piece] = (i, sp.get_score(i))
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        #: Pieces as a tree of characters: (what may follow or None, id, score), id -1 for what only begins a piece.
        self.table = normal
        self.tree = _tree(normal)
        self.unknown = sp.unk_id()
        self.lost = min(s for _, s in normal.values()) - PENALTY
        self.reach = max(map(len, normal))
        self.inside = {p[k:k + 2] for p in normal for k in range(len(p) - 1)}
        #: Whether a blank that follows another character always begins a part.
        self.blanks_cut = not any(b[1] == BLANK != b[0] for b in self.inside)
        probe = "  a  b\tc  "
        self.plain = sp.normalize(probe) == BLANK + probe.replace(" ", BLANK)
        self.n_best, self.limit = n_best, limit
        # Two generations: what the younger has met again outlives the older.
        self.parts: dict[str, tuple] = {}
        self.old_parts: dict[str, tuple] = {}
        self.lists_of: dict[str, list[Path]] = {}

    def escaped(self, text: str) -> str:
        if not text:
            return ""
        return BLANK + text.replace(" ", BLANK) if self.plain else self.library.normalize(text)

    def split(self, text: str) -> Iterator[str]:
        """The parts of an escaped text, in order."""
        if not self.blanks_cut:
            return iter([text] if text else [])
        return (m.group() for m in _PARTS.finditer(text))

    def parts_of(self, text: str) -> Iterator[list[str]]:
        """The parts of a text in lists of bounded size."""
        if self.plain and self.blanks_cut and 0 < len(text) <= STEP and "  " not in text and BLANK not in text and " " not in (text[0], text[-1]):
            yield (BLANK + text.replace(" ", " " + BLANK)).split(" ")
            return
        parts = self.split(self.escaped(text))
        while block := list(islice(parts, STEP // 10)):
            yield block

    def unknown_ids(self, char: str) -> tuple[int, ...]:
        data = char.encode()
        return tuple(self.byte_id[b] for b in data) if all(b in self.byte_id for b in data) else (self.unknown,)

    def lattice(self, text: str) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
        """Forward Viterbi: the best score up to each place, and per place the steps (score, begin, id) that end there."""
        n = len(text)
        best = [0.0] + [-math.inf] * n
        edges: list[list[tuple[float, int, int]]] = [[] for _ in best]
        for begin in range(n):
            base, after, node, end = best[begin], begin + 1, self.tree, begin
            while node and end < n:
                found = node.get(text[end])
                if found is None:
                    break
                end += 1
                node, i, gain = found
                if i >= 0:
                    score = base + gain
                    edges[end].append((score, begin, i))
                    if score > best[end]:
                        best[end] = score
            if not edges[after] or edges[after][-1][1] != begin:
                score = base + self.lost
                edges[after].append((score, begin, -1))
                if score > best[after]:
                    best[after] = score
        return best, edges

    def best(self, text: str) -> tuple[list[int], float, float]:
        """(ids, score, loss of the second best way, infinite if there is none) of a lattice.

        The second best way leaves the best one at one place and is best before that.
        """
        n = len(text)
        best, second = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        tree = self.tree
        for begin in range(n):
            base, end, node, single = best[begin], begin, tree, False
            for char in text[begin:begin + self.reach]:
                found = node.get(char)
                if found is None:
                    break
                end += 1
                node, i, gain = found
                if i >= 0:
                    single = single or end == begin + 1
                    score = base + gain
                    if score > best[end]:
                        second[end], best[end], back[end] = best[end], score, (begin, i)
                    elif score > second[end]:
                        second[end] = score
                if node is None:
                    break
            if not single:
                score, end = base + self.lost, begin + 1
                if score > best[end]:
                    second[end], best[end], back[end] = best[end], score, (begin, -1)
                elif score > second[end]:
                    second[end] = score
        end, ids, least = n, [], math.inf
        while end:
            loss = best[end] - second[end]
            if loss < least:
                least = loss
            begin, i = back[end]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.unknown_ids(text[end - 1])[::-1])
            end = begin
        return ids[::-1], best[-1], least

    def search(self, text: str) -> list[Path]:
        """The N best (score, ids) of a lattice, by score.

        Equal scores leave the agenda in the order in which they were met, longer last pieces first.
        """
        many = self.n_best
        best, edges = self.lattice(text)
        # An entry stands for the best way that ends with its tail. What it loses is known exactly, so of the
        # steps back from its place the one without loss is taken at once and the others become entries.
        agenda: list[tuple] = [(0.0, 0, len(text), ())]
        near = [0.0]  # the N smallest losses met
        out, order = [], 0
        while agenda and len(out) < many:
            loss, _, end, tail = heapq.heappop(agenda)
            while end:
                top, step = best[end], None
                for score, begin, i in edges[end]:
                    if step is None and score == top:
                        step = begin, i
                        continue
                    total = loss + (top - score)
                    if len(near) < many or total < near[-1]:
                        insort(near, total)
                        del near[many:]
                        order += 1
                        heapq.heappush(agenda, (total, order, begin, (i, end, tail)))
                tail = step[1], end, tail
                end = step[0]
            ids: list[int] = []
            while tail:
                ids.extend(self.unknown_ids(text[tail[1] - 1]) if tail[0] < 0 else (tail[0],))
                tail = tail[2]
            out.append((best[-1] - loss, tuple(ids)))
        return out

    def lists(self, text: str) -> Iterator[str]:
        """A part's own parts: cut where no piece holds both neighbours."""
        a = 0
        for k in range(1, len(text)):
            if text[k - 1:k + 1] not in self.inside:
                yield text[a:k]
                a = k
        yield text[a:]

    def part(self, text: str) -> tuple[bytes, int, float, float, bytes]:
        """(best ids as bytes, their number, score, loss of the second best way, the ids decoded)."""
        found = self.parts.get(text)
        if found is not None:
            return found
        found = self.old_parts.get(text)
        if found is None:
            ids, score, least = self.best(text)
            found = struct.pack(f"<{len(ids)}I", *ids), len(ids), score, least, b"".join([self.bytes_of[i] for i in ids])
        if len(text) <= LONGEST:
            if len(self.parts) >= self.limit:
                self.parts, self.old_parts = {}, self.parts
            self.parts[text] = found
        return found

    def ways(self, text: str) -> list[Path]:
        """The N best (score, ids) of a part."""
        found = self.lists_of.get(text)
        if found is None:
            found = combine([self.search(x) for x in self.lists(text)], self.n_best)
            if len(text) <= LONGEST:
                if len(self.lists_of) >= self.limit // 10:
                    self.lists_of.clear()
                self.lists_of[text] = found
        return found

    def encode(self, text: str) -> list[Path]:
        """The N best segmentations of a whole text with their ids, best first; an empty text has one, without pieces."""
        lists = [self.search(x) for p in self.split(self.escaped(text)) for x in self.lists(p)]
        return combine(lists, self.n_best)

    def decode(self, ids: list[int]) -> str:
        """The text of pieces: blanks back, the first one dropped, bytes put together (invalid ones replaced)."""
        data = b"".join([self.bytes_of[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _tree(pieces: dict[str, tuple[int, float]]) -> dict:
    """Nested (children or None, id, score) by character; id -1 for what only begins a piece."""
    tree: dict = {}
    for piece in sorted(pieces, key=len, reverse=True):
        node = tree
        for char in piece[:-1]:
            found = node.get(char)
            if found is None:
                found = node[char] = ({}, -1, 0.0)
            node = found[0]
        below = node.get(piece[-1])
        node[piece[-1]] = (below[0] if below else None, *pieces[piece])
    return tree


def combine(lists: list[list[Path]], n: int) -> list[Path]:
    """The n best concatenations, one path of each list; lists are sorted and not empty.

    Only the n-1 lists of the smallest first loss can differ from their best path:
    with any other list, n ways that lose no more are known.
    """
    if not lists:
        return [(0.0, ())]
    base = math.fsum(x[0][0] for x in lists)
    open_ = sorted(heapq.nsmallest(n - 1, (k for k, x in enumerate(lists) if len(x) > 1), key=lambda k: lists[k][0][0] - lists[k][1][0]))
    out = []
    for loss, picks in cheapest([[lists[k][0][0] - s for s, _ in lists[k]] for k in open_], n):
        chosen = dict(zip(open_, picks))
        out.append((base - loss, tuple(i for k, x in enumerate(lists) for i in x[chosen.get(k, 0)][1])))
    return out


def cheapest(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest choices of one entry per list; every list begins with 0 and rises."""
    start = (0,) * len(losses)
    agenda, seen, out = [(0.0, start)], {start}, []
    while agenda and len(out) < n:
        loss, picks = heapq.heappop(agenda)
        out.append((loss, picks))
        for k, p in enumerate(picks):
            if p + 1 < len(losses[k]):
                more = picks[:k] + (p + 1,) + picks[k + 1:]
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(agenda, (loss - losses[k][p] + losses[k][p + 1], more))
    return out


def _nearest(losses: list[list[float]], n: int) -> list[list[float]]:
    """The n lists of the smallest second entries, as only they can be in the n+1 cheapest choices."""
    return heapq.nsmallest(n, (x for x in losses if len(x) > 1), key=itemgetter(1))


def summary(pieces: Pieces, text: str) -> tuple[int, list[float], int, str, bytes, list[bytes]]:
    """(number of ids, N best scores, CRC-32 of the best ids, SHA-256 of their text, id bytes, id bytes of all N) of a whole text."""
    count, score, crc, near, kept = 0, 0.0, 0, [], []
    text_sum = hashlib.sha256()
    first, others = True, pieces.n_best - 1
    for block in pieces.parts_of(text):
        if not block:
            continue
        found = list(map(pieces.parts.get, block))
        if None in found:
            found = [f or pieces.part(p) for f, p in zip(found, block)]
        packed, sizes, gains, least, decoded = zip(*found)
        ids = b"".join(packed)
        crc = zlib.crc32(ids, crc)
        kept.append(ids)
        score += math.fsum(gains)
        # (loss, place of the part's ids, their number, the part)
        near += [(least[k], count + sum(sizes[:k]), sizes[k], block[k])
                 for k in np.argsort(np.array(least), kind="stable")[:others].tolist()]
        near = heapq.nsmallest(others, near, key=itemgetter(0))
        count += sum(sizes)
        data = b"".join(decoded)
        text_sum.update(data[1:] if first and data[:1] == b" " else data)
        first = False
    whole = b"".join(kept)
    open_ = [(at, size, pieces.ways(part)) for loss, at, size, part in near if loss < math.inf]
    scores, paths = [], []
    for loss, picks in cheapest([[w[0][0] - x for x, _ in w] for _, _, w in open_], pieces.n_best):
        scores.append(score - loss)
        out, done = [], 0
        for at, size, ids in sorted((at, size, w[k][1]) for (at, size, w), k in zip(open_, picks) if k):
            out += whole[4 * done:4 * at], struct.pack(f"<{len(ids)}I", *ids)
            done = at + size
        paths.append(b"".join([*out, whole[4 * done:]]))
    return count, scores, crc, text_sum.hexdigest(), whole, paths


#: Kept by a worker from task to task, with their caches.
_OPEN: dict[tuple[str, int, int], Pieces] = kept("pieces")


def opened(path: str, n_best: int, cache: int = CACHE) -> Pieces:
    release("pieces")
    key = path, n_best, cache
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Pieces(path, n_best, cache)
    return _OPEN[key]


def _run(path: str, n_best: int, with_ids: bool, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = opened(path, n_best, cache)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = []
                for text in part.column(1).to_pylist():
                    n, scores, crc, decoded, ids, paths = summary(pieces, text)
                    data = text.encode()
                    row = {"n_bytes": len(data), "n_pieces": n, "score": scores[0], "n_best": len(scores), "scores": scores,
                           "ids_crc32": crc, "decoded_sha256": decoded,
                           "round_trip": hashlib.sha256(data).hexdigest() == decoded,
                           "segmentations": [
                               {"score": x, "n_pieces": len(p) // 4, "ids_crc32": zlib.crc32(p)}
                               | ({"ids": np.frombuffer(p, "<u4").astype(np.int32)} if with_ids else {}) for x, p in zip(scores, paths)]}
                    rows.append(row | ({"ids": np.frombuffer(ids, "<u4").astype(np.int32)} if with_ids else {}))
                table = pa.Table.from_pylist(rows, _schema(with_ids)) if rows else None
                if table is not None:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
                                                                        for c in table.columns)], ["doc_id", *table.column_names])
    return run


def _schema(with_ids: bool) -> pa.Schema:
    fields = [("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("score", pa.float64()), ("n_best", pa.int32()),
              ("scores", pa.list_(pa.float64())), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    each = [("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    fields.append(("segmentations", pa.list_(pa.struct(each))))
    return pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))


ROW = ("doc_id long, n_bytes long, n_pieces long, score double, n_best int, scores array<double>, ids_crc32 long, "
       "decoded_sha256 string, round_trip boolean, segmentations array<struct<score: double, n_pieces: long, ids_crc32: long{}>>")


def encode_documents(df: DataFrame, path: str, n_best: int = N_BEST, with_ids: bool = False, id_col: str = "doc_id",
                     text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """One row per document with its N best segmentations, and the best one decoded again.

    Columns: doc_id, n_bytes, n_pieces, score, n_best, scores, ids_crc32 (of the best
    ids as little-endian unsigned 32-bit integers), decoded_sha256, round_trip,
    segmentations (one struct for each of the N: score, n_pieces, ids_crc32, and ids if
    asked for), and the best ids if asked for. Null counts as empty: no pieces, score 0. A text with the blank
    sign itself does not come back as it was. ``cache`` trades a worker's memory for
    time and changes no result. Repeated rows are encoded each on its
    own; other columns are ignored.
    """
    session(df)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_run(path, n_best, with_ids, cache), ROW.format(", ids: array<int>") + ", ids array<int>" if with_ids else ROW.format(""))


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids; null counts as no pieces, null and unknown ids raise."""
    session(df)

    def run(batches):
        pieces = opened(path, 1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(i or []) for i in batch.column(1).to_pylist()],
                                                                        pa.string())], ["doc_id", "text"])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
