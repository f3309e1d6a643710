"""Secret scan: rules for keys and tokens, and the guess cost of values in a credential's context.

A value that stands behind a word such as `password`, `pwd` or `bearer` may be a
secret or plain prose. Its guess cost tells: dynamic programming cuts the value into
spans of the smallest total cost in bits, where a span is a word (by its rank in the
corpus, with capitals and digits for letters), a date, a repeat, a walk over a
keyboard, or is guessed character by character. Values of a high cost are reported.

The words and their ranks come from the documents themselves, in all their languages.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import session, text_of
from roadspeed.llm.spelling import word_counts

#: The rules of the base, leftmost and not overlapping for each kind, and the least length of a match.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Kinds in the order of a result; the last is the method's.
KINDS = ("assign", "access", "hex", "guess")

#: A word that announces a credential, a sign or `is`, and the value.
CONTEXT = re.compile(r"""(?ai)(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|login|bearer|pin"""
                     r"""|authorization|(?:api|access|private|client|auth|secret|signing)[_-]?(?:key|token|secret))"""
                     r"""["']?[ \t]*(?:=>|:=|[:=]|[ \t]is[ \t]|(?<=bearer)[ \t])[ \t]*["'`]?(?:(?:bearer|basic)[ \t]+)?([^\s"'`<>]+)""")
#: One of these is in every text that the rules or the contexts can match.
_MARKS = ("pass", "pwd", "secret", "token", "credential", "login", "bearer", "pin", "authorization", "key")
_LEAST_VALUE = 6
#: Bits from which a value is a secret: about 10^12 guesses.
BITS = 40.0
#: Words of the dictionary, those that occur most.
DICTIONARY = 50_000

#: What the choice of a span's kind costs.
SPAN_BITS = math.log2(5)
_LONGEST_WORD, _LONGEST_UNIT = 24, 8
#: A repeat or walk gives up at most so many of its last characters to the span behind it.
_GIVE = 64
_PLAIN = str.maketrans("4@310!5$7", "aaeioisst")
_DATE = re.compile(r"(?a)(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)")
_YEAR = re.compile(r"(?a)(?:19|20)\d\d")
DATE_BITS, YEAR_BITS = math.log2(200 * 365), math.log2(200)
#: Rows of keys with their offset; neighbours are at most one key apart.
_ROWS = (("1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
_PLACE = {c: (off + k, y) for y, (row, off) in enumerate(_ROWS) for k, c in enumerate(row)}
_SHIFTED = str.maketrans("!@#$%^&*()_+{}:\"<>?", "1234567890-=[];',./")
WALK_BITS, TURN_BITS = math.log2(len(_PLACE)), math.log2(6)


def char_bits(c: str) -> float:
    """Bits of one character guessed on its own: the size of its class."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 7.0


def word_bits(text: str, ranks: dict[str, int]) -> float | None:
    """Bits of a text as a word: its rank, and a bit or more for capitals and for signs in place of letters."""
    low = text.lower()
    rank, swapped = ranks.get(low), 0
    if rank is None:
        plain = low.translate(_PLAIN)
        rank = ranks.get(plain) if plain != low else None
        if rank is None:
            return None
        swapped = sum(a != b for a, b in zip(low, plain))
    upper = sum(c.isupper() for c in text)
    caps = 0.0 if not upper else 1.0 if upper == len(text) or (upper == 1 and text[0].isupper()) else 1.0 + math.log2(math.comb(len(text), upper))
    return math.log2(rank + 1) + caps + swapped


def _steps(text: str) -> list[tuple | None]:
    """The direction from each character's key to the next one's, None if they are no neighbours or the same."""
    at = [_PLACE.get(c) for c in text.lower().translate(_SHIFTED)] if len(text.lower()) == len(text) else [_PLACE.get(c) for c in text]
    out: list[tuple | None] = []
    for a, b in zip(at, at[1:]):
        near = a is not None and b is not None and a != b and abs(a[1] - b[1]) <= 1 and abs(a[0] - b[0]) <= 1
        out.append(((b[0] > a[0]) - (b[0] < a[0]), b[1] - a[1]) if near else None)
    return out


def guess_bits(text: str, ranks: dict[str, int]) -> float:
    """The smallest total cost of spans that make up the text; time grows in proportion to its length."""
    n = len(text)
    chars = list(accumulate(map(char_bits, text), initial=0.0))
    best, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)  # brute: the last span is guessed by characters
    best[0] = 0.0
    steps = _steps(text)
    walk_end, turns = [0] * n, [0] * n
    for i in range(n - 2, -1, -1):
        if steps[i] is not None:
            on = i + 1 < len(steps) and steps[i + 1] is not None
            walk_end[i] = walk_end[i + 1] if on else i + 2
            turns[i] = turns[i + 1] + (steps[i] != steps[i + 1]) if on else 0
    same = [[0] * (n + 1) for _ in range(_LONGEST_UNIT + 1)]
    for p in range(1, _LONGEST_UNIT + 1):
        row = same[p]
        for i in range(n - p - 1, -1, -1):
            row[i] = row[i + 1] + 1 if text[i] == text[i + p] else 0

    def take(j: int, bits: float) -> None:
        if bits < best[j]:
            best[j] = bits
    for i in range(n):
        if brute[i] < best[i]:
            best[i] = brute[i]
        brute[i + 1] = min(best[i] + SPAN_BITS, brute[i]) + (chars[i + 1] - chars[i])
        start = best[i] + SPAN_BITS
        for j in range(i + 3, min(n, i + _LONGEST_WORD) + 1):
            bits = word_bits(text[i:j], ranks)
            if bits is not None:
                take(j, start + bits)
        date = _DATE.match(text, i)
        if date:
            take(date.end(), start + DATE_BITS + (2.0 if any(date.groups()) else 0.0))
        if _YEAR.match(text, i):
            take(i + 4, start + YEAR_BITS)
        for p in range(1, _LONGEST_UNIT + 1):
            most = same[p][i] // p + 1
            for times in range(max(3 if p == 1 else 2, most - _GIVE), most + 1):
                take(i + p * times, start + chars[i + p] - chars[i] + math.log2(times))
        if walk_end[i] >= i + 3:
            end = walk_end[i]
            for j in range(max(i + 3, end - _GIVE), end + 1):
                take(j, start + WALK_BITS + math.log2(j - i) + TURN_BITS * (turns[i] - (turns[j - 2] if j - 2 < n else 0)))
    return min(best[n], brute[n])


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules' whole matches in code points, by start."""
    out = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _may_hold_hex(text):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


_IS_HEX = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


def _may_hold_hex(text: str) -> bool:
    return b"x" * HEX_LEAST in text.encode().translate(_IS_HEX)


def guessed_spans(text: str, ranks: dict[str, int], bits: float, base: list[tuple[int, str, int]]) -> Iterator[tuple[int, str, int, float]]:
    """(start, kind, end, bits) of values in a credential's context that cost much and touch no span of the base."""
    low = text.lower()
    if not any(k in low for k in _MARKS):
        return
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    for m in CONTEXT.finditer(text):
        a, value = m.start(1), m.group(1).rstrip(".,;:!?)]}")
        b = a + len(value)
        before = bisect_left(starts, b)
        if len(value) >= _LEAST_VALUE and not (before and reach[before - 1] > a):
            cost = guess_bits(value, ranks)
            if cost >= bits:
                yield a, "guess", b, cost


def dictionary(docs: DataFrame, size: int = DICTIONARY, text_col: str = "text") -> DataFrame:
    """(word, n): words of three or more letters that occur more than some number of times in all texts, the
    smallest number that leaves at most ``size`` of them.

    The numbers of occurrences are told apart exactly up to 4096 and in 64 steps per
    doubling beyond, so a few thousand counts decide and no list of candidates is
    gathered.
    """
    counted = word_counts(docs.withColumn("_none", F.lit(None).cast("long")), "_none", text_col, min_length=3, min_count=2, noise=0)
    n = F.col("n")
    counted = counted.withColumn("step", F.when(n <= 4096, n).otherwise(4096 + F.floor((F.log2(n.cast("double")) - 12) * 64)).cast("long")).checkpoint()
    steps = sorted(((r.step, r["count"]) for r in counted.groupBy("step").count().collect()), reverse=True)
    above = 2 ** 62
    for step, words in steps:
        size -= words
        if size < 0:
            break
        above = step
    return counted.where(F.col("step") >= above).select("word", "n")


ROW = "doc_id long, spans array<struct<kind: string, start: int, end: int, bits: double>>"


def _scan(shared, bits: float):
    def run(batches):
        ranks = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = []
                for text in part.column(1).to_pylist():
                    base = base_spans(text)
                    spans = [(s, k, e, None) for s, k, e in base] + list(guessed_spans(text, ranks, bits, base))
                    rows.append([{"kind": k, "start": s, "end": e, "bits": x}
                                 for s, k, e, x in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])
    return run


def find_secrets(docs: DataFrame, bits: float = BITS, dictionary_size: int = DICTIONARY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, structs of kind, start, end (code points, end exclusive) and bits.

    Kinds assign, access and hex are the rules' whole matches; guess is a value behind
    a credential's word that takes ``bits`` bits or more to guess and touches none of
    them. Spans are ordered by start, then kind as listed. Null and empty texts have no
    spans; repeated rows are scanned each on its own; an empty table gives no rows;
    other columns are ignored. The dictionary that is sent to all tasks has at most
    ``dictionary_size`` words.
    """
    spark = session(docs)
    ordered = sorted(dictionary(docs, dictionary_size, text_col).collect(), key=lambda r: (-r.n, r.word))
    ranks = {r.word: k for k, r in enumerate(ordered, 1)}
    shared = spark.sparkContext.broadcast(ranks)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(_scan(shared, bits), ROW))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all as text) from ``find_secrets``."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *map(number, KINDS[:3]),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
