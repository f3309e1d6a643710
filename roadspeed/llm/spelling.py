"""Spelling variants: words of a corpus that are one edit apart, by PartEnum signatures.

A word's letters form a multiset, read as a binary vector with one place for each
letter and occurrence. One inserted or deleted letter changes one place, one
replaced letter two, so words that are near lie within Hamming distance two.

PartEnum finds all such pairs by equality: the places are dealt into ``parts`` sets
of about the same weight, letter by letter. Two differing places touch at most two
sets, so two near vectors agree on some choice of ``parts - 2`` sets. Each choice
gives one signature, the hash of the letters in it. Words of few letters would share
them in large groups (anagrams, compounds of the same syllables), so a signature also
holds the pair's length and one half of the word: an edit leaves the other half as it
is. Signatures are joined, and the pairs are verified by edit distance.

A chain of forms doubles its number of occurrences with every step, so roots are
found by pointer doubling in a number of rounds known beforehand.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import session, text_of
from roadspeed.llm.words import buffers

MIN_LENGTH = 5
MIN_COUNT = 3
#: A form occurs this many times as often as its variant, at least.
RATIO = 2
#: Of so many occurrences of a run, told by a checksum, one loses a character; 0 for none.
NOISE = 97
#: Sets of letters; a signature covers all but two of them.
PARTS = 4
#: Words that a task counts before it hands them on.
TALLY = 200_000

#: Bytes of runs of A-Z, a-z and U+00C0 to U+00FF in lower case; anything else is a gap.
_RUNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b == 0xC3 or 0x80 <= b <= 0xBF else 0x20 for b in range(256))
#: Characters of other first bytes, whose later bytes are no letters.
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")


def runs(data: bytes) -> list[bytes]:
    """Maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of a text in UTF-8, A-Z in lower case."""
    if not data.isascii():
        data = _OTHER.sub(b" ", data)
    return data.translate(_RUNS).split()


def changed(prefix: int, run: bytes, noise: int) -> bytes:
    """The run, less one character if the checksum of identifier and run says so."""
    h = zlib.crc32(run, prefix)
    if not noise or h % noise:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def _tally(noise: int, shortest: int):
    """Task function: (word, n) of the partition; a word may be handed on several times."""
    def rows(known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        some = list(known.items())
        for a in range(0, len(some), 1 << 16):
            part = some[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part], pa.string()),
                                              pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    def run(batches):
        known: dict[bytes, int] = {}
        get = known.get
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for own, n in Counter(runs(data[offsets[k]:offsets[k + 1]].tobytes())).items():
                    word = changed(prefix, own, noise)
                    if len(word) - word.count(b"\xc3") >= shortest:
                        known[word] = get(word, 0) + n
                if len(known) > TALLY:
                    yield from rows(known)
                    known.clear()
        yield from rows(known)
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): runs of letters of all texts after the noise, long and frequent enough.

    A null identifier counts as an empty string in the checksum, a null text has no
    words. Repeated rows count each.
    """
    session(docs)
    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(_tally(noise, min_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def deal_letters(weights: dict[str, int], parts: int) -> dict[str, int]:
    """The set of each letter, the heaviest first into the set that is lightest by then."""
    load, out = [0] * parts, {}
    for letter, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        out[letter] = at = load.index(min(load))
        load[at] += weight
    return out


def signatures(word: str, sets: dict[str, int], parts: int, length: int, distance: int = 2) -> list[int]:
    """Signed 64-bit hashes of a word as one of a pair whose shorter word has ``length`` code points.

    One for each choice of ``parts - distance`` sets, of the word's letters in them, and
    for each half of the shorter word that an edit behind or before it leaves alone.
    """
    own: list[list[str]] = [[] for _ in range(parts)]
    for c in sorted(word):
        own[sets[c]].append(c)
    texts = ["".join(x) for x in own]
    half = length // 2
    out = []
    for k, chosen in enumerate(combinations(range(parts), parts - distance)):
        letters = "\0".join([texts[i] for i in chosen])
        for side, rest in enumerate((word[:half], word[half - length:])):
            h = xxhash.xxh64_intdigest(f"{letters}\0{rest}", (length << 8 | k) << 1 | side)
            out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _sign(sets: dict[str, int], parts: int):
    """Task function: (word, n, longer, sig), one row for each signature; ``longer`` if as the longer word of a pair."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                each, longer, sigs = [], [], []
                for k, w in enumerate(part.column(0).to_pylist()):
                    for more in (0, 1):
                        own = signatures(w, sets, parts, len(w) - more)
                        sigs += own
                        each += [k] * len(own)
                        longer += [bool(more)] * len(own)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(each, pa.int32())).columns, pa.array(longer, pa.bool_()),
                                                  pa.array(sigs, pa.int64())], ["word", "n", "longer", "sig"])
    return run


def signed_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, longer, sig) with all signatures of (word, n)."""
    if parts < 3:
        raise ValueError("three sets or more are needed")
    session(words)
    # One row per letter: at most the letters of the alphabet.
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    sets = deal_letters({r.c: r["count"] for r in letters}, parts)
    return words.select("word", "n").mapInArrow(_sign(sets, parts), "word string, n long, longer boolean, sig long")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, other, other_n) for words that differ by one inserted, deleted or replaced code point, both ways round.

    ``words`` has (word, n), each word once; it is read three times.
    """
    signed = signed_words(words, parts)
    shorter = signed.where("not longer").select("sig", F.col("word").alias("a"), F.col("n").alias("an"))
    other = signed.select("sig", "longer", F.col("word").alias("b"), F.col("n").alias("bn"))
    pairs = (shorter.join(other, "sig").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
             .select("a", "an", "b", "bn").distinct())
    return pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n")))).alias("r")).select("r.*")


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) for (word, form) rows, each word once: where the forms lead to in the end.

    ``most`` is the largest number of occurrences of a word; it grows ``ratio``-fold
    with each form, which bounds the chains and so the rounds.
    """
    steps, reach = 0, 1
    while reach <= most:
        reach, steps = reach * ratio, steps + 1
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        # Written each round, as the next one reads it twice.
        out = out.checkpoint()
        further = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = out.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE, parts: int = PARTS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters of at least ``min_length`` code points with
    ``min_count`` occurrences in all texts; every ``noise``-th run of a document
    (by checksum) loses a character before. ``form`` is the near word that occurs
    most (ties: the smallest in code-point order) if it occurs ``ratio`` times as
    often, else null; ``root`` is where forms lead to, the word itself without one.
    Null texts have no words and null identifiers count as empty; repeated rows count
    each; an empty table gives no words; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("the ratio is 2 or more, so that forms cannot lead in a circle")
    # Written once: letters, signatures and the result all read it.
    words = word_counts(docs, id_col, text_col, min_length, min_count, noise).checkpoint()
    most = words.agg(F.max("n")).first()[0] or 0
    best = near_words(words, parts).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    known = best.select("word", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(
        F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")).select(
        "word", "n_near", "f.form", "f.form_n").checkpoint()
    ends = roots(known.where("form is not null"), most, ratio)
    return (words.join(known, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
