import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadspeed.llm import words as W

TEXT = st.text(alphabet=st.sampled_from("aAbZz09 \n\t\x00\x0b\x1fé ß世.-_|"), max_size=60)


def parse(texts, table):
    data, offsets = W.buffers(pa.array(texts, pa.string()))
    w = W.words(data, offsets, table)
    return w, [[w.text(i, i + 1) for i in range(a, b)] for a, b in zip(w.starts, w.ends)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_match_the_patterns(texts):
    _, got = parse(texts, W.ALNUM)
    assert got == [[x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))] for t in texts]
    _, got = parse(texts, W.SPACED)
    assert [[x.replace(b"\xff", b"\x00") for x in t] for t in got] == [
        [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]


@given(st.lists(TEXT, min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_hash_depends_on_the_word_alone(texts):
    w, got = parse(texts, W.ALNUM)
    seen = {}
    for word, h in zip([x for t in got for x in t], w.hash.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_nulls_and_chunks():
    col = pa.array(["skip", "a b", None, "", "c"], pa.string()).slice(1)
    data, offsets = W.buffers(col)
    assert bytes(data) == b"a bc" and offsets.tolist() == [0, 3, 3, 3, 4]
    data, offsets = W.buffers(pa.chunked_array([["a b"], [None, ""], ["c"]], pa.large_string()))
    assert bytes(data) == b"a bc" and offsets.tolist() == [0, 3, 3, 3, 4]
    assert list(W.chunks(np.array([0, 5, 5, 200, 210, 211]), 100)) == [(0, 2), (2, 3), (3, 5)]
    assert list(W.chunks(np.array([0]))) == []


@pytest.mark.parametrize("w", [1, 2, 3, 5, 8])
def test_slide(w):
    x = np.random.default_rng(1).integers(0, 9, 40)
    assert W.slide(x, w, np.minimum).tolist() == [min(x[i:i + w]) for i in range(40 - w + 1)]


def test_winnow_guarantees_shared_windows():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 3, n))) for n in (60, 9, 10, 0, 40)]
    w, got = parse(texts, W.ALNUM)
    h = W.grams(w.hash, 5)
    at = set(W.winnow(h, w.left(), 5, 6).tolist())
    for a, b in zip(w.starts, w.ends):
        for p in range(a, b - 9):
            window = range(p, p + 6)
            low = min(h[list(window)])
            assert {q for q in window if h[q] == low} <= at
    assert all(w.left()[p] >= 5 for p in at)
