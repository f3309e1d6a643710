import random
import re
import zlib
from collections import Counter

import pytest

from roadspeed.llm import spelling as S


def near(a, b):
    if a == b:
        return False
    return a in edits(b) or b in edits(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)


def edits(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def brute(rows, noise=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n}


def got(df):
    out = S.spelling_variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_matches_brute_force(docs):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    base += [w[:2] + w[3:] for w in base[:30]] + [w[:2] + "x" + w[3:] for w in base[:30]] + ["".join(sorted(w)) for w in base[:20]]
    weights = [rng.choice([1, 2, 5, 20, 60]) for _ in base]
    rows = []
    for i in range(80):
        w = rng.choices(base, weights, k=120)
        rows.append((i, "".join(x.title() if rng.random() < .1 else x + rng.choice([" ", "-", "1", "\n", "€", "ā", "×"]) for x in w)))
    rows += [(None, rows[0][1]), (5, rows[5][1]), (6, None), (7, ""), (8, "wordy " * 40000), (9, "x" * 200000)]
    want = brute(rows)
    assert any(r[1] for r in want) and any(r[4] and not r[1] for r in want)
    assert got(docs(rows)) == want


def test_long_chain_of_forms(docs):
    """Each word is the deletion of one that occurs twice as often: roots over ten steps."""
    chain = ["abcdefghijklmno"[:5 + k] for k in range(10)]
    rows = [(i, " ".join([w] * (3 * 2 ** k))) for k, w in enumerate(chain) for i in [next(
        j for j in range(1000 * k, 1000 * k + 500) if zlib.crc32(f"{j}:{w}".encode()) % 97)]]
    out = got(docs(rows))
    assert out == brute(rows) and {r[2] for r in out} == {chain[-1]}


def test_ties_take_the_smallest(docs):
    rows = [(1, "caned " * 3 + "cabed " * 9 + "cazed " * 9)]
    assert got(docs(rows)) == brute(rows)


def test_signatures_of_near_words_meet():
    rng = random.Random(5)
    sets = S.deal_letters({c: rng.randint(1, 9) for c in "abcdefgh"}, S.PARTS)
    for _ in range(400):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 12)))
        i = rng.randrange(len(w))
        for x in (w[:i] + w[i + 1:], w[:i] + rng.choice("abcdefgh") + w[i + 1:], w[:i] + rng.choice("abcdefgh") + w[i:]):
            short = min(len(w), len(x))
            assert set(S.signatures(w, sets, S.PARTS, short)) & set(S.signatures(x, sets, S.PARTS, short))


def test_empty_table_clashing_names_and_bounds(spark, docs):
    assert got(docs([])) == set()
    df = docs([(1, "spell spell spell spelt")]).selectExpr("*", "1 as word", "2 as n", "3 as sig", "4 as root")
    assert {r[0] for r in got(df)} == {"spell"}
    with pytest.raises(ValueError):
        S.spelling_variants(df, ratio=1)
