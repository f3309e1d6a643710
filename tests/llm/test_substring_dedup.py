import hashlib
import random
import re

import pytest

from roadspeed.llm import substring_dedup as S


def brute(rows, window):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for i, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            if key in seen:
                gone |= set(range(a, a + window))
            seen.add(key)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    hot = [rng.choice("abcdé") + str(i) for i in range(47)]
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "x " * 60000), (904, "one"), (905, "one"), (None, " ".join(hot)),
            (None, " ".join(hot[5:40])), (906, "a\x00b \x1f\x0b ß c " * 15)]
    for d in range(n):
        body = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            a, p = rng.randint(0, 30), rng.randint(0, len(body))
            body[p:p] = hot[a:a + rng.randint(3, 40)]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(body)))
        if d % 9 == 0:
            rows.append((1000 + d, rows[-1][1]))
    return rows + [(3, "again " + " ".join(hot)), (904, "one")]


def run(df, **how):
    return sorted((tuple(r) for r in S.substring_dedup(df, texts=True, **how).collect()), key=str)


@pytest.mark.parametrize("seed,window,blocks,shards", [(1, 20, 7, 3), (2, 20, 1, 1), (3, 7, 5, 4), (4, 2, 4, 4)])
def test_matches_brute_force(docs, seed, window, blocks, shards):
    rows = made(seed)
    df = docs(rows, 4).selectExpr("*", "1 as block", "2 as shard", "3 as n_words")
    assert run(df, window=window, blocks=blocks, shards=shards) == brute(rows, window)


def test_empty_table_and_columns(docs):
    assert run(docs([])) == []
    assert S.substring_dedup(docs([(1, "a")])).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("window", [2, 3, 5, 8, 20, 50])
def test_lengths_double(window):
    got = S.lengths_of(window)
    assert got[-1] == window and got[0] >= 2 - (window == 2) and all(a < b <= 2 * a for a, b in zip(got, got[1:]))
