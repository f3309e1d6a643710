import random
import re
from collections import defaultdict

import numpy as np
import pytest

from roadspeed.llm import jaccard_join as J
from roadspeed.llm.components import components


def sets(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    near = [[k for k in range(len(rows)) if k != j and s[j] and 5 * len(s[j] & s[k]) >= 4 * len(s[j] | s[k])] for j in range(len(rows))]
    label = list(range(len(rows)))
    for j in range(len(rows)):
        todo, seen = [j], {j}
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        label[j] = min(ids) if ids else None
    return sorted(((rows[j][0], label[j], len(near[j])) for j in range(len(rows))), key=str)


def made(seed, n=12):
    rng = random.Random(seed)
    def line(k):
        return [f"{rng.choice('abcdefgé')}{rng.randint(0, 500)}" for _ in range(k)]
    rows, next_id = [], 0
    for _ in range(n):
        base = line(rng.choice([6, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 99)}"
            rows.append((next_id, rng.choice([" ", ", "]).join(w)))
            next_id += 1
            if rng.random() < 0.3:
                rows.append((next_id, rows[-1][1]))
                next_id += 1
    rng.shuffle(rows)
    return rows


EDGE = [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two!"), (905, "one two three"), (906, "x " * 50000),
        (907, "x x x x x"), (None, "null id text of some words here"), (None, "null id text of some words here")]


def result(df, **how):
    return sorted((tuple(r) for r in J.jaccard_join(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_matches_brute_force(docs, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = made(seed) + EDGE
    df = docs(rows + [rows[0]], 4).selectExpr("*", "1 as digest", "2 as key", "3 as size", "4 as root")
    assert result(df) == brute(rows + [rows[0]])
    if block == 256:
        kept = J.keep_one_of_each(df)
        assert kept.columns == df.columns
        first = {(r[1] if r[1] is not None else -1) for r in brute(rows)}
        assert {r.doc_id if r.doc_id is not None else -1 for r in kept.collect()} == first


def test_a_crowd_of_near_copies_is_one_class(docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = result(docs(rows, 4))
    s = [sets(t) for _, t in rows]
    assert {c for _, c, _ in got} == {0}
    want = {i: sum(5 * len(s[i] & s[k]) >= 4 * len(s[i] | s[k]) for k in range(700)) - 1 for i in range(0, 700, 70)}
    assert {i: n for i, _, n in got if i in want} == want


def test_empty_table(docs):
    assert result(docs([])) == []


def test_prefix_length_and_recall():
    assert J.prefix_length(0.8) == 4 and J.prefix_length(1.0) == J.DEPTH
    with pytest.raises(ValueError):
        J.prefix_length(0.1)
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):  # pairs of exactly the threshold
        both = rng.integers(0, 1 << 63, 80).astype(np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 1 << 63, 10).astype(np.uint64))) for _ in range(2))
        x = J.signatures(np.concatenate((a, b)), np.array([90, 180])).reshape(2, J.TREES, J.DEPTH)[:, :, :4]
        met += bool((x[0] == x[1]).all(axis=1).any())
    assert met >= 297


def test_climb_connects_what_any_allowed_prefix_holds():
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 3, (40, J.TREES, J.DEPTH)).astype(np.uint32)
    sig[::5] = sig[0]
    sig[::5, 0, 5] = np.arange(8)  # equal but for the last value of this tree
    sig[1::10, 0] = sig[0, 0]  # below the same prefix, far by the whole signature
    allowed = rng.random((40, 40)) < 0.9
    allowed &= allowed.T
    np.fill_diagonal(allowed, False)
    for shortest in (6, 5, 4, 1):
        whole = sig.reshape(40, -1)
        near = (whole[:, None] == whole[None]).sum(axis=2) >= 60
        near &= allowed & (sig[:, None, 0, :shortest] == sig[None, :, 0, :shortest]).all(axis=2)
        assert (J.climb(sig, 0, allowed, shortest, 60) == J.roots(near)).all()


def test_climb_shortens_only_what_is_open(monkeypatch):
    asked = []
    monkeypatch.setattr(J, "roots", lambda near, own=J.roots: asked.append(1) or own(near))
    same = np.zeros((5, J.TREES, J.DEPTH), np.uint32)
    J.climb(same, 3, ~np.eye(5, dtype=bool), 4, 90)
    assert len(asked) == 1
    same[4, 3, 5] = 1
    J.climb(same, 3, ~np.eye(5, dtype=bool), 4, 90)
    assert len(asked) == 3  # full depth, then one value less


def test_recall_of_pairs_at_the_threshold_through_the_whole_join(docs):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        base = [f"w{i}x{k}" for k in range(94)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:45] + [f"v{i}"] + base[46:90] + [f"u{i}"] + base[91:]))]
    s = [sets(t) for _, t in rows]
    exact = [i for i in range(400) if 5 * len(s[2 * i] & s[2 * i + 1]) >= 4 * len(s[2 * i] | s[2 * i + 1])]
    assert len(exact) == 400 and len(s[0] & s[1]) / len(s[0] | s[1]) < 0.83
    rng.shuffle(rows)
    linked = sum(n for _, _, n in result(docs(rows, 4)))
    assert linked >= 2 * 0.998 * len(exact)


def test_shared_counts_intersections():
    rng = np.random.default_rng(4)
    s = [np.unique(rng.integers(0, 6000, rng.integers(0, 4000)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in s] for a in s]
    got = J.shared(s)
    off = ~np.eye(20, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    graph = defaultdict(set)
    for a, b in edges:
        if a != b:
            graph[a].add(b)
            graph[b].add(a)
    for a in graph:
        seen, todo = {a}, [a]
        while todo:
            for b in graph[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        assert got[a] == min(seen)
    assert set(got) == set(graph)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_stage_decides_each_row(docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a + " more"
    def kept(rows):
        return sorted(((r.doc_id or 0, r.text) for r in J.keep_one_of_each(docs(rows)).collect()))
    assert kept([(9, a), (7, near), (9, b)]) == [(7, near), (9, b)]
    assert kept([(7, a), (7, a)]) == [(7, a)] and len(kept([(7, a), (7, near), (7, a)])) == 1
    got = kept([(None, a), (None, near), (None, b), (3, ""), (3, "")])
    assert (0, b) in got and sum(t in (a, near) for _, t in got) == 1 and got.count((3, "")) == 2
