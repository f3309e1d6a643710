import hashlib
import random
import re

import pytest

from roadspeed.llm import decontaminate as D


def split(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                for i in windows.get(tuple(w[a:a + n]), ()):
                    hit |= set(range(a, a + n))
                    found.add(i)
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    few, many = [f"w{i}" for i in range(4)], [f"x{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(many, k=rng.choice([3, 9, 10, 11, 25, 40])))) for i in range(30)]
    items += [(50, ""), (51, None), (52, "..."), (53, items[0][1]), (54, "Solo"), (55, " ".join(few * 5))]
    docs = [(0, None), (1, ""), (2, "solo"), (3, " ".join(few * 30)), (4, "a " * 40000 + items[4][1] + " b")]
    for d in range(5, 60):
        body = rng.choices(many, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            src = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(src) - 1))
            cut = src[a:a + rng.randint(5, 20)]
            p = rng.randint(0, len(body))
            body[p:p] = cut
        docs.append((d, ", ".join(body).upper() if d % 2 else " ".join(body)))
    return docs + docs[3:9], items


@pytest.mark.parametrize("limit", [D.BROADCAST_WORDS, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, docs, limit, seed):
    rows, items = made(seed)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as print")
    got = D.decontaminate(docs(rows).selectExpr("*", "3 as key", "4 as items"), bench, broadcast_words=limit)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute(rows, items)


@pytest.mark.parametrize("limit", [D.BROADCAST_WORDS, 0])
def test_empty_tables(spark, docs, limit):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(None, "a b c d e f g h i j k"), (1, "q")], "item_id long, text string")
    assert D.decontaminate(docs([]), some, broadcast_words=limit).collect() == []
    rows = [(1, "a b c d e f g h i j k"), (None, "q"), (1, None)]
    assert [r.n_hit for r in D.decontaminate(docs(rows), none, broadcast_words=limit).collect()] == [0, 0, 0]
    kept = D.drop_contaminated(docs(rows), some, broadcast_words=limit)
    assert kept.columns[:2] == ["doc_id", "text"] and kept.count() == 3


@pytest.mark.parametrize("limit", [0, 10 ** 6])
def test_stage_decides_each_row(spark, docs, limit):
    item = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(7, "x " + item), (7, "clean"), (8, "clean"), (8, "clean"), (None, item), (None, "clean"), (9, None)]
    kept = D.drop_contaminated(docs(rows), items, broadcast_words=limit).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "clean"), (0, item), (7, "clean"), (8, "clean"), (8, "clean"), (9, "")]
