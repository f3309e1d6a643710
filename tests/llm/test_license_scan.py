import re
from collections import Counter

import pytest

from roadspeed.llm import license_scan as L


def dice(a, b):
    x, y = (Counter(zip(w, w[1:])) for w in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0


def brute(text):
    text = text or ""
    norm = re.sub(r"[^\w\n]|_", " ", text.lower())
    units = norm.split("\n") + ([norm.replace("\n", " ")] if "\n" in norm else [])
    best = []
    for u in units:
        top = max((dice(u.split(), L.words_of(t)), n) for n, t in L.TEMPLATES)
        if top[0] >= L.THRESHOLD:
            best.append(top)
    return (len(text.split("\n")), len(best), ",".join(sorted({n for _, n in best})),
            max(best)[1] if best else None, max(best)[0] if best else None)


TEXTS = [None, "", "plain words only", "Released under the MIT License.", "x\nRELEASED  under the, MIT license!\ny",
         "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.",
         "Licensed under CC BY-SA 4.0", "licensed", "Released under the MIT License. Thanks", "é ü ñ\n" * 30,
         "word " * 30000, "Released under the\nMIT License.", "the the the the the", "Released under the MIT License.\n" * 3]


def test_matches_brute_force(docs):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    got = {r.doc_id: tuple(r)[1:] for r in L.license_scan(docs(rows)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert L.license_scan(docs(rows)).count() == len(rows)


def test_size_bounds_never_lose_a_match():
    for size in range(1, 40):
        low, high = L.bounds(size, 0.8)
        for n in range(1, 120):
            assert (2 * min(n, size) / (n + size) >= 0.8) == (low - 1e-9 <= n <= high + 1e-9)


def test_empty_table_extra_columns_and_bad_parameters(docs):
    assert L.license_scan(docs([])).collect() == []
    assert L.license_scan(docs([(1, TEXTS[3])]).selectExpr("*", "1 as n_lines", "2 as x", "3 as licenses")).count() == 1
    with pytest.raises(ValueError):
        L.license_scan(docs([]), templates=[("one", "word")])


def test_no_python_in_the_plan(docs):
    plan = L.license_scan(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
