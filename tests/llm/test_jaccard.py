import random
import re
from collections import Counter, defaultdict

import pytest

from knotwork.llm.jaccard import boundary, classes, least_shared, representatives, subsets

from .common import frame, rows


def brute(docs, width, percent):
    sets, parent, held = {}, {}, defaultdict(list)
    for i, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        s = frozenset(tuple(w[a : a + width]) for a in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())
        sets[i], parent[i] = s, i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        met = Counter()
        for e in sets[i]:
            met.update(held[e])
            held[e].append(i)
        for j, o in met.items():
            if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def clusters(seed, template=60):
    """Copies of one text with few changes, some of them common to several, and of its variants."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(template)]
    spots = [rng.randrange(template) for _ in range(6)]
    found = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.choice(spots) if rng.random() < 0.5 else rng.randrange(template)] = rng.choice(["x", "y", f"z{rng.randrange(9999)}"])
        found.append(" ".join(w))
    return [(i, t) for i, t in enumerate(found)]


@pytest.mark.parametrize(("width", "percent", "most"), [(3, 90, 27), (5, 80, 1), (1, 70, 27), (2, 60, 1)])
def test_against_brute_force(spark, width, percent, most):  # most = 1: grades are counts, sets are read again
    data = rows(width)
    found = {r[0]: (r[1], r[2]) for r in classes(frame(spark, data), width, percent, most=most).collect() if r[0] is not None}
    assert found == brute([(r[0], r[1]) for r in data if r[0] is not None], width, percent)


@pytest.mark.parametrize(("seed", "template", "width", "percent", "most"), [(1, 60, 3, 90, 27), (1, 120, 3, 90, 1), (2, 60, 3, 80, 27), (3, 40, 2, 85, 1), (4, 14, 1, 80, 27)])
def test_near_copies(spark, seed, template, width, percent, most):
    data = clusters(seed, template)
    found = {r[0]: (r[1], r[2]) for r in classes(spark.createDataFrame(data, "doc_id long, text string"), width, percent, most=most).collect()}
    assert found == brute(data, width, percent)


def test_no_rows(spark):
    assert classes(frame(spark, [])).count() == 0
    assert representatives(frame(spark, [])).count() == 0


def test_null_id_has_no_component(spark):
    out = classes(frame(spark, [(None, "a b c d e f", *[None] * 5), (1, "a b c d e f", *[None] * 5)])).collect()
    assert {(r[0], r[2]) for r in out} == {(None, None), (1, 1)}


def test_one_of_each_component_stays(spark):
    data = rows(9)
    kept = representatives(frame(spark, data)).collect()
    truth = brute([(r[0], r[1]) for r in data if r[0] is not None], 5, 80)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for _, c in truth.values()})
    assert kept[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "_id"]


def test_boundary_follows_the_cost():
    assert boundary(1.0, 90, 10**6) <= boundary(5.0, 90, 10**6) <= boundary(500.0, 90, 10**6)
    assert boundary(2.0, 100, 700) == 700 and boundary(500.0, 90, 3) == 3
    b = boundary(8.0, 90, 10**6)
    assert subsets(b, 90) <= (b + 1 - least_shared(b, 90)) * 8.0 < subsets(b + 1, 90) + 8.0 * 99


def test_clashing_columns_stay(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8), (3, "x", 9, 10), (3, "x", 9, 10)], "doc_id long, text string, _gone long, _twice long")
    assert sorted(map(tuple, representatives(d).collect())) == [(1, "a b c d e f", 5, 6), (3, "x", 9, 10)]
