"""Matching-block similarity against the plain definition."""

import random
from difflib import SequenceMatcher

from quillspark.operators.fuzzy import reaches, similar_names, unit_diff


def test_similar_names_finds_every_pair(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    names += [n[:-1] + "x" for n in names[:25]] + [n + "y" for n in names[:25]]
    rows = [(k, "k%d" % (k % 2), n) for k, n in enumerate(names)]
    got = {(r.a, r.b) for r in similar_names(spark.createDataFrame(rows, "id long, kind string, name string"), 0.8).collect()}
    want = {(a, b) for a, ka, x in rows for b, kb, y in rows if a < b and ka == kb and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.8}
    # the ratio of a pair can depend on its order; both ways count as one pair
    assert all(p in got or SequenceMatcher(None, names[p[1]], names[p[0]], autojunk=False).ratio() < 0.8 for p in want)
    assert got <= want


def test_unit_diff(spark):
    old = spark.createDataFrame([(1, 0, "title"), (1, 1, "the ring is blue"), (1, 2, "gone"), (1, 3, "moves")], "doc long, address int, body string")
    new = spark.createDataFrame([(1, 0, "title"), (1, 1, "the ring is blue now"), (1, 2, "moves"), (1, 4, "fresh")], "doc long, address int, body string")
    assert {tuple(r) for r in unit_diff(old, new).collect()} == {(1, "moved", 3, 2), (1, "edited", 1, 1), (1, "removed", 2, None), (1, "added", None, 4)}


def test_reaches_as_the_ratio_tells():
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("abc", "xabc")]
    for _ in range(3000):
        x = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 16)))
        y = "".join(c if rng.random() < 0.6 else rng.choice("abcd") for c in x) + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 5)))
        pairs.append((x, y))
    for threshold in (0.3, 0.6, 0.75, 1.0):
        for x, y in pairs:
            assert reaches(x, y, threshold) == (SequenceMatcher(None, x, y, autojunk=False).ratio() >= threshold), (x, y, threshold)


def test_unit_diff_of_long_units_and_repeated_rows(spark):
    long = "ab" * 6000
    old = [(1, 0, long), (1, 1, "same"), (1, 1, "same"), (2, 0, "a"), (2, 1, "a"), (2, 2, None), (None, 0, "z"), (3, 0, ""), (4, 0, "xyz one two"), (5, 5, "p"), (5, 5, "q")]
    new = [(1, 0, long + " more"), (1, 1, "same"), (2, 3, "a"), (2, 2, None), (None, 0, "z"), (3, 0, "new"), (4, 0, "one two wvu"), (5, 5, "r")]
    frame = lambda rows: spark.createDataFrame(rows, "doc long, address int, body string")
    d = unit_diff(frame(old), frame(new))
    want = [
        (1, "edited", 0, 0), (2, "moved", 0, 3), (2, "removed", 1, None), (None, "removed", 0, None), (None, "added", None, 0), (3, "removed", 0, None), (3, "added", None, 0),
        (4, "edited", 0, 0), (5, "removed", 5, None), (5, "removed", 5, None), (5, "added", None, 5), (5, "added", None, 5),
    ]
    assert sorted(map(str, map(tuple, d.collect()))) == sorted(map(str, want))
    # one shuffle of both versions, and matching blocks once for each pair
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 1
