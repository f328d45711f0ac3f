"""Digests compared: first fit against a plain scan, bags, both directions, sampled routes."""

import random

import pytest

from quarrymill.operators import digest as G


def plain(a, b, within):
    """The rule as it is said: each of a takes the first free one of b that fits."""
    taken, lost = set(), []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if j not in taken and (x is None) == (y is None) and (x is None or len(x) == len(y) and all(abs(p - q) <= within for p, q in zip(x, y))):
                taken.add(j)
                break
        else:
            lost.append(i)
    return lost, [j for j in range(len(b)) if j not in taken]


@pytest.mark.parametrize("seed", range(40))
def test_first_fit_by_force(seed):
    r = random.Random(seed)
    box = lambda: None if r.random() < 0.1 else tuple(r.randrange(-4, 5) for _ in range(r.choice([0, 1, 2, 4])))
    a, b = [box() for _ in range(r.randrange(60))], [box() for _ in range(r.randrange(60))]
    for within in (0, 1, 3):
        assert G.first_fit(a, b, within) == plain(a, b, within)


def test_many_equal_and_many_different_boxes_take_time_in_proportion():
    import time

    began = time.time()
    assert G.first_fit([(1, 1)] * 50_000, [(1, 2)] * 50_000) == ([], [])
    assert G.first_fit([(5 * i, 0, 9) for i in range(50_000)], [(5 * i + 1, 0, 9) for i in reversed(range(50_000))]) == ([], [])
    assert time.time() - began < 20


OLD = "a | 0 0 10 10 | red | x\na | 0 20 10 10 | red | x\nb | none | - | y\nplain\n\nplain"


def changes(spark, old, new):
    t = lambda m: spark.createDataFrame(list(m.items()), "file string, text string")
    return sorted(tuple(r) for r in G.compare(t(old), t(new)).collect()), sorted(tuple(r) for r in G.differences(t(old), t(new)).collect())


@pytest.mark.parametrize(
    ("new", "want"),
    [
        (OLD, []), (OLD.replace("0 0 10", "1 0 9"), []), (OLD.replace("0 20", "0 22"), [("f", "added", "a | 0 22 10 10 | red | x"), ("f", "removed", "a | 0 20 10 10 | red | x")]),
        (OLD.replace("a | 0 0 10 10 | red | x\n", ""), [("f", "removed", "a | 0 0 10 10 | red | x")]), (OLD + "\nplain", [("f", "added", "plain")]), (OLD.replace("red | x", "blue | x", 1), [("f", "added", "a | 0 0 10 10 | blue | x"), ("f", "removed", "a | 0 0 10 10 | red | x")]),
        (OLD.replace("b | none", "b | 3 4"), [("f", "added", "b | 3 4 | - | y"), ("f", "removed", "b | none | - | y")]), ("\n".join(reversed(OLD.split("\n"))), []),
    ],
)
def test_one_change(spark, new, want):
    kinds, lines = changes(spark, {"f": OLD, "same": "x"}, {"f": new, "same": "x"})
    assert lines == want and [k[:2] for k in kinds] == ([("f", "changed")] if want else [])


def test_both_directions(spark):
    assert changes(spark, {"a": "x", "b": "x"}, {"b": "x", "c": None})[0] == [("a", "vanished", 0, 0), ("c", "unrecorded", 0, 0)]


def test_sampled_routes(spark):
    rows = [(f"/p/{i:02d}/", "post") for i in range(20)] + [("/x/", None), ("/y/", None), ("/one/", "page")]
    got = sorted(r["route"] for r in G.sampled(spark.createDataFrame(rows, "route string, template string"), 3).collect())
    assert got == ["/one/", "/p/00/", "/p/10/", "/p/19/", "/x/", "/y/"]
    assert [r["route"] for r in G.sampled(spark.createDataFrame(rows[:20], "route string, template string"), 1).collect()] == ["/p/00/"]
