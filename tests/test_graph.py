"""Longest chains and depths against brute force."""

import random

from quirestack.operators import graph


def brute(edges, root):
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)

    def depth(at, seen):
        return max((1 + depth(b, seen | {b}) for b in down.get(at, ()) if b not in seen), default=0)

    return depth(root, {root})


def test_longest_chains_of_random_graphs():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 8)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
        roots = sorted({rng.randrange(n), n + 5})
        assert graph.longest_chains(edges, roots) == [brute(edges, r) for r in roots]
    assert graph.longest_chains([(i, i + 1) for i in range(5000)] + [(7, 3)], [0]) == [5000]


def test_include_depth_by_document(spark):
    edges = [(1, "m", "a"), (1, "a", "b"), (1, "b", "a"), (1, "m", "b"), (2, "m", "m"), (2, None, "x")] + [(3, f"f{i}", f"f{i + 1}") for i in range(200)]
    roots = [(1, "m"), (1, "z"), (2, "m"), (3, "f0"), (4, "alone")]
    got = graph.include_depth(spark.createDataFrame(edges, "doc int, a string, b string"), spark.createDataFrame(roots, "doc int, a string"), ["doc"])
    assert sorted(map(tuple, got.collect())) == [(1, "m", 2), (1, "z", 0), (2, "m", 0), (3, "f0", 200), (4, "alone", 0)]


def test_depths_below(spark):
    tree = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, None), (2001, 150)]
    got = graph.depths_below(spark.createDataFrame(tree, "id int, parent int"), spark.createDataFrame([(3,), (150,)], "id int"))
    want = [(i, i - 3, 3) for i in range(3, 150)] + [(i, i - 150, 150) for i in range(150, 300)] + [(2001, 1, 150)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert graph.depths_below(spark.createDataFrame([], "id int, parent int"), spark.createDataFrame([], "id int")).count() == 0
