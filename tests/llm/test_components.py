import random

import pytest

from weft.llm import components as cp


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def solved(spark, pairs):
    out = {}
    for r in cp.component_roots(spark.createDataFrame(pairs, "a string, b string")).collect():
        assert r["v"] not in {x for g in out.values() for x in g}
        out.setdefault(r["root"], set()).add(r["v"])
    for root, members in out.items():
        assert root in members
    return {frozenset(g) for g in out.values()}


def shape(kind):
    rnd = random.Random(kind)
    n = [f"{i}" for i in range(60)]
    if kind == "chain":
        return list(zip(n, n[1:], strict=False))
    if kind == "cycle":
        return [*zip(n, n[1:], strict=False), (n[-1], n[0])]
    if kind == "star":
        return [("hub", x) for x in n] + [("hub", "hub"), (None, "q"), ("1", None), ("hub", "3")]
    if kind == "dense":
        return [(rnd.choice(n[:20]), rnd.choice(n[:20])) for _ in range(150)] + [(rnd.choice(n[30:45]), rnd.choice(n[30:45])) for _ in range(70)]
    return [(rnd.choice(n), rnd.choice(n)) for _ in range(45)]


@pytest.mark.parametrize("kind", ["chain", "cycle", "star", "dense", "sparse"])
def test_shapes(spark, kind):
    pairs = shape(kind)
    assert solved(spark, pairs) == groups(pairs)


def test_empty(spark):
    assert cp.component_roots(spark.createDataFrame([], "a string, b string")).count() == 0


def test_smallest_number_names_the_group(spark):
    rows = [("10", "x"), ("9", "x"), ("9", "y"), ("100", "y"), ("7", "z"), (None, "x"), ("8", None), ("10", "x")]
    got = cp.groups_by_shared_names(spark.createDataFrame(rows, "id string, name string")).collect()
    assert sorted((r["id"], r["group_id"]) for r in got) == [("10", "9"), ("100", "9"), ("9", "9")]
