import random

import pytest

from weft.llm import set_join as sj


def brute(records, num, den):
    best = {}
    for scope, i, t in records:
        if scope is None or i is None or t is None:
            continue
        s = frozenset(x for x in t if x is not None)
        if s:
            key = sorted(s)
            if (scope, i) not in best or key < best[scope, i]:
                best[scope, i] = key
    out = set()
    for (sa, a), x in best.items():
        for (sb, b), y in best.items():
            if sa == sb and a < b and len(set(x) & set(y)) * den >= len(set(x) | set(y)) * num:
                out.add((sa, a, b))
    return out


def records(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(90):
        base = rnd.sample([f"t{j}" for j in range(40)] + ["hub1", "hub2"] * 3, rnd.randint(1, 25))
        out.append(("u", 2 * i, [*base, "hub1"]))
        near = [x for x in base if rnd.random() > 0.12] + ([f"n{i}"] if rnd.random() < 0.5 else [])
        out.append(("u" if i % 5 else "d", 2 * i + 1, [*near, "hub1"]))
    out += [("u", 1000 + i, ["same", "set", "of", "all"]) for i in range(12)]
    return out + [("u", 2000, None), ("u", 2001, []), ("u", 2002, [None]), (None, 1, ["a"]), ("u", None, ["a"]), ("u", 0, ["zz"]), ("d", 3000, ["one"]), ("d", 3001, ["one"])]


@pytest.mark.parametrize(("num", "den"), [(7, 10), (1, 2), (9, 10)])
def test_all_pairs_and_only_those(spark, num, den):
    rows = records(num)
    df = spark.createDataFrame([(*r, "x") for r in rows], "scope string, id bigint, tokens array<string>, class_id string")
    member, links = sj.similarity_links(df, num, den)
    got = [tuple(r) for r in sj.all_pairs(member, links).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, num, den)
    summary = sj.class_summary(member, links).collect()
    assert len(summary) == member.count()
    assert {r["n_copies"] for r in summary if r["id"] >= 1000 and r["id"] < 1012 and r["scope"] == "u"} == {12}


def test_empty(spark):
    df = spark.createDataFrame([], "scope string, id bigint, tokens array<string>")
    member, links = sj.similarity_links(df, 7, 10)
    assert sj.all_pairs(member, links).count() == 0
    assert sj.class_summary(member, links).count() == 0
