"""Names composed and profiles expanded: against brute force, and without a shuffle of the result."""

import random
import re
from collections import defaultdict

from weft.operators import graph, mapping


def exchanges(df):
    return re.findall(r"Exchange (\S+ ?\S*)", df._jdf.queryExecution().executedPlan().toString())


def links(rng, left, right, n):
    return sorted({(f"{left}{rng.randrange(12)}", f"{right}{rng.randrange(12)}") for _ in range(n)})


def test_compose_sums_links_without_a_shuffle_of_them(spark):
    rng = random.Random(7)
    ab = [(*k, rng.randrange(1, 9)) for k in links(rng, "a", "m", 25)]
    bc = [(*k, rng.randrange(1, 9)) for k in links(rng, "m", "c", 25)]
    want = defaultdict(int)
    for a, m, v in ab:
        for m2, c, w in bc:
            want[a, c] += min(v, w) * (m == m2)
    kind = "source_name string, target_name string, votes long"
    df = mapping.compose(spark.createDataFrame(ab, kind), spark.createDataFrame(bc, kind))
    rows = [tuple(r) for r in df.collect()]
    assert sorted(rows) == sorted((*k, v) for k, v in want.items() if v)
    assert not [e for e in exchanges(df) if re.match(r"hashpartitioning\((salt\S* )?source_name\S* target_name", e)]


def test_expanded_profiles_sum_without_a_shuffle_of_them(spark):
    rng = random.Random(8)
    walk = links(rng, "p", "t", 20) + [("p1", "p11x")]
    profile = [(f"e{i}", p, float(rng.randrange(1, 9))) for i in range(9) for p in rng.sample([*(f"p{j}" for j in range(12)), "p11x", "t3"], 6)] + [("e1", None, 2.0)]
    n = defaultdict(set)
    for a, b in walk:
        n[a].add(b)
    want = defaultdict(float)
    for e, p, w in profile:
        for t in n.get(p, [p]):
            want[e, t] += w / len(n.get(p, [p]))
    df = mapping.expand_profile(spark.createDataFrame(profile, "entity string, partner string, weight double"), spark.createDataFrame(walk, "source_name string, target_name string"))
    kinds = exchanges(df)
    rows = df.collect()
    assert len(rows) == len(want) and all(abs(want[r["entity"], r["partner"]] - r["weight"]) < 1e-9 for r in rows)
    assert len([e for e in kinds if re.match(r"hashpartitioning\(entity\S* (partner|coalesce)", e)]) <= 1  # of names that are unmapped too


def test_path_table_takes_no_path_apart(spark):
    edges = spark.createDataFrame([("s", "a", 4, 0.5), ("s", "t", 1, 0.25), ("a", "t", 3, 0.75), ("a", "s", 2, 1.0), ("t", "a", 9, 0.5)], "pre string, post string, weight long, ratio double")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    df = graph.path_table(edges, one("s"), one("t"), 3)
    assert not [e for e in exchanges(df) if "text" in e]
    assert sorted((r["path"], r["hops"], r["min_weight"], r["min_ratio"]) for r in df.collect()) == [("s->a->t", 2, 3, 0.5), ("s->t", 1, 1, 0.25)]
