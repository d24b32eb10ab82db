"""Queries that must see all rows, against brute force or SQL over all rows of the smallest tables."""

import glob
import os
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from test_entry import normal
from weft.operators import graph as G
from weft.plans.core_problems import sql_canonical

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def ranks(v):
    return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]


def all_scores(con):
    """(source, target): Jaccard and rank correlation over the union of partners, of all ordered pairs that share one."""
    own = defaultdict(dict)
    for entity, partner, weight in con.execute("select l_suppkey::varchar, p_brand, sum(l_quantity)::double from lineitem join part on l_partkey = p_partkey group by 1, 2 having sum(l_quantity) > 0").fetchall():
        own[entity][partner] = weight
    out = {}
    for a, x in own.items():
        for b, y in own.items():
            both, union = x.keys() & y.keys(), sorted(x.keys() | y.keys())
            if a != b and both:
                ra, rb = ranks([x.get(p, 0) for p in union]), ranks([y.get(p, 0) for p in union])
                rho = round(float(np.corrcoef(ra, rb)[0, 1]), 9) if len(union) >= 3 and np.std(ra) > 0 and np.std(rb) > 0 else None
                out[a, b] = (round(len(both) / len(union), 9), rho)
    return out


def test_mutual_best_and_pool_have_all_sources(spark, con):
    scores = all_scores(con)
    order = lambda s, i: (-s[0], s[1] is None, -(s[1] or 0), i)
    first, back, pool = {}, {}, defaultdict(list)
    for (a, b), s in scores.items():
        first[a] = min(first.get(a, (order(s, b), b)), (order(s, b), b))
        back[b] = min(back.get(b, (order(s, a), a)), (order(s, a), a))
        pool[b].append((s[0], -2 if s[1] is None else s[1], a))
    want = {(a, b) for a, (_, b) in first.items() if back[b][1] == a}
    assert want and {(r["source"], r["target"]) for r in entry.queries()["j19_mutual_best"](spark, DATA).collect()} == want
    got = {r["target"]: (r["n_sources"], r["best_source"], r["jaccard"]) for r in entry.queries()["e16_pooled"](spark, DATA).collect()}
    assert got == {b: (len(rows), max(rows)[2], max(rows)[0]) for b, rows in pool.items()}


NETWORK = ["g07_hops", "g08_cone", "g11_widest", "g13_strongest_first", "g14_simple_paths", "g16_meet_in_the_middle", "g20_shortest_paths", "g25_coverage", "g28_batched_shortest", "g31_label_paths", "g32_path_table", "g38_walk_counts", "g43_chain_paths", "a39_pair_breakdown", "a40_intermediates", "f19_path_keywords", "j13_route_scope"]
CUTS = re.compile(r"quantile_cont|limit 12\b|like '%00'|starts_with\(type")


def test_no_sql_leaves_rows_out():
    for name in [*NETWORK, "u01_pair_metrics", "m30_region_screen"]:
        assert not CUTS.search(entry.oracle_sql()[name]), name
    for name in ("j19_mutual_best", "e16_pooled"):
        assert "% 20" not in entry.oracle_sql()[name]


@pytest.mark.parametrize("name", NETWORK)
def test_graph_queries_have_all_edges(spark, con, name):
    assert normal(entry.queries()[name](spark, DATA).toPandas()) == normal(con.execute(entry.oracle_sql()[name]).df())


def test_region_screen_has_inputs_and_outputs_of_every_twentieth(spark, con):
    pre, post = sql_canonical("bodyId_pre"), sql_canonical("bodyId_post")
    rows = con.execute(f"with s as (select distinct {pre} as pre, {post} as post, roi, weight, cached_date from example_bodyid_network where roi is not null and weight > 0) select 'in', post, roi, sum(weight)::double from s where post is not null group by all union all select 'out', pre, roi, sum(weight)::double from s where pre is not null group by all").fetchall()
    own = defaultdict(dict)
    for block, i, roi, n in rows:
        own[i].setdefault(block, {})[roi] = n
    swap = lambda r: r[:-3] + {"(L)": "(R)", "(R)": "(L)"}[r[-3:]] if r[-3:] in ("(L)", "(R)") else r
    cosine = lambda x, y: sum(v * y.get(r, 0) for r, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x and y else 0.0
    want = {}
    for q in (i for i in own if int(i) % 20 == 0):
        for i in own.keys() - {q}:
            a = np.mean([cosine(x, own[i].get(b, {})) for b, x in own[q].items()])
            m = np.mean([cosine({swap(r): v for r, v in x.items()}, own[i].get(b, {})) for b, x in own[q].items()])
            if a > 0 or m > 0:
                want[q, i] = (a, m, max(a, m))
    got = {(r["query"], r["id"]): tuple(r)[2:5] for r in entry.queries()["m30_region_screen"](spark, DATA).collect()}
    first = {q: sorted((-round(v[2], 9), i) for (p, i), v in want.items() if p == q)[:10] for q, _ in want}
    assert want and got.keys() == {(q, i) for q, rows in first.items() for _, i in rows}
    assert all(np.allclose(got[k], want[k], atol=2e-9) for k in got)


def test_pair_metrics_have_all_edges(spark, con):
    assert normal(entry.queries()["u01_pair_metrics"](spark, DATA).toPandas()) == normal(con.execute(entry.oracle_sql()["u01_pair_metrics"]).df())


def test_diverse_top_goes_through_all_paths_of_a_pair(spark):
    paths = [(["s", "a", f"m{i}", "t"], 1000.0 - i) for i in range(400)] + [(["s", f"b{i}", f"n{i}", "t"], 10.0 - i) for i in range(4)]
    got = G.diverse_top(spark.createDataFrame(paths, "path array<string>, bottleneck double"), 5, 2).orderBy("rank").collect()
    assert [r["path"] for r in got] == ["s->a->m0->t", "s->a->m1->t", "s->b0->n0->t", "s->b1->n1->t", "s->b2->n2->t"]


def test_docstrings_name_no_id_that_is_left_out():
    left = {"M21", "M25", "M28", "G22", "G30", "G36"}
    for name, query in entry.queries().items():
        for part in (query.__doc__ or "").split(":")[0].split(", "):
            ends = re.fullmatch(r"([A-Z]+)([0-9]+)(?:-[A-Z]*([0-9]+))?", part)
            if ends:
                ids = {f"{ends[1]}{i}" for i in range(int(ends[2]), int(ends[3] or ends[2]) + 1)}
                assert not ids & left, name
