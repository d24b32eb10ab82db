"""Comparisons of all pairs in tiles: against brute force on odd rows, and without a shuffle of pairs."""

import itertools
import os
import random
import re
import statistics
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weft.operators import lines, profiles, tiles

DATA = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange (\S+)", df._jdf.queryExecution().executedPlan().toString())


def near(x, y):
    return x == y or (x is not None and y is not None and abs(x - y) < 2e-9)


ODD = [("a", "x", 5.0), ("a", "x", 7.0), ("a", "y", None), ("a", None, 3.0), ("b", "x", -2.0), ("b", "y", 4.0), ("c", "y", None), ("c", "z", 0.0), ("d", "z", 1.5), ("d", "x", 2.0), ("e", "q", 1.0), ("Z", "x", 7.0), (None, "x", 1.0)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_colabelling_of_odd_rows(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = ODD if not seed else [(f"l{rng.randrange(40)}", f"t{rng.randrange(9 * seed)}", rng.randrange(-3 if seed == 2 else 0, 9) / 4) for _ in range(300)]
    monkeypatch.setattr(tiles, "TILE_ROWS", 3)
    monkeypatch.setattr(tiles, "TILE", 12)
    monkeypatch.setattr(tiles, "TILE_KEYS", 2)
    best = {}
    for line, kind, s in rows:
        if line is not None:
            own = best.setdefault(line, {})
            own[kind] = max((v for v in (own.get(kind), s) if v is not None), default=None)
    want = {}
    for p, q in itertools.combinations(sorted(best), 2):
        x, y = best[p], best[q]
        if both := [k for k in x if k is not None and k in y]:
            lows = [min(v) for k in both if (v := [w for w in (x[k], y[k]) if w is not None])]
            sums = [[w for w in z.values() if w is not None] for z in (x, y)]
            low = sum(lows) if lows else None
            high = None if low is None or not all(sums) else sum(map(sum, sums)) - low
            want[p, q] = (len(both), len(both) / (len(x) + len(y) - len(both)), low / high if high else None)
    got = {(r["l1"], r["l2"]): tuple(r)[2:] for r in lines.colabelling(spark.createDataFrame(rows, "line string, type string, score double")).collect()}
    assert want and got.keys() == want.keys()
    assert all(near(x, y) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_sparsity_counts_what_only_just_exceeds(spark):
    df = spark.createDataFrame([("a", "x", 0.9 + 1e-10), ("b", "x", 1.0), ("c", "x", 0.5)], "line string, type string, score double")
    assert lines.sparsity(df, 0.9, 3).first()[0] == round(1 / 3, 9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["a21_sparsity", "a20_colabelling"])
def test_no_pairs_of_lines_are_shuffled(spark, name):
    kinds = exchanges(entry.queries()[name](spark, DATA))
    assert not [k for k in kinds if k.startswith(("hashpartitioning(type", "hashpartitioning(l1", "hashpartitioning(l2"))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["j19_mutual_best", "e16_pooled", "w14_own_windows", "m39_null_baseline"])
def test_no_pairs_of_entities_are_shuffled(spark, name):
    kinds = exchanges(entry.queries()[name](spark, DATA))
    assert not [k for k in kinds if k.startswith(("hashpartitioning(partner", "hashpartitioning(source", "hashpartitioning(target", "hashpartitioning(query"))]


def shuffled_rows(spark, make):
    """The rows of a query, and how many rows its stages wrote to shuffles where no join is small enough to broadcast."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty(30_000)
        jvm = spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before, limit = so_far(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = make().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return rows, sum(n for s, n in so_far().items() if s not in before)


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Tables of 300 suppliers that all deliver one brand, and each of them one of five others."""
    d = str(tmp_path_factory.mktemp("alike"))
    spark.createDataFrame([(i, p, 1.0 + i % 7, 100.0 + i, "A") for i in range(300) for p in (0, 1 + i % 5)], "l_suppkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p}") for p in range(6)], "p_partkey bigint, p_brand string").write.parquet(f"{d}/part.parquet")
    return d


def test_pooled_shuffles_far_fewer_rows_than_pairs(spark, alike):
    rows, n = shuffled_rows(spark, lambda: entry.queries()["e16_pooled"](spark, alike))
    assert len(rows) == 300 and {r["n_sources"] for r in rows} == {299} and {r["jaccard"] for r in rows} == {1.0}
    assert 0 < n < 300 * 299 / 2 / 4


def test_colabelling_shuffles_far_fewer_rows_than_pairs(spark, alike):
    rows, n = shuffled_rows(spark, lambda: entry.queries()["a20_colabelling"](spark, alike))
    assert len(rows) == 300 * 299 / 2 and all(r["l1"] < r["l2"] for r in rows)
    assert 0 < n < len(rows) / 4


def test_next_batch_is_made_while_one_is_passed_on():
    made = [threading.Event() for _ in range(3)]

    def batches():
        for i, m in enumerate(made):
            m.set()
            yield i
        raise ValueError("in the work")

    seen = []
    with pytest.raises(ValueError, match="in the work"):
        for i in tiles.ahead(batches()):
            seen.append(i)
            assert i == 2 or made[i + 1].wait(30)
    assert seen == [0, 1, 2]


def small_tiles(monkeypatch):
    for name, n in (("TILE_ROWS", 3), ("TILE", 12), ("TILE_KEYS", 2)):
        monkeypatch.setattr(tiles, name, n)


def odd_profiles(spark, seed):
    rng = random.Random(seed)
    rows = {(f"{rng.randrange(30)}", rng.choice([None, *(f"p{i}" for i in range(9))])): float(rng.randrange(-1, 5)) for _ in range(160)} | {("100", "p1"): 2.0, ("200", "p1"): 2.0, ("300", "alone"): 1.0}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "entity string, partner string, weight double")


def chain(r):
    return (-r["jaccard"], r["rank_union"] is None, -(r["rank_union"] or 0))


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_and_windows_agree_with_scores_of_all_pairs(spark, monkeypatch, seed):
    small_tiles(monkeypatch)
    p = odd_profiles(spark, seed)
    pairs = [r for r in profiles.score_pairs(p, p).collect() if r["source"] != r["target"]]
    own = {}
    for r in pairs:
        own.setdefault(r["source"], []).append(r)
    got = {r["entity"]: r for r in profiles.nearest(p).collect()}
    assert got.keys() == own.keys()
    for e, rows in own.items():
        top = min(map(chain, rows))
        best = sorted(r["target"] for r in rows if chain(r) == top)
        assert (got[e]["n"], got[e]["first"], got[e]["last"]) == (len(rows), best[0], best[-1])
        assert chain(got[e]) == top
    assert {(r["source"], r["target"]) for r in profiles.mutual_best(p).collect()} == {(e, r["first"]) for e, r in got.items() if got[r["first"]]["first"] == e}
    windows = spark.createDataFrame([(e, int(e) % 7) for e in own if e != "200"], "entity string, window int")
    want = {(e, r["target"], i) for e, rows in own.items() if e != "200" and int(e) % 2 == 0 for i, r in enumerate(sorted(rows, key=lambda r: (*chain(r), r["target"])), 1) if i <= int(e) % 7}
    assert {tuple(r) for r in profiles.best_places(p, F.col("entity").cast("int") % 2 == 0, windows).collect()} == want


@pytest.mark.parametrize("seed", [5, 6])
def test_null_baseline_agrees_with_scores_of_all_pairs(spark, monkeypatch, seed):
    small_tiles(monkeypatch)
    p = odd_profiles(spark, seed)
    own = {}
    for r in profiles.score_pairs(p, p).collect():
        if r["source"] != r["target"]:
            own.setdefault(r["source"], []).append((r["target"], r["weighted_jaccard"]))
    got = {(r["query"], r["id"]): tuple(r)[2:] for r in profiles.null_baseline(p, F.col("entity").cast("int") % 2 == 0, F.col("entity").cast("int") % 2 == 1, 0.5).collect()}
    assert got.keys() == {(e, t) for e, rows in own.items() if int(e) % 2 == 0 for t, _ in rows}
    for (e, t), (score, z, qualified) in got.items():
        base = [s for i, s in own[e] if int(i) % 2 == 1]
        spread = statistics.stdev(base) if len(base) > 1 else 0
        want = (dict(own[e])[t] - statistics.fmean(base)) / spread if spread else None
        assert near(score, dict(own[e])[t]) and (z == want or abs(z - want) < 1e-6) and qualified == (want is not None and want >= 0.5)
