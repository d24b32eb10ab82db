"""The reference-style operators on small fixtures with results worked out by hand or by brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from weft.functions import labels
from weft.operators import edges as E
from weft.operators import filters, lines, mapping, profiles, similarity, skeleton, vectors
from weft.operators import graph as G
from weft.operators import measures as M


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


EDGES = [("N0", "N3", 5), ("N1", "N3", 2), ("N2", "N3", 1), ("N0", "N4", 4), ("N3", "N5", 3), ("N4", "N5", 6), ("N5", "N0", 2)]
TYPES = [("N0", "T0"), ("N1", "T1"), ("N2", "T0"), ("N3", "T2"), ("N4", "T2"), ("N5", "T1")]


def test_thresholded_totals(spark):
    e = frame(spark, EDGES, "pre string, post string, weight bigint")
    t = frame(spark, TYPES, "bodyId string, type string")
    assert rows(E.incoming_by_node(E.pair_mass(e, 3)), "post", "total") == [("N3", 5), ("N4", 4), ("N5", 9)]
    assert rows(E.incoming_by_type(E.pair_mass(e, 1), t), "type", "total") == [("T0", 2), ("T1", 9), ("T2", 12)]
    assert rows(E.pair_mass(frame(spark, [("a", "b", 1), ("a", "b", 2), ("c", "b", 2)], "pre string, post string, weight bigint"), 3), "pre", "weight") == [("a", 3)]


def test_ratios_over_all_sources(spark):
    e = frame(spark, [("A", "T", 10), ("B", "T", 30), ("C", "T", 160), ("A", "U", 25), ("B", "U", 15)], "pre string, post string, weight bigint")
    got = {(r["pre"], r["post"]): r["ratio"] for r in E.with_ratio(e).collect()}
    assert got == {("A", "T"): 0.05, ("B", "T"): 0.15, ("C", "T"): 0.8, ("A", "U"): 0.625, ("B", "U"): 0.375}


def test_group_aggregate_with_global_denominators(spark):
    edge = [("1", "10", 5), ("1", "10", 5), ("1", "11", 4), ("2", "10", 6), ("3", "12", 7), ("4", "12", 9), ("1", "12", 8), ("6", "12", 3), ("5", "13", 2), ("7", "14", 40)]
    label = {"1": "A", "2": "A", "3": "A", "4": "B", "6": "X", "5": "C", "7": "D", "10": "X", "11": "X", "12": "Y", "13": "Z", "14": "W"}
    total = [("10", 20), ("11", 10), ("12", 50), ("13", 10), ("14", 100)]
    out = E.aggregate_groups(frame(spark, edge, "pre string, post string, weight bigint"), frame(spark, list(label.items()), "bodyId string, label string"), frame(spark, total, "post string, total bigint"))
    got = {(r["pre"], r["post"]): (r["weight"], r["ratio"]) for r in out.collect()}
    assert got["A", "X"] == (15, 0.5) and got["A", "Y"] == (15, 0.3) and got["B", "Y"] == (9, 0.18) and got["C", "Z"] == (2, 0.2) and got["D", "W"] == (40, 0.4)
    local = E.aggregate_groups(frame(spark, edge, "pre string, post string, weight bigint"), frame(spark, list(label.items()), "bodyId string, label string"), frame(spark, total[:-1], "post string, total bigint"))
    assert {(r["pre"], r["post"]): r["ratio"] for r in local.collect()}["D", "W"] == 1.0


def test_density_curve(spark):
    w = frame(spark, [(5,), (3,), (8,), (1,), (12,)], "weight bigint")
    got = rows(E.density_curve(w, list(range(14))), "t", "n")
    assert got == [(t, sum(x >= t for x in (5, 3, 8, 1, 12))) for t in range(14)]


def test_filter_language(spark):
    n = frame(spark, [("101", "aMe12", "aMe12_R"), ("102", "aMe12", "aMe12_L"), ("103", "DN1p", "DN1p_R"), ("104", "Mi1", "Mi1"), ("105", None, None)], "bodyId string, type string, instance string")
    ids = lambda spec: [r[0] for r in n.where(filters.structured(n, spec, ["type", "instance"])).orderBy("bodyId").select("bodyId").collect()]
    assert ids({"contains": ["aMe"]}) == ["101", "102"]
    assert ids({"regex": ["_R$"], "not_contains": ["DN"]}) == ["101"]
    assert ids({"regex": ["aMe12("]}) == []
    assert filters.resolve_tokens(n, frame(spark, [("aMe12",), ("zz",)], "token string"), ["type", "instance"]).count() == 3


PATHS = [("S1", "A", 10), ("S1", "B", 6), ("A", "T", 8), ("B", "T", 8), ("A", "B", 3), ("S2", "A", 5)]


def test_paths_of_small_graph(spark):
    e = frame(spark, PATHS, "pre string, post string, weight bigint")
    s, t = frame(spark, [("S1",), ("S2",)], "node string"), frame(spark, [("T",)], "node string")
    want = [("S1-A-B-T", 3.0), ("S1-A-T", 8.0), ("S1-B-T", 6.0), ("S2-A-B-T", 3.0), ("S2-A-T", 5.0)]
    assert rows(G.simple_paths(e, s, t, 3).select(F.array_join("path", "-").alias("p"), "bottleneck"), "p", "bottleneck") == want
    assert rows(G.half_way_paths(e, s, t, 3).select(F.array_join("path", "-").alias("p")), "p") == [(p,) for p, _ in want]
    assert rows(G.shortest_paths(e, s, t, 3).select(F.array_join("path", "-").alias("p")), "p") == [("S1-A-T",), ("S1-B-T",), ("S2-A-T",)]
    assert rows(G.widest(e, t, 3), "node", "width") == [("A", 8.0), ("B", 8.0), ("S1", 8.0), ("S2", 5.0)]


def test_strongest_paths_keep_ties(spark):
    e = frame(spark, [("S", "A", 9), ("A", "T", 9), ("S", "B", 5), ("B", "T", 5), ("S", "C", 2), ("C", "T", 2), ("S", "D", 7), ("D", "T", 7)], "pre string, post string, weight bigint")
    s, t = frame(spark, [("S",)], "node string"), frame(spark, [("T",)], "node string")
    p, facts = G.strongest_paths(e, s, t, 2, 2)
    assert rows(p.select(F.array_join("path", "-").alias("p")), "p") == [("S-A-T",), ("S-D-T",)]
    assert facts == {"tau": 7.0, "w2": 5.0, "bitten": True}
    assert G.threshold_provenance(3, 7.0, 5.0, True)["applied"] == 6
    assert G.strongest_paths(e, s, t, 2, 99)[1]["bitten"] is False


def test_paths_against_brute_force(spark):
    rnd = random.Random(11)
    nodes = [f"n{i}" for i in range(9)]
    g = {(a, b): rnd.randint(1, 9) for a, b in itertools.permutations(nodes, 2) if rnd.random() < 0.3}
    e = frame(spark, [(a, b, w) for (a, b), w in g.items()], "pre string, post string, weight bigint")
    src, tgt = nodes[:2], nodes[5:7]
    want = set()

    def walk(p):
        if len(p) > 1 and p[-1] in tgt:
            want.add("-".join(p))
        if len(p) < 5:
            for b in nodes:
                if (p[-1], b) in g and b not in p:
                    walk([*p, b])

    for s in src:
        walk([s])
    df = lambda x: frame(spark, [(v,) for v in x], "node string")
    got = {r[0] for r in G.simple_paths(e, df(src), df(tgt), 4).select(F.array_join("path", "-")).collect()}
    assert got == want
    kept, least = G.edge_budget(e, df(src), df(tgt), 4, 12)
    assert kept.count() <= 12
    full = G.cone(e, df(src), df(tgt), 4)
    for w in sorted(set(g.values())):
        n = G.cone(full.where(F.col("weight") >= w), df(src), df(tgt), 4).count()
        if n <= 12:
            assert least == w and n == kept.count()
            break


def test_components_batches_and_coverage(spark):
    c = rows(G.name_components(frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")), "node", "component")
    assert c == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    assert G.compose_batches({"c": 2, "a": 3, "b": 4}, budget=6) == [["a"], ["b", "c"]]
    pop = frame(spark, [("a", "T"), ("b", "T"), ("c", "U")], "node string, type string")
    assert G.coverage_met(frame(spark, [("a",), ("c",)], "node string"), pop, 0.5)
    assert not G.coverage_met(frame(spark, [("a",)], "node string"), pop, 0.5)
    assert not G.coverage_met(frame(spark, [("a",)], "node string"), pop.limit(0), 0.5)


def test_set_measures(spark):
    long = frame(spark, [("d1", "A>B", 10.0), ("d2", "A>B", 8.0), ("d1", "A>C", 5.0), ("d2", "B>C", 4.0), ("d1", "C>D", 3.0), ("d2", "C>D", 3.0)], "dataset string, key string, value double")
    r = similarity.pair_metrics(long, frame(spark, [("d1",), ("d2",), ("d3",), ("d4",)], "dataset string")).collect()
    got = {(x["d1"], x["d2"]): x for x in r}
    assert got["d1", "d2"]["jaccard"] == 0.5 and got["d3", "d4"]["jaccard"] == 1.0 and got["d1", "d3"]["jaccard"] == 0.0
    assert got["d1", "d2"]["spearman"] is None and round(got["d1", "d2"]["pearson"], 6) == 1.0


def test_profile_scores_against_numpy(spark):
    rnd = random.Random(5)
    sets = {f"e{i}": {f"p{j}": float(rnd.randint(0, 4)) for j in rnd.sample(range(12), rnd.randint(1, 8))} for i in range(14)}
    df = frame(spark, [(e, p, w) for e, m in sets.items() for p, w in m.items()], "entity string, partner string, weight double")
    got = {(r["source"], r["target"]): r for r in profiles.score_pairs(df, df).collect()}

    def ranks(x):
        x = np.array(x)
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    for a, b in itertools.product(sets, sets):
        x, y = ({k: v for k, v in sets[s].items() if v > 0} for s in (a, b))
        if not set(x) & set(y):
            assert (a, b) not in got
            continue
        keys = sorted(set(x) | set(y))
        u, v = [x.get(k, 0) for k in keys], [y.get(k, 0) for k in keys]
        g = got[a, b]
        assert abs(g["jaccard"] - len(set(x) & set(y)) / len(keys)) < 1e-8
        assert abs(g["weighted_jaccard"] - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 1e-8
        if len(keys) < 3 or len(set(u)) < 2 or len(set(v)) < 2:
            assert g["rank_union"] is None
        else:
            assert abs(g["rank_union"] - np.corrcoef(ranks(u), ranks(v))[0, 1]) < 1e-6


def test_votes_and_labels(spark):
    v = frame(spark, [("a", "x", 5), ("a", "y", 2), ("b", "x", 3), ("b", "y", 2), ("c", "z", 1)], "source_name string, target_name string, votes bigint")
    assert rows(mapping.dominant(v), "source_name", "target_name") == [("a", "x"), ("c", "z")]
    n = frame(spark, [("1", "T", "L1"), ("2", "T", None), ("3", "U", None), ("4", "L1", None)], "bodyId string, type string, label string")
    assert rows(mapping.residual_types(n), "bodyId", "effective") == [("1", "L1"), ("2", "T*"), ("3", "U"), ("4", "L1*")]
    p = mapping.expand_profile(frame(spark, [("e", "a", 6.0), ("e", "q", 1.0)], "entity string, partner string, weight double"), v)
    assert rows(p, "partner", "weight") == [("q", 1.0), ("x", 3.0), ("y", 3.0)]


def test_line_ranking(spark):
    m = frame(spark, [("A", f"q{i}", "d", "t", 0.6) for i in range(3)] + [("B", f"q{i}", "d", "t", 0.95) for i in range(2)], "line string, body string, dataset string, type string, score double")
    got = {r["line"]: (r["coverage"], r["weighted_score"]) for r in lines.line_summary(m, 4).collect()}
    assert got == {"A": (0.75, 0.45), "B": (0.5, 0.475)}


def test_vectors_and_regions(spark):
    c = frame(spark, [("1", "A(R)", 10), ("1", "M", 5), ("2", "A(L)", 10), ("2", "M", 5), ("3", "A(R)", 10), ("3", "M", 50)], "id string, roi string, n bigint")
    r = vectors.region_screen(c, frame(spark, [("1",)], "id string")).orderBy(F.desc("score")).first()
    assert (r["id"], r["mirrored"]) == ("2", 1.0)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    w = np.array([r["v"] for r in vectors.zca(df, "v", 5).orderBy("id").collect()])
    assert np.allclose(np.cov(w.T, bias=True), np.eye(5), atol=1e-8)
    near = vectors.nearest(df.where("id = 0"), df, 3).orderBy("rank").collect()
    cos = x @ x[0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0])
    assert [r["id"] for r in near] == [i for i in np.argsort(-cos) if i != 0][:3]
    assert vectors.nearest(df.limit(0), df, 3).count() == 0


def test_skeleton(spark):
    n = frame(spark, [(1, 0, -1, 0.0), (1, 1, 0, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 100.0), (1, 4, 3, 101.0)], "body int, node_id int, parent_id int, x double").selectExpr("*", "0D as y", "0D as z", "1D as radius")
    m = skeleton.morphometrics(n).first()
    assert (m["n_nodes"], m["n_branches"], m["n_tips"], m["cable"]) == (5, 1, 2, 102.0)
    assert rows(skeleton.extrusions(n, 10), "node_id") == [(3,)]


def test_auc_and_threshold(spark):
    rnd = random.Random(2)
    data = [(rnd.randint(0, 9) + (2 if g else 0), g) for g in (True, False) for _ in range(60)]
    df = frame(spark, [(float(s), g) for s, g in data], "score double, good boolean")
    good, bad = [s for s, g in data if g], [s for s, g in data if not g]
    want = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert abs(profiles.auc(df).first()[0] - want) < 1e-8
    best = profiles.youden(df).first()
    assert abs(best["j"] - max(sum(a > t for a in good) / 60 - sum(b > t for b in bad) / 60 for t in np.arange(0.5, 11.5))) < 1e-8


def test_labels_are_stripped_until_nothing_is_left(spark):
    rnd = random.Random(1)
    parts = ["(", ")", "_L", "_R", " ", "\t", "nan", "Unknown", "12", "hb3", "a", "x_", "_U", " ", "None", "<na>", "hb"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(1500)] + ["(" * 20000 + "Unknown" + ")" * 20000, "a" * 90000 + ")" * 3000, "(((((((((x)_L)))_R)))))"]

    def brute(v):
        t, untyped = v.strip(), False
        while True:
            untyped = untyped or not t or t.lower() in labels.UNTYPED_WORDS or t.isdigit() or (t.lower().startswith("hb") and t[2:].isdigit())
            if t.endswith(("_L", "_R", "_U")):
                t = t[:-2].strip()
            elif t.startswith("(") and t.endswith(")"):
                t = t[1:-1].strip()
            else:
                return t, untyped

    rows = spark.createDataFrame([(v,) for v in texts], "v string").select("v", labels.bare_label(F.col("v")), labels.is_untyped(F.col("v"))).collect()
    assert [(b, u) for _, b, u in rows] == [brute(v) for v, _, _ in rows]


def test_normalised_types_by_hand(spark):
    own = frame(spark, [("KCg-m", "KC"), ("t4a", "T4")], "name string, target string")
    got = frame(spark, [("T4a_R",), ("aMe12_1",), ("T4a-like",), ("KCg-m",), ("Mi1_left",), (None,), ("",)], "v string").select("v", M.normalized_type(F.col("v"), own), M.normalized_type(F.col("v"), None, sides=False, numbers=False)).collect()
    assert [tuple(r)[1:] for r in got] == [("T4", "t4a_r"), ("ame12", "ame12_1"), ("T4", "t4a"), ("kc", "kcg-m"), ("mi", "mi1_left"), ("", ""), ("", "")]


def test_line_classes(spark):
    names = ["SS01", "jrc_ss2", "BJD_SS1", "LLPC3", "LC10", "LPCx", "VT1", "R1", "GMR_2", "", None, "xSS1"]
    got = [r[0] for r in frame(spark, [(x,) for x in names], "v string").select(lines.line_class(F.col("v"))).collect()]
    assert got == ["split_gal4"] * 6 + ["gal4_lexa"] * 6


def test_threshold_ladder():
    assert M.same_threshold_ladder({"a": (3, 35), "b": (1, 50)}, 5) == [3, 4, 5, 7, 11, 19, 35]
    assert M.same_threshold_ladder({"a": (3, 3)}, 5) == [3] and M.same_threshold_ladder({"a": (1, 2), "b": (5, 9)}, 5) == [] and M.same_threshold_ladder({}, 5) == []


def test_best_threshold_names_none_below_the_range(spark):
    long = frame(spark, [("a", f"k{i}", float(i)) for i in range(1, 11)] + [("b", "k", 2.0)], "dataset string, key string, value double")
    got = {r["dataset"]: tuple(r)[1:] for r in M.best_thresholds(M.threshold_curve(long, 12), 4, 0.1).collect()}
    assert got["a"] == (7, 7, 7, 4, 0.0, "exact") and got["b"] == (None, None, None, 1, 0.75, "target_density_below_range")
