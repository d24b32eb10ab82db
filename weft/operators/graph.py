"""Graph operators on ``pre, post, weight`` edges. Loops run on the driver, all data stays in tables.

Each round of a loop is cut with a checkpoint, so plans do not grow. A bound counts hops.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.skew import running_sums
from weft.session import cut

#: Edges that the first, heaviest tier of a tier search holds; each further tier holds four times as many.
FIRST_TIER = 256


def build(rows: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """A graph from rows: parallel edges are summed, rows with a null end are left out."""
    return rows.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("pre"), F.col(target).alias("post")).agg(F.sum(weight).alias("weight"))


def reverse(edges: DataFrame) -> DataFrame:
    """All edges turned round."""
    return edges.select(F.col("post").alias("pre"), F.col("pre").alias("post"), *[c for c in edges.columns if c not in ("pre", "post")])


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both in ``nodes.node``."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "pre"), "pre", "left_semi").join(n.withColumnRenamed("node", "post"), "post", "left_semi")


def collapse(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels: nodes of one label (``node, label``) merged, those without kept as they are."""
    a, b = labels.select(F.col("node").alias("pre"), F.col("label").alias("la")), labels.select(F.col("node").alias("post"), F.col("label").alias("lb"))
    j = edges.join(a, "pre", "left").join(b, "post", "left")
    return j.groupBy(F.coalesce("la", "pre").alias("pre"), F.coalesce("lb", "post").alias("post")).agg(F.sum("weight").alias("weight"))


def hops(edges: DataFrame, starts: DataFrame, bound: int, backward: bool = False) -> DataFrame:
    """``node, dist``: the fewest hops from any of ``starts.node``, at most ``bound``; starts are at 0."""
    step = (reverse(edges) if backward else edges).select("pre", "post").distinct()
    seen = cut(starts.select("node").distinct().withColumn("dist", F.lit(0)))
    for i in range(1, bound + 1):
        front = seen.where(F.col("dist") == i - 1)
        found = front.join(step, front["node"] == step["pre"]).select(F.col("post").alias("node")).distinct().join(seen, "node", "left_anti")
        found = cut(found.withColumn("dist", F.lit(i)))
        if found.isEmpty():
            break
        # both parts are already cut, and there are as many as hops
        seen = seen.unionByName(found)
    return seen


def cone(edges: DataFrame, sources: DataFrame, targets: DataFrame, bound: int) -> DataFrame:
    """The edges that lie on a walk of at most ``bound`` hops from a source to a target.

    An edge stays if its hops from the sources, itself and its hops to the targets fit the bound. The edges of the
    shortest ways to and from it then stay too, so distances do not change and a second pass would drop nothing.
    """
    ds = hops(edges, sources, bound - 1).select(F.col("node").alias("pre"), F.col("dist").alias("ds"))
    dt = hops(edges, targets, bound - 1, backward=True).select(F.col("node").alias("post"), F.col("dist").alias("dt"))
    return edges.join(ds, "pre").join(dt, "post").where(F.col("ds") + 1 + F.col("dt") <= bound).select(*edges.columns)


def widest(edges: DataFrame, targets: DataFrame, bound: int) -> DataFrame:
    """``node, width``: the largest bottleneck of a walk of 1 to ``bound`` hops from the node to a target."""
    base = targets.select("node").distinct().withColumn("width", F.lit(float("inf")))
    best, out = base, None
    for _ in range(bound):
        step = edges.join(best.select(F.col("node").alias("post"), "width"), "post")
        found = step.groupBy(F.col("pre").alias("node")).agg(F.max(F.least(F.col("weight").cast("double"), "width")).alias("width"))
        out = cut(found if out is None else found.unionByName(out).groupBy("node").agg(F.max("width").alias("width")))
        best = out.unionByName(base).groupBy("node").agg(F.max("width").alias("width"))
    return out


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, bound: int, pruned: bool = False, carry: str | None = None) -> DataFrame:
    """``path, weights, bottleneck`` of all paths of 1 to ``bound`` hops that visit no node twice.

    They start at ``sources.node`` and end at ``targets.node`` and may pass through other sources and targets.
    A prefix is only extended to nodes from which a target is still within reach. The paths of ``bound`` hops, by far the
    most, are not materialised. ``carry``, a column of edges that are unique, is gathered along each path as ``carried``.
    """
    kept = edges if pruned else cut(cone(edges, sources, targets, bound))
    reach = hops(kept, targets, bound, backward=True).select(F.col("node").alias("post"), "dist")
    extra = [F.first(carry).alias("__c")] if carry else []
    step = cut(kept.groupBy("pre", "post").agg(F.sum("weight").alias("weight"), *extra).join(reach, "post"))
    lists = {"weights": "weight", **({"carried": "__c"} if carry else {})}
    front = sources.select("node").distinct().select(F.array("node").alias("path"), *[F.expr("cast(array() as array<double>)").alias(c) for c in lists])
    ends = targets.select(F.col("node").alias("__end")).distinct()
    out = None
    for i in range(1, bound + 1):
        grown = front.join(step, F.element_at("path", -1) == F.col("pre")).where(~F.array_contains("path", F.col("post")) & (F.col("dist") + i <= bound))
        front = grown.select(F.array_append("path", F.col("post")).alias("path"), *[F.array_append(c, F.col(x).cast("double")).alias(c) for c, x in lists.items()])
        if i < bound:
            front = cut(front)
        # a path of all hops has come to a target
        done = front.join(ends, F.element_at("path", -1) == F.col("__end"), "left_semi") if i < bound else front
        out = done if out is None else out.unionByName(done)
        if i < bound and front.isEmpty():
            break
    return out.withColumn("bottleneck", F.array_min("weights"))


def half_way_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, bound: int) -> DataFrame:
    """``path`` of the same paths, by joining halves that meet in the middle."""
    kept = cut(cone(edges, sources, targets, bound).groupBy("pre", "post").agg(F.sum("weight").alias("weight")))

    def halves(e: DataFrame, starts: DataFrame, most: int) -> DataFrame:
        front = starts.select(F.array("node").alias("p")).distinct()
        out = front
        for _ in range(most):
            front = cut(front.join(e.select("pre", "post"), F.element_at("p", -1) == F.col("pre")).where(~F.array_contains("p", F.col("post"))).select(F.array_append("p", F.col("post")).alias("p")))
            out = out.unionByName(front)
        return out

    near, far = bound // 2 + bound % 2, bound // 2
    a = halves(kept, sources, near).select(F.col("p").alias("a"), F.element_at("p", -1).alias("mid"))
    b = halves(reverse(kept), targets, far).select(F.reverse("p").alias("b"), F.element_at("p", -1).alias("mid"))
    # a path of n hops is met once, with its first half of (n + 1) div 2 hops
    na, nb = F.size("a") - 1, F.size("b") - 1
    met = a.join(b, "mid").where((na + nb >= 1) & (na - nb).isin(0, 1))
    joined = met.withColumn("path", F.concat("a", F.slice(F.col("b"), F.lit(2), F.size("b")))).where(F.size(F.array_distinct("path")) == F.size("path"))
    return joined.select("path")


def _tier(edges: DataFrame, n: int) -> float | None:
    """The weight of the ``n``-th heaviest edge, or None if there are fewer."""
    counted = edges.groupBy("weight").agg(F.count(F.lit(1)).alias("c"))
    run = running_sums(counted, "weight", ["c"], descending=True)
    return run.where(F.col("upto_c") >= n).agg(F.max("weight")).first()[0]


def strongest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, bound: int, budget: int, per_pair: int | None = None) -> tuple[DataFrame, dict]:
    """The ``budget`` paths of largest bottleneck, with all ties of the last, and what the cut means.

    The facts are ``tau`` (the smallest bottleneck kept), ``w2`` (the largest one dropped, or None) and
    ``bitten`` (whether anything was dropped). Only edges of a tier of weights are expanded; the tier is widened
    until it holds ``budget`` paths and one weaker one, or all edges. ``per_pair`` keeps that many per source and
    target besides.
    """
    kept = cut(cone(edges, sources, targets, bound))
    tier = FIRST_TIER
    while True:
        least = _tier(kept, tier)
        paths = cut(simple_paths(kept if least is None else kept.where(F.col("weight") >= least), sources, targets, bound, pruned=True))
        top = paths.select("bottleneck").orderBy(F.desc("bottleneck")).limit(budget).agg(F.min("bottleneck"), F.count(F.lit(1))).first()
        weaker = paths.where(F.col("bottleneck") < (top[0] if top[0] is not None else 0)).agg(F.max("bottleneck")).first()[0]
        if least is None or (top[1] == budget and weaker is not None):
            break
        tier *= 4
    tau = top[0]
    out = paths.where(F.col("bottleneck") >= tau) if tau is not None else paths
    if per_pair:
        own = Window.partitionBy(F.element_at("path", 1), F.element_at("path", -1)).orderBy(F.desc("bottleneck"), F.size("path"), "path")
        out = paths.withColumn("__r", F.row_number().over(own)).where((F.col("__r") <= per_pair) & (F.col("bottleneck") >= tau)).drop("__r")
    return out, {"tau": tau, "w2": weaker, "bitten": weaker is not None}


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, cutoff: int) -> DataFrame:
    """``path, weights, bottleneck`` of all shortest paths of each source and target, of 1 to ``cutoff`` hops."""
    step = edges.select("pre", "post", "weight").groupBy("pre", "post").agg(F.sum("weight").alias("weight")).where("pre <> post")
    dist = cut(targets.select(F.col("node").alias("target"), "node").distinct().withColumn("dist", F.lit(0)))
    for i in range(1, cutoff + 1):
        front = dist.where(F.col("dist") == i - 1)
        found = front.join(step, front["node"] == step["post"]).select("target", F.col("pre").alias("node")).distinct().join(dist, ["target", "node"], "left_anti")
        found = cut(found.withColumn("dist", F.lit(i)))
        if found.isEmpty():
            break
        dist = dist.unionByName(found)
    front = dist.where("dist > 0").join(sources.select("node").distinct(), "node", "left_semi").select("target", "dist", F.array("node").alias("path"), F.expr("cast(array() as array<double>)").alias("weights"))
    out = None
    for _ in range(cutoff):
        nxt = dist.select(F.col("target").alias("t"), F.col("node").alias("n"), F.col("dist").alias("d"))
        grown = front.join(step, F.element_at("path", -1) == F.col("pre")).join(nxt, (F.col("target") == F.col("t")) & (F.col("post") == F.col("n")) & (F.col("d") == F.col("dist") - 1))
        front = cut(grown.select("target", F.col("d").alias("dist"), F.array_append("path", F.col("post")).alias("path"), F.array_append("weights", F.col("weight").cast("double")).alias("weights")))
        done = front.where("dist = 0").select("path", "weights")
        out = done if out is None else out.unionByName(done)
        front = front.where("dist > 0")
        if front.isEmpty():
            break
    return out.withColumn("bottleneck", F.array_min("weights"))


def edge_budget(edges: DataFrame, sources: DataFrame, targets: DataFrame, bound: int, cap: int, probes: int = 8) -> tuple[DataFrame, float | None]:
    """The cone of the weakest weight tier with at most ``cap`` edges, and that weight.

    Tiers are the distinct weights. The search starts at the weight of the ``cap``-th heaviest edge and bisects.
    None (and no edges) if even the heaviest tier exceeds the cap.
    """
    whole = cut(cone(edges, sources, targets, bound))
    if whole.count() <= cap:
        return whole, whole.agg(F.min("weight")).first()[0]
    counted = whole.groupBy("weight").agg(F.count(F.lit(1)).alias("c"), F.lit(1).alias("one"))
    tiers = cut(running_sums(counted, "weight", ["c", "one"]).withColumn("rank", F.col("upto_one")))
    edges_n = whole.count()
    start = tiers.where(edges_n - F.col("upto_c") + F.col("c") <= cap).agg(F.min("rank")).first()[0]
    lo, hi = 1, tiers.agg(F.max("rank")).first()[0]
    best, at = None, start or hi
    for _ in range(probes):
        if lo > hi:
            break
        least = tiers.where(F.col("rank") == at).first()["weight"]
        probe = cut(cone(whole.where(F.col("weight") >= least), sources, targets, bound))
        if probe.count() <= cap:
            best, hi = (probe, least), at - 1
        else:
            lo = at + 1
        at = (lo + hi) // 2
    return best if best else (edges.limit(0), None)


def path_table(edges: DataFrame, sources: DataFrame, targets: DataFrame, bound: int) -> DataFrame:
    """``source, target, path, hops, weights, ratios, min_weight, min_ratio``: each simple path with what its hops carry.

    ``edges`` has ``pre, post, weight, ratio``, each pair once. Paths with a hop of weight 0 or less are dropped. What hops
    carry is gathered while paths grow, so paths are neither taken apart nor joined with edges again.
    """
    paths = simple_paths(edges, sources, targets, bound, carry="ratio").withColumnRenamed("carried", "ratios")
    ratios = F.transform("ratios", lambda r: F.coalesce(r, F.lit(0.0)))
    rows = paths.where("bottleneck > 0").withColumns({"ratios": ratios, "source": F.element_at("path", 1), "target": F.element_at("path", -1), "hops": F.size("weights"), "min_weight": F.col("bottleneck").cast("bigint")})
    return rows.select("source", "target", F.array_join("path", "->").alias("path"), "hops", "weights", "ratios", "min_weight", F.array_min("ratios").alias("min_ratio"))


def label_paths(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct sequences of labels (``node, label``) of ``paths``, each with its number of paths."""
    key = paths.select("path").withColumn("id", F.array_join("path", "->")).dropDuplicates(["id"])
    named = key.select("id", F.posexplode("path").alias("pos", "node")).join(labels, "node", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "node").alias("l")))).alias("s"))
    return named.groupBy(F.array_join(F.transform("s", lambda x: x["l"]), "->").alias("labels")).agg(F.count(F.lit(1)).alias("n_paths"))


def walk_counts(edges: DataFrame, sources: DataFrame, bound: int) -> DataFrame:
    """``node, hops, n``: the number of walks of each length from the sources to each node."""
    step = edges.select("pre", "post").distinct()
    at = sources.select("node").distinct().withColumn("n", F.lit(1).cast("bigint"))
    out = None
    for i in range(1, bound + 1):
        at = cut(at.join(step, at["node"] == step["pre"]).groupBy(F.col("post").alias("node")).agg(F.sum("n").alias("n")))
        layer = at.select("node", F.lit(i).alias("hops"), "n")
        out = layer if out is None else out.unionByName(layer)
    return out


def coverage_met(reached: DataFrame, population: DataFrame, requirement: float) -> bool:
    """Whether of every type of ``population`` (``node, type``) at least ``max(1, ceil(requirement * n))`` are reached.

    An empty population never is.
    """
    per = population.join(reached.select("node").distinct().withColumn("hit", F.lit(1)), "node", "left").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit"))
    facts = per.agg(F.count(F.lit(1)), F.coalesce(F.bool_and(F.col("hit") >= F.greatest(F.lit(1), F.ceil(F.col("n") * requirement))), F.lit(False))).first()
    return facts[0] > 0 and facts[1]


def compose_batches(sizes: dict[str, int], budget: int = 0, fixed: int = 0) -> list[list[str]]:
    """Targets in order of their id, cut where a batch would exceed the ``budget`` of states or the ``fixed`` size."""
    out: list[list[str]] = []
    total = 0
    for t in sorted(sizes):
        if not out or (fixed and len(out[-1]) >= fixed) or (budget and total + sizes[t] > budget):
            out.append([])
            total = 0
        out[-1].append(t)
        total += sizes[t]
    return out


def threshold_provenance(requested: int, tau: float | None, w2: float | None, bitten: bool) -> dict:
    """The threshold that a run really applied: ``w2 + 1`` if its budget dropped paths, else the one requested."""
    effective = requested if not bitten or w2 is None else max(requested, math.floor(w2) + 1)
    return {"requested": requested, "tau": tau, "applied": effective, "raised": effective > requested}


def wl_features(edges: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """``feature, n``: Weisfeiler-Lehman labels of ``rounds`` rounds over both directions, and how many nodes have each.

    The labels of a node's neighbours are summed up by an order-free hash, so a hub gathers none of them.
    """
    ends = edges.select(F.inline(F.array(F.struct(F.col("pre").alias("node"), F.col("post").alias("other"), F.lit("o").alias("way")), F.struct(F.col("post").alias("node"), F.col("pre").alias("other"), F.lit("i").alias("way"))))).distinct()
    now = labels.select("node", F.md5(F.col("label")).alias("f")).unionByName(ends.select("node").distinct().join(labels, "node", "left_anti").select("node", F.md5(F.lit("")).alias("f")))
    out = now.groupBy(F.concat(F.lit("0:"), "f").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    for i in range(1, rounds + 1):
        seen = ends.join(now.select(F.col("node").alias("other"), "f"), "other")
        near = seen.groupBy("node").agg(F.sum(F.xxhash64("way", "f").cast("decimal(38,0)")).cast("string").alias("h"), F.count(F.lit(1)).alias("d"))
        now = cut(now.join(near, "node", "left").select("node", F.md5(F.concat_ws("|", "f", F.coalesce("h", F.lit("")), F.coalesce(F.col("d").cast("string"), F.lit("0")))).alias("f")))
        out = out.unionByName(now.groupBy(F.concat(F.lit(f"{i}:"), "f").alias("feature")).agg(F.count(F.lit(1)).alias("n")))
    return out


def kernel_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """``similarity``: the cosine of two feature counts; null if either is empty."""
    both = a.select("feature", F.col("n").alias("x")).join(b.select("feature", F.col("n").alias("y")), "feature", "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double") * F.sum(F.col("y") * F.col("y")).cast("double"))
    return both.agg(F.round(F.when(norm > 0, F.sum(F.col("x") * F.col("y")) / norm), 9).alias("similarity"))


def diverse_top(paths: DataFrame, k: int, reuse: int) -> DataFrame:
    """``source, target, path, rank``: up to ``k`` paths per pair in which an edge at one depth serves ``reuse`` times.

    Strongest first; places that the rule leaves empty are filled with the strongest paths put aside. It is greedy and
    order dependent, so it runs per pair, through all paths of the pair, which meet in one task.
    """
    import pandas as pd

    own = Window.partitionBy("source", "target").orderBy(F.desc("bottleneck"), F.size("path"), "path")
    ends = paths.select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("target"), "path", "bottleneck")
    ahead = ends.withColumn("o", F.row_number().over(own))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        chosen, aside = [], []
        for r in pdf.sort_values("o").itertuples():
            if len(chosen) == k:
                break
            hops_ = list(enumerate(zip(r.path, r.path[1:], strict=False)))
            if all(used.get(h, 0) < reuse for h in hops_):
                chosen.append(r)
                for h in hops_:
                    used[h] = used.get(h, 0) + 1
            elif len(aside) < k:
                aside.append(r)
        chosen = sorted(chosen + aside[: max(0, k - len(chosen))], key=lambda r: r.o)
        return pd.DataFrame({"source": [r.source for r in chosen], "target": [r.target for r in chosen], "path": ["->".join(r.path) for r in chosen], "rank": range(1, len(chosen) + 1)})

    return ahead.groupBy("source", "target").applyInPandas(pick, "source string, target string, path string, rank int")


def name_components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``a, b`` links is connected to.

    Smallest labels spread over links and through the labels' own labels, so few rounds are needed.
    """
    both = cut(links.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")), F.struct(F.col("a").alias("x"), F.col("a").alias("y")), F.struct(F.col("b").alias("x"), F.col("b").alias("y"))))).where("x is not null and y is not null").distinct())
    now = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component")))
    while True:
        near = both.join(now.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("c"))
        jump = now.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = cut(near.join(jump, "c").join(now, "node").select("node", F.least("c", "cc", "component").alias("new"), "component"))
        if new.where("new <> component").isEmpty():
            return now
        now = new.select("node", F.col("new").alias("component"))


def ratio_paths(slices: DataFrame, sources: DataFrame, targets: DataFrame, least_ratio: float, max_between: int, edge_cap: int | None = None, budget: int | None = None) -> tuple[DataFrame, dict]:
    """``path, weights, bottleneck`` of the paths whose hops carry at least ``least_ratio`` of the receiver's input.

    Ratios are taken over all sources before anything is filtered. ``max_between`` counts nodes between the ends.
    ``edge_cap`` bounds the edges by dropping the weakest ratios, ``budget`` the paths, with all ties of the last kept.
    """
    pairs = slices.groupBy("pre", "post").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy("post"))
    ratio = pairs.select("pre", "post", F.when(total > 0, F.col("w") / total).alias("weight")).where((F.col("weight") >= least_ratio) & (F.col("pre") != F.col("post")))
    bound = max_between + 1
    kept = cut(ratio)
    facts: dict = {"floor": least_ratio}
    if edge_cap:
        kept, facts["floor"] = edge_budget(kept, sources, targets, bound, edge_cap)
    if budget:
        paths, more = strongest_paths(kept, sources, targets, bound, budget)
        return paths, facts | more
    return simple_paths(kept, sources, targets, bound), facts


def batched_shortest(edges: DataFrame, sources: DataFrame, targets: DataFrame, cutoff: int, batch: int) -> DataFrame:
    """The shortest paths, found for contiguous batches of ``batch`` targets so the labels of one batch exist at a time.

    The targets are a stated set whose ids the driver holds.
    """
    names = [r["node"] for r in targets.select("node").distinct().toLocalIterator()]
    spark, out = edges.sparkSession, None
    for part in compose_batches(dict.fromkeys(names, 1), fixed=batch):
        one = shortest_paths(edges, sources, spark.createDataFrame([(x,) for x in part], "node string"), cutoff)
        out = one if out is None else out.unionByName(one)
    return out


def chain_paths(edges: DataFrame, chain: list[str], labels: DataFrame) -> DataFrame:
    """``path, bottleneck`` of the simple paths whose labels are ``chain``, hop by hop; ``labels`` has ``node, label``."""
    front = labels.where(F.col("label") == chain[0]).select(F.array("node").alias("path"), F.lit(float("inf")).alias("bottleneck"))
    for name in chain[1:]:
        own = labels.where(F.col("label") == name).select(F.col("node").alias("post"))
        step = edges.join(own, "post", "left_semi")
        grown = front.join(step, F.element_at("path", -1) == F.col("pre")).where(~F.array_contains("path", F.col("post")))
        front = cut(grown.select(F.array_append("path", F.col("post")).alias("path"), F.least("bottleneck", F.col("weight").cast("double")).alias("bottleneck")))
    return front


def layered_least(edges: DataFrame, chain: list[str], labels: DataFrame) -> DataFrame:
    """``hop, least``: per hop of a chain of labels, the smallest ratio among edges that lie on a whole realisation.

    ``edges`` has ``pre, post, ratio``. Nodes are kept if the first and the last layer are reached from them.
    """
    layers = [labels.where(F.col("label") == name).select("node") for name in chain]
    hops_: list[DataFrame] = []
    alive = layers[0]
    for name in layers[1:]:
        e = cut(edges.join(alive.withColumnRenamed("node", "pre"), "pre", "left_semi").join(name.withColumnRenamed("node", "post"), "post", "left_semi"))
        hops_.append(e)
        alive = e.select(F.col("post").alias("node")).distinct()
    out = None
    for i in range(len(hops_) - 1, -1, -1):
        e = cut(hops_[i].join(alive.withColumnRenamed("node", "post"), "post", "left_semi"))
        alive = e.select(F.col("pre").alias("node")).distinct()
        one = e.agg(F.min("ratio").alias("least")).select(F.lit(i + 1).alias("hop"), "least")
        out = one if out is None else out.unionByName(one)
    return out
