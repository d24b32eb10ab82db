"""Further measures: normalised names, densities, supported similarities, thresholds that match, trimmed graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.similarity import wasserstein
from weft.operators.topn import top_n


def normalized_type(c: Column, mapping: DataFrame | None = None, fold: bool = True, sides: bool = True, numbers: bool = True, like: bool = True) -> Column:
    """A partner type in the form in which datasets are compared: the parts that are asked for are taken off in turn.

    ``fold`` lowers the case, ``sides`` takes off a last ``_L``, ``-left`` and the like, ``numbers`` a last number, ``like`` a
    last ``-like``. ``mapping`` (``name, target``, a small table) is looked up before and after. Null gives ''.
    """
    lookup = None
    if mapping is not None:
        lookup = mapping.agg(F.map_from_entries(F.collect_list(F.struct("name", "target")))).scalar()
    mapped = lambda x: x if lookup is None else F.coalesce(F.element_at(lookup, x), x)
    out = mapped(F.coalesce(c.cast("string"), F.lit("")))
    if fold:
        out = F.lower(out)
    for wanted, pattern in ((sides, r"(?i)[_-]?(?:[LR]|left|right)$"), (numbers, r"[_-]?[0-9]+$"), (like, r"(?i)[_-]?like$")):
        if wanted:
            out = F.regexp_replace(out, pattern, "")
    return mapped(out)


def edge_density(long: DataFrame, n_sources: int, n_targets: int, threshold: float = 1) -> DataFrame:
    """``dataset, actual_edges, possible_edges, edge_density`` of ``dataset, key, value``; empty without possible edges."""
    possible = n_sources * n_targets
    per = long.groupBy("dataset").agg(F.count_if(F.col("value") >= threshold).alias("actual_edges"))
    return per.where(F.lit(possible > 0)).select("dataset", "actual_edges", F.lit(possible).cast("bigint").alias("possible_edges"), (F.col("actual_edges") / F.lit(max(possible, 1))).alias("edge_density"))


def supported_jaccard(long: DataFrame, least: int) -> DataFrame:
    """``d1, d2, n1, n2, jaccard`` of the keys with a positive value; null where either side has fewer than ``least``."""
    known = long.where("value > 0").select("dataset", "key").distinct()
    size = long.select("dataset").distinct().join(known.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), "dataset", "left").na.fill(0, ["n"])
    frame = size.select(F.col("dataset").alias("d1"), F.col("n").alias("n1")).join(size.select(F.col("dataset").alias("d2"), F.col("n").alias("n2")), F.col("d1") < F.col("d2"))
    met = known.select("key", F.col("dataset").alias("d1")).join(known.select("key", F.col("dataset").alias("d2")), "key").where("d1 < d2").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("both"))
    both = F.coalesce("both", F.lit(0))
    value = F.when((F.col("n1") >= least) & (F.col("n2") >= least), both / F.nullif(F.col("n1") + F.col("n2") - both, F.lit(0)))
    return frame.join(met, ["d1", "d2"], "left").select("d1", "d2", "n1", "n2", F.round(value, 9).alias("jaccard"))


def hop_profile_distance(paths: DataFrame) -> DataFrame:
    """``d1, d2, w1``: the distance between the distributions of hops of the paths (``dataset, hops, value``) with a value."""
    return wasserstein(paths.where("value > 0").select("dataset", F.col("hops").cast("double").alias("value"), F.lit(1).alias("n")))


def edge_count_distance(a: Column, b: Column) -> Column:
    """How far two numbers of edges are from one another, as a part of the larger."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def threshold_curve(long: DataFrame, cap: int) -> DataFrame:
    """``dataset, t, n``: how many keys of each dataset have their largest value at ``t`` or above, for t from 1 to ``cap``.

    Values are counted first, so the range join meets counts.
    """
    counts = long.groupBy("dataset", "key").agg(F.max("value").alias("v")).groupBy("dataset", F.least(F.floor("v"), F.lit(cap)).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    frame = long.select("dataset").distinct().select("dataset", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("t"))
    return frame.join(counts, (frame["dataset"] == counts["dataset"]) & (counts["v"] >= frame["t"]), "left").groupBy(frame["dataset"], frame["t"]).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def best_thresholds(curve: DataFrame, anchor: int, tolerance: float) -> DataFrame:
    """``dataset, best_t, t_from, t_to, n, distance, status``: the threshold whose count comes nearest to ``anchor``.

    Of equally near ones the smallest; ``t_from`` to ``t_to`` have the same count. No threshold is named where even the
    lowest has fewer than ``anchor``.
    """
    best = curve.groupBy("dataset").agg(F.min_by("t", F.struct(F.abs(F.col("n") - anchor), "t")).alias("best_t"), F.min_by("n", F.struct(F.abs(F.col("n") - anchor), "t")).alias("n"), F.max("n").alias("most"))
    plateau = curve.select(F.col("dataset").alias("__d"), F.col("t").alias("__t"), F.col("n").alias("__n"))
    j = best.join(plateau, (F.col("dataset") == F.col("__d")) & (F.col("n") == F.col("__n"))).groupBy("dataset", "best_t", "n", "most").agg(F.min("__t").alias("t_from"), F.max("__t").alias("t_to"))
    below, far = F.col("most") < anchor, edge_count_distance(F.lit(anchor), F.col("n"))
    status = F.when(below, "target_density_below_range").when(F.col("n") == anchor, "exact").when(far <= tolerance, "within_tolerance").otherwise("outside_tolerance")
    named = lambda c: F.when(~below, F.col(c)).cast("int").alias(c)
    return j.select("dataset", named("best_t"), named("t_from"), named("t_to"), "n", F.round(far, 9).alias("distance"), status.alias("status"))


def same_threshold_ladder(windows: dict[str, tuple[int, int]], k: int) -> list[int]:
    """Thresholds at which all datasets are whole and have paths: both ends of the common window and points that halve it
    towards its lower end ``k`` times."""
    low, high = max((w[0] for w in windows.values()), default=1), min((w[1] for w in windows.values()), default=0)
    if high < low:
        return []
    return sorted({low, high, *(round(low + 0.5**n * (high - low)) for n in range(1, k + 1))} if high > low else {low})


def same_density_rows(curve: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """``level, dataset, t``: for evenly spaced densities that all datasets can have, the lowest threshold at or below each.

    ``curve`` has ``dataset, t, n``; the density is ``n`` by the number of nodes (``dataset, nodes``).
    """
    dense = curve.join(nodes, "dataset").select("dataset", "t", (F.col("n") / F.greatest("nodes", F.lit(1))).alias("density"))
    ends = dense.groupBy("dataset").agg(F.min_by("density", -F.col("t")).alias("low"), F.min_by("density", "t").alias("high")).agg(F.max("low").alias("lo"), F.min("high").alias("hi")).where("lo <= hi")
    step = (F.col("hi") - F.col("lo")) / F.lit(max(levels - 1, 1))
    wanted = ends.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.col("lo") + i * step)).alias("level", "wanted"))
    return wanted.join(dense, F.round("density", 12) <= F.round("wanted", 12)).groupBy("level", "dataset").agg(F.min("t").cast("int").alias("t"))


def interior_strength(weights: Column) -> Column:
    """The weakest hop of a path without its first and last one; of all hops if there are two or fewer."""
    return F.when(F.size(weights) > 2, F.array_min(F.slice(weights, F.lit(2), F.size(weights) - 2))).otherwise(F.array_min(weights))


def hop_list(c: Column) -> Column:
    """The numbers of a list that was written as text, ``[a, b]``; null if it is none."""
    return F.from_json(c, "array<double>")


def mapping_digest(mapping: DataFrame, key: str, label: str) -> DataFrame:
    """``digest``: twelve digits that depend on the pairs of a mapping only, not on their order.

    Pairs are hashed one by one and the hashes summed, so none are gathered.
    """
    pairs = mapping.where(F.col(key).isNotNull()).select(F.concat(F.col(key).cast("string"), F.lit("\x1f"), F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("p")).distinct()
    parts = [F.coalesce(F.sum(F.conv(F.substring(F.md5("p"), at, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for at in (1, 9, 17, 25)]
    return pairs.agg(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 12).alias("digest"))


def trim_to_strongest(edges: DataFrame, keep: int, sources: DataFrame, targets: DataFrame, reserve: int) -> DataFrame:
    """``edges`` (``pre, post, weight``) with ``reserved``: the ``reserve`` heaviest that leave a source or enter a target,
    and besides the ``keep`` heaviest others; of equal weights the smaller names come first."""
    ends = edges.join(sources.select(F.col("node").alias("pre"), F.lit(1).alias("__s")).distinct(), "pre", "left").join(targets.select(F.col("node").alias("post"), F.lit(1).alias("__t")).distinct(), "post", "left")
    flagged = ends.select("pre", "post", "weight", (F.col("__s").isNotNull() | F.col("__t").isNotNull()).alias("own"))
    order = [F.desc("weight"), F.asc("pre"), F.asc("post")]
    held = top_n(flagged.where("own").withColumn("__g", F.lit(1)), ["__g"], order, reserve).select("pre", "post", "weight")
    rest = top_n(flagged.join(held.select("pre", "post"), ["pre", "post"], "left_anti").withColumn("__g", F.lit(1)), ["__g"], order, keep).select("pre", "post", "weight")
    return held.withColumn("reserved", F.lit(True)).unionByName(rest.withColumn("reserved", F.lit(False)))


def own_type_grade(ranked: DataFrame, types: DataFrame, top_k: int) -> DataFrame:
    """``source, rank, via, grade``: the best rank at which a candidate of the source's own type stands within ``top_k``.

    ``ranked`` has ``source, target, rank_jaccard, rank_corr``; ``types`` has ``entity, type``. ``via`` is the ranking, Jaccard
    where both agree; the grade is high for the first rank, medium within ``top_k``, else low with a null rank.
    """
    a = ranked.join(types.select(F.col("entity").alias("source"), F.col("type").alias("own")), "source").join(types.select(F.col("entity").alias("target"), F.col("type").alias("other")), "target", "left")
    each = lambda c: F.min(F.when((F.col("own") == F.col("other")) & (F.col(c) <= top_k), F.col(c)))
    g = a.groupBy("source").agg(each("rank_jaccard").alias("j"), each("rank_corr").alias("c"))
    rank = F.least("j", "c")
    via = F.when(rank.isNull(), None).when(F.col("j") == rank, "jaccard").otherwise("rank_union")
    return g.select("source", rank.alias("rank"), via.alias("via"), F.when(rank == 1, "high").when(rank.isNotNull(), "medium").otherwise("low").alias("grade"))


def own_windows(types: DataFrame, multiplier: int) -> DataFrame:
    """``entity, window``: how many candidates a source may have, ``multiplier`` times the size of its own type."""
    return types.join(types.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type").select("entity", (F.col("n") * multiplier).alias("window"))
