"""Thresholded edge views, their denominators, and aggregation from nodes to types and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the input share at which a connection counts as sure.
FULL_RATIO = 0.3


def pair_mass(slices: DataFrame, threshold: int = 1) -> DataFrame:
    """``pre, post, weight``: slices summed per pair, then pairs below ``threshold`` dropped (a pair of slices 1 and 2
    survives a threshold of 3)."""
    return slices.groupBy("pre", "post").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= threshold)


def incoming_by_node(edges: DataFrame) -> DataFrame:
    """``post, total``: all weight that arrives at a node."""
    return edges.groupBy("post").agg(F.sum("weight").alias("total"))


def incoming_by_type(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``type, total``: all weight that arrives at the nodes of a type."""
    return edges.join(types.select(F.col("bodyId").alias("post"), "type"), "post").groupBy("type").agg(F.sum("weight").alias("total"))


def with_ratio(edges: DataFrame) -> DataFrame:
    """``edges`` with ``ratio``: the share of the post node's input, over all its sources."""
    total = F.sum("weight").over(Window.partitionBy("post"))
    return edges.withColumn("ratio", F.when(total > 0, F.col("weight") / total))


def probability(ratio: Column) -> Column:
    """Traversal probability of an input share: in proportion up to ``FULL_RATIO``, then 1; 0 for null."""
    return F.greatest(F.least(F.coalesce(ratio / FULL_RATIO, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def aggregate_groups(edges: DataFrame, labels: DataFrame, totals: DataFrame | None, threshold: float = 0.0, method: str = "product") -> DataFrame:
    """``pre, post, weight, n_pairs, nt, ratio, probability`` between labels.

    ``edges`` has ``pre, post, weight`` and optionally ``nt``; ``labels`` has ``bodyId, label`` (one row per node,
    nodes without one stand for themselves); ``totals`` has ``post, total``, the global input of each node, or is
    None for local totals. Equal rows count once. The denominator of a label is the sum of the totals of its members
    that receive an edge here; if one of them has no global total the whole label falls back to its local total.
    ``nt`` is the most frequent one, of equally frequent ones the smallest.
    """
    nt = F.col("nt") if "nt" in edges.columns else F.lit(None).cast("string")
    rows = edges.select("pre", "post", "weight", nt.alias("nt")).distinct().groupBy("pre", "post").agg(F.sum("weight").alias("weight"), F.min("nt").alias("nt"))
    local = F.sum("weight").over(Window.partitionBy("post"))
    rows = rows.withColumn("__local", local)
    rows = rows.join(totals.select("post", F.col("total").alias("__global")), "post", "left") if totals is not None else rows.withColumn("__global", F.col("__local"))
    denominator = F.coalesce("__global", "__local")
    rows = rows.withColumn("__p", probability(F.when(denominator > 0, F.col("weight") / denominator)))
    if threshold > 0:
        rows = rows.where(F.col("__p") >= threshold)
    names = labels.select("bodyId", "label")
    rows = rows.join(names.select(F.col("bodyId").alias("pre"), F.col("label").alias("__a")), "pre", "left").join(names.select(F.col("bodyId").alias("post"), F.col("label").alias("__b")), "post", "left")
    rows = rows.withColumns({"__a": F.coalesce(F.nullif("__a", F.lit("")), "pre"), "__b": F.coalesce(F.nullif("__b", F.lit("")), "post")})
    members = rows.groupBy("__b", "post").agg(F.max("__global").alias("g"), F.sum("weight").alias("l"))
    whole = members.groupBy("__b").agg(F.when(F.bool_or(F.col("g").isNull()), F.sum("l")).otherwise(F.sum("g")).alias("__total"))
    joint = {"product": F.round(1 - F.product(1 - F.col("__p")), 12), "average": F.round(F.sum(F.col("__p") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0)), 12), "ratio": F.lit(None).cast("double")}[method]
    out = rows.groupBy("__a", "__b").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_pairs"), F.expr("mode(nt, true)").alias("nt"), joint.alias("probability")).join(whole, "__b")
    out = out.withColumn("ratio", F.when(F.col("__total") > 0, F.col("weight") / F.col("__total")))
    if method == "ratio":
        out = out.withColumn("probability", F.round(probability(F.col("ratio")), 12))
    return out.select(F.col("__a").alias("pre"), F.col("__b").alias("post"), "weight", "n_pairs", "nt", "ratio", "probability")


def type_pairs(edges: DataFrame, types: DataFrame, least: int) -> DataFrame:
    """``pre, post, w_sum, w_max, n`` between the types of edges of ``least`` weight or more."""
    named = edges.where(F.col("weight") >= least).join(types.select(F.col("bodyId").alias("pre"), F.col("type").alias("a")), "pre").join(types.select(F.col("bodyId").alias("post"), F.col("type").alias("b")), "post")
    return named.groupBy(F.col("a").alias("pre"), F.col("b").alias("post")).agg(F.sum("weight").alias("w_sum"), F.max("weight").alias("w_max"), F.count(F.lit(1)).alias("n"))


def tiered(edges: DataFrame, by: list[str], tiers: list[int]) -> DataFrame:
    """The sum and number of edges at each threshold of ``tiers``, all in one pass."""
    each = [x for t in tiers for x in (F.sum(F.when(F.col("weight") >= t, F.col("weight")).otherwise(0)).alias(f"w_{t}"), F.count_if(F.col("weight") >= t).alias(f"n_{t}"))]
    return edges.groupBy(*by).agg(*each)


def standardised(edges: DataFrame, axis: str) -> DataFrame:
    """Weights as a share of their row or column."""
    total = F.sum("weight").over(Window.partitionBy("pre" if axis == "row" else "post"))
    return edges.withColumn("share", F.when(total != 0, F.col("weight") / total))


def full_matrix(sources: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``pre, post, weight`` of every source and target, 0 where there is no edge.

    The result is as large as the matrix, which is what is asked for.
    """
    cells = sources.select("pre").distinct().join(targets.select("post").distinct(), F.lit(True))
    sums = edges.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))
    return cells.join(sums, ["pre", "post"], "left").select("pre", "post", F.coalesce("weight", F.lit(0)).alias("weight"))


def degrees(edges: DataFrame, threshold: int = 0) -> DataFrame:
    """``node, out_degree, in_degree, out_weight, in_weight`` of edges above ``threshold``."""
    ends = edges.where(F.col("weight") > threshold).select(F.inline(F.array(F.struct(F.col("pre").alias("node"), F.col("post").alias("other"), F.lit(1).alias("out"), F.col("weight")), F.struct(F.col("post").alias("node"), F.col("pre").alias("other"), F.lit(0).alias("out"), F.col("weight")))))
    per_pair = ends.groupBy("node", "other", "out").agg(F.sum("weight").alias("weight"))
    n = lambda o: F.count_if(F.col("out") == o)
    w = lambda o: F.sum(F.when(F.col("out") == o, F.col("weight")).otherwise(0))
    return per_pair.groupBy("node").agg(n(1).alias("out_degree"), n(0).alias("in_degree"), w(1).alias("out_weight"), w(0).alias("in_weight"))


def density_curve(weights: DataFrame, thresholds: list[int]) -> DataFrame:
    """``t, n, mass``: how many edges have ``weight >= t``, and their summed weight.

    Weights are first counted per value, so the range join meets distinct weights, not edges.
    """
    spark = weights.sparkSession
    hist = weights.groupBy("weight").agg(F.count(F.lit(1)).alias("c"))
    grid = spark.createDataFrame([(t,) for t in thresholds], "t bigint")
    return F.broadcast(grid).join(hist, F.col("weight") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * F.col("weight")), F.lit(0)).alias("mass"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """``a, b, forward, backward`` of the pairs a < b that are linked both ways."""
    back = edges.select(F.col("post").alias("pre"), F.col("pre").alias("post"), F.col("weight").alias("backward"))
    return edges.where("pre < post").join(back, ["pre", "post"]).select(F.col("pre").alias("a"), F.col("post").alias("b"), F.col("weight").alias("forward"), "backward")


def direct(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges from ``sources.pre`` to ``targets.post``."""
    return edges.join(sources.select("pre").distinct(), "pre", "left_semi").join(targets.select("post").distinct(), "post", "left_semi")


def network_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges among ``nodes.bodyId``, without those from a node to itself."""
    own = nodes.select("bodyId").distinct()
    return direct(edges, own.withColumnRenamed("bodyId", "pre"), own.withColumnRenamed("bodyId", "post")).where("pre <> post")


def mirror_pairs(edges: DataFrame) -> DataFrame:
    """Edges between labels with ``_L/_R`` ends compared with their mirror image.

    ``base_pre, base_post, kind`` (ipsi or contra), the weights seen from the left and the right, whether both exist,
    their ratio (smaller to larger) and difference.
    """
    side = lambda c: F.regexp_extract(c, "_([LR])$", 1)
    base = lambda c: F.regexp_replace(c, "_[LR]$", "")
    sided = edges.select(base("pre").alias("base_pre"), base("post").alias("base_post"), side("pre").alias("s"), F.when(side("pre") == side("post"), "ipsi").otherwise("contra").alias("kind"), "weight", side("post").alias("q")).where("s <> '' and q <> ''")
    out = sided.groupBy("base_pre", "base_post", "kind").agg(F.sum(F.when(F.col("s") == "L", F.col("weight")).otherwise(0)).alias("left"), F.sum(F.when(F.col("s") == "R", F.col("weight")).otherwise(0)).alias("right"))
    return out.select("*", ((F.col("left") > 0) & (F.col("right") > 0)).alias("conserved"), F.round(F.least("left", "right") / F.greatest("left", "right"), 9).alias("ratio"), F.abs(F.col("left") - F.col("right")).alias("diff"))
