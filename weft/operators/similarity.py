"""Alignment of edge sets across datasets and their similarity.

Sets of any size are compared through one inner join on the shared keys: what a measure needs of the union follows
from the sums of either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(partition: list[str], value: Column, descending: bool = False) -> Column:
    """Ranks from 1 in which equal values share the mean of their places."""
    order = value.desc() if descending else value.asc()
    return (F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2.0).cast("double")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """The correlation from sums; null with fewer than two pairs or a constant side."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 1e-12 * F.abs(n * sxx)) & (vy > 1e-12 * F.abs(n * syy)), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def aligned(long: DataFrame, datasets: list[str]) -> DataFrame:
    """``key`` and one column per dataset with its summed value, null where it lacks the key."""
    return long.groupBy("key").pivot("dataset", datasets).agg(F.sum("value"))


def _self_pairs(long: DataFrame, by: list[str]) -> DataFrame:
    a = long.select(*by, "key", F.col("dataset").alias("d1"), F.col("value").alias("x"))
    b = long.select(*by, "key", F.col("dataset").alias("d2"), F.col("value").alias("y"))
    return a.join(b, [*by, "key"]).where("d1 < d2")


def pair_metrics(long: DataFrame, datasets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per pair of datasets d1 < d2 with their similarity measures.

    ``long`` has ``dataset, key, value`` (unique keys per dataset) and ``by``; ``datasets`` has ``dataset`` (and ``by``)
    of all datasets to compare, so empty ones are seen. Two empty sets have a Jaccard similarity of 1.
    """
    by = by or []
    side = long.groupBy(*by, "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    known = datasets.join(side, [*by, "dataset"], "left").na.fill(0, ["n", "s", "ss"])
    one = known.select(*by, F.col("dataset").alias("d1"), F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("ss").alias("ss1"))
    two = known.select(*by, F.col("dataset").alias("d2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("ss").alias("ss2"))
    frame = (one.join(two, by) if by else one.join(two, F.lit(True))).where("d1 < d2")
    share = long.join(side.select(*by, "dataset", F.col("s").alias("__s")), [*by, "dataset"]).withColumn("share", F.when(F.col("__s") > 0, F.col("value") / F.col("__s")).otherwise(0.0))
    a = share.select(*by, "key", F.col("dataset").alias("d1"), F.col("value").alias("x"), F.col("share").alias("px"))
    b = share.select(*by, "key", F.col("dataset").alias("d2"), F.col("value").alias("y"), F.col("share").alias("py"))
    met = a.join(b, [*by, "key"]).where("d1 < d2")
    met = met.withColumns({"rx": average_rank([*by, "d1", "d2"], F.col("x")), "ry": average_rank([*by, "d1", "d2"], F.col("y"))})
    sums = met.groupBy(*by, "d1", "d2").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(F.least("px", "py")).alias("low"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum("rx").alias("rx"), F.sum("ry").alias("ry"), F.sum(F.col("rx") * F.col("rx")).alias("rxx"), F.sum(F.col("ry") * F.col("ry")).alias("ryy"), F.sum(F.col("rx") * F.col("ry")).alias("rxy"),
    )
    out = frame.join(sums, [*by, "d1", "d2"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("shared", "low", "sxy")})
    c = F.col
    union = c("n1") + c("n2") - c("shared")
    p1, p2 = F.when(c("s1") > 0, 1.0).otherwise(0.0), F.when(c("s2") > 0, 1.0).otherwise(0.0)
    high = p1 + p2 - c("low")
    distance2 = F.greatest(c("ss1") + c("ss2") - 2 * c("sxy"), F.lit(0.0))
    norms = F.sqrt("ss1") + F.sqrt("ss2")
    r9 = lambda x, name: F.round(x, 9).alias(name)
    return out.select(
        *by, "d1", "d2", "n1", "n2", "shared", r9(F.when(union == 0, 1.0).otherwise(c("shared") / F.nullif(union, F.lit(0))), "jaccard"), r9(F.when(c("n1") > 0, c("shared") / F.nullif(c("n1"), F.lit(0))).otherwise(0.0), "overlap_1"), r9(F.when(c("n2") > 0, c("shared") / F.nullif(c("n2"), F.lit(0))).otherwise(0.0), "overlap_2"),
        r9(F.when(high > 0, c("low") / F.nullif(high, F.lit(0.0))).otherwise(0.0), "ruzicka"), r9(pearson(c("shared").cast("double"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy")), "pearson"), r9(F.when(c("shared") >= 3, pearson(c("shared").cast("double"), c("rx"), c("ry"), c("rxx"), c("ryy"), c("rxy"))), "spearman"),
        r9(F.when((c("ss1") > 0) & (c("ss2") > 0), c("sxy") / F.nullif(F.sqrt(c("ss1") * c("ss2")), F.lit(0.0))).otherwise(0.0), "cosine"), r9(F.when(norms > 0, F.greatest(1 - F.sqrt(distance2) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))).otherwise(1.0), "frobenius"),
    )


def rv_coefficient(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rv`` of two ``pre, post, weight`` matrices, each centred on the mean of its cells over the union of nodes.

    Cells without an edge are zeros; they enter through their number only. 1 if both are constant, 0 if one is.
    """
    both = a.select("pre", "post", F.col("weight").cast("double").alias("x")).join(b.select("pre", "post", F.col("weight").cast("double").alias("y")), ["pre", "post"], "full").na.fill(0.0)
    nodes = both.select(F.explode(F.array("pre", "post")).alias("v")).distinct().agg(F.count(F.lit(1)).alias("k"))
    s = both.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("sx"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("sy"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("xx"), F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("yy"), F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("xy")).withColumn("n", F.greatest(nodes.scalar(), F.lit(1)).cast("double") * F.greatest(nodes.scalar(), F.lit(1)))
    c = F.col
    vx, vy, xy = c("xx") - c("sx") * c("sx") / c("n"), c("yy") - c("sy") * c("sy") / c("n"), c("xy") - c("sx") * c("sy") / c("n")
    tiny = 1e-12
    return s.select(F.round(F.when((vx <= tiny) & (vy <= tiny), 1.0).when((vx <= tiny) | (vy <= tiny), 0.0).otherwise(xy * xy / F.nullif(vx * vy, F.lit(0.0))), 9).alias("rv"))


def top_overlap(long: DataFrame, k: int) -> DataFrame:
    """``d1, d2, k, common, share``: how many of the ``k`` heaviest keys two datasets share, of equal ones the smaller.

    ``k`` shrinks to the smaller dataset.
    """
    ranked = long.withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("value"), "key"))).where(F.col("r") <= k)
    size = ranked.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    frame = size.select(F.col("dataset").alias("d1"), F.col("n").alias("n1")).join(size.select(F.col("dataset").alias("d2"), F.col("n").alias("n2")), F.col("d1") < F.col("d2")).withColumn("k", F.least("n1", "n2"))
    a, b = ranked.select("key", F.col("dataset").alias("d1"), F.col("r").alias("r1")), ranked.select("key", F.col("dataset").alias("d2"), F.col("r").alias("r2"))
    met = a.join(b, "key").where("d1 < d2").join(frame, ["d1", "d2"]).where((F.col("r1") <= F.col("k")) & (F.col("r2") <= F.col("k"))).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("common"))
    return frame.join(met, ["d1", "d2"], "left").select("d1", "d2", "k", F.coalesce("common", F.lit(0)).alias("common"), F.round(F.coalesce("common", F.lit(0)) / F.col("k"), 9).alias("share"))


def presence(long: DataFrame, threshold: float, n_datasets: int) -> DataFrame:
    """``key, n, kind``: in how many datasets a key reaches the threshold, and whether it is common, unique or between."""
    per = long.groupBy("key").agg(F.count_if(F.col("value") >= threshold).alias("n"))
    return per.where("n > 0").withColumn("kind", F.when(F.col("n") == n_datasets, "common").when(F.col("n") == 1, "unique").otherwise("shared"))


def differential(long: DataFrame, fold: float) -> DataFrame:
    """``key, d1, d2, x, y, fold``: keys whose values differ ``fold`` times or more, both raised by 1; absent counts 0."""
    ds = long.select("dataset").distinct()
    frame = long.select("key").distinct().join(ds.select(F.col("dataset").alias("d1")), F.lit(True)).join(ds.select(F.col("dataset").alias("d2")), F.col("d1") < F.col("d2"))
    a, b = long.select("key", F.col("dataset").alias("d1"), F.col("value").alias("x")), long.select("key", F.col("dataset").alias("d2"), F.col("value").alias("y"))
    both = frame.join(a, ["key", "d1"], "left").join(b, ["key", "d2"], "left").na.fill(0, ["x", "y"])
    ratio = F.greatest((F.col("x") + 1) / (F.col("y") + 1), (F.col("y") + 1) / (F.col("x") + 1))
    return both.select("key", "d1", "d2", "x", "y", F.round(ratio, 9).alias("fold")).where(F.col("fold") >= fold)


def wasserstein(values: DataFrame) -> DataFrame:
    """``d1, d2, w1``: the area between the distribution functions of ``value`` in two datasets, weighted by ``n``.

    ``values`` has ``dataset, value, n``. Per pair the distinct values of both are run through once.
    """
    per = values.groupBy("dataset", "value").agg(F.sum("n").alias("n"))
    per = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))
    ds = per.select("dataset").distinct()
    frame = ds.select(F.col("dataset").alias("d1")).join(ds.select(F.col("dataset").alias("d2")), F.col("d1") < F.col("d2"))
    left = frame.join(per, F.col("d1") == F.col("dataset")).select("d1", "d2", "value", "share")
    right = frame.join(per, F.col("d2") == F.col("dataset")).select("d1", "d2", "value", (-F.col("share")).alias("share"))
    steps = left.unionByName(right).groupBy("d1", "d2", "value").agg(F.sum("share").alias("g"))
    own = Window.partitionBy("d1", "d2").orderBy("value")
    run = steps.withColumns({"gap": F.sum("g").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "width": F.lead("value").over(own) - F.col("value")})
    return run.groupBy("d1", "d2").agg(F.round(F.coalesce(F.sum(F.abs("gap") * F.col("width")), F.lit(0.0)), 9).alias("w1"))


def netsimile(edges: DataFrame) -> DataFrame:
    """``dataset, feature, median, mad`` of out and in strength and degree per node."""
    ends = edges.select("dataset", F.inline(F.array(F.struct(F.col("pre").alias("node"), F.lit(1).alias("o"), "weight"), F.struct(F.col("post").alias("node"), F.lit(0).alias("o"), "weight"))))
    per = ends.groupBy("dataset", "node").agg(*[x for o, name in ((1, "out"), (0, "in")) for x in (F.sum(F.when(F.col("o") == o, F.col("weight")).otherwise(0)).cast("double").alias(f"{name}_strength"), F.count_if(F.col("o") == o).cast("double").alias(f"{name}_degree"))])
    long = per.select("dataset", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in ("out_strength", "in_strength", "out_degree", "in_degree")])))
    med = long.groupBy("dataset", "feature").agg(F.median("v").alias("median"))
    return long.join(med, ["dataset", "feature"]).groupBy("dataset", "feature", "median").agg(F.median(F.abs(F.col("v") - F.col("median"))).alias("mad"))


def netsimile_similarity(signatures: DataFrame) -> DataFrame:
    """``d1, d2, similarity``: 1 / (1 + the mean Canberra distance of the signatures)."""
    long = signatures.select("dataset", "feature", F.inline(F.array(F.struct(F.lit("m").alias("s"), F.col("median").alias("v")), F.struct(F.lit("d").alias("s"), F.col("mad").alias("v")))))
    a, b = long.select(F.col("dataset").alias("d1"), "feature", "s", F.col("v").alias("x")), long.select(F.col("dataset").alias("d2"), "feature", "s", F.col("v").alias("y"))
    total = F.abs("x") + F.abs("y")
    return a.join(b, ["feature", "s"]).where("d1 < d2").groupBy("d1", "d2").agg(F.round(1 / (1 + F.avg(F.when(total > 0, F.abs(F.col("x") - F.col("y")) / F.nullif(total, F.lit(0.0))).otherwise(0.0))), 9).alias("similarity"))


def mantel(a: DataFrame, b: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """``statistic, p_value`` of the permutation test of two small matrices ``pre, post, weight``.

    The statistic is the correlation of the cells off the diagonal over the union of nodes, mapped to 0..1. The dense
    matrix fits in one task by nature of the test; the permutations run in parallel tasks, seeded one by one.
    (0.5, 1.0) if undefined.
    """
    import numpy as np
    import pandas as pd

    spark = a.sparkSession
    x, y = a.toPandas(), b.toPandas()
    nodes = sorted({*x["pre"], *x["post"], *y["pre"], *y["post"]})
    at = {v: i for i, v in enumerate(nodes)}

    def dense(f: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(nodes), len(nodes)))
        np.add.at(m, ([at[v] for v in f["pre"]], [at[v] for v in f["post"]]), f["weight"].astype(float))
        return m

    mx, my, off = dense(x), dense(y), ~np.eye(len(nodes), dtype=bool)
    if len(nodes) < 3 or mx[off].std() == 0 or my[off].std() == 0:
        return spark.createDataFrame([(0.5, 1.0)], "statistic double, p_value double")
    r = float(np.corrcoef(mx[off], my[off])[0, 1])

    def run(batches):
        for f in batches:
            hits = []
            for i in f["id"]:
                p = np.random.default_rng([seed, int(i)]).permutation(len(nodes))
                hits.append(int(abs(np.corrcoef(mx[off], my[np.ix_(p, p)][off])[0, 1]) >= abs(r)))
            yield pd.DataFrame({"hit": hits})

    hits = spark.range(permutations).mapInPandas(run, "hit int").agg(F.sum("hit").alias("h"))
    return hits.select(F.lit((r + 1) / 2).alias("statistic"), ((F.col("h") + 1) / (permutations + 1)).alias("p_value"))
