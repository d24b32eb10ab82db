"""Similarity of feature vectors and of region profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.topn import top_n
from weft.session import spread

#: Vectors that are held at once for a block of the similarity matrix.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    """The scalar product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, 0 if either has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def standardise(df: DataFrame, column: str, width: int) -> DataFrame:
    """``df`` with ``column`` in standard deviations from the mean of each dimension; constant ones are 0."""
    stats = df.agg(F.array(*[F.avg(F.col(column)[i]) for i in range(width)]).alias("mean"), F.array(*[F.stddev_pop(F.col(column)[i]) for i in range(width)]).alias("sd"))
    j = df.withColumns({"__m": stats.select("mean").scalar(), "__s": stats.select("sd").scalar()})
    z = F.zip_with(F.zip_with(F.col(column), F.col("__m"), lambda x, m: x.cast("double") - m), F.col("__s"), lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    return j.withColumn(column, z).drop("__m", "__s")


def zca(df: DataFrame, column: str, width: int, floor: float = 0.01, amplify: float = 10.0) -> DataFrame:
    """``df`` with ``column`` whitened: decorrelated with the least change.

    Moments are summed per task; the driver sees one ``width`` by ``width`` matrix. Eigenvalues below ``floor`` of the
    largest are raised to it and no direction is amplified more than ``amplify`` times.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            if len(b):
                x = np.stack(b[column].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    parts = df.select(column).mapInPandas(moments, "n bigint, s array<double>, q array<double>").collect()
    n = sum(p["n"] for p in parts)
    if n == 0:
        return df
    mean = sum(np.array(p["s"]) for p in parts) / n
    cov = sum(np.array(p["q"]) for p in parts).reshape(width, width) / n - np.outer(mean, mean)
    val, vec = np.linalg.eigh(cov)
    val = np.maximum(val, max(val.max(), 1e-12) * floor)
    w = vec @ np.diag(np.minimum(1 / np.sqrt(val), amplify)) @ vec.T

    @F.pandas_udf("array<double>")
    def whiten(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - mean) @ w) if len(v) else [])

    return df.withColumn(column, whiten(F.col(column)))


def block_cosine(a: Column, b: Column, split: int, width: int, weights: tuple[float, float]) -> Column:
    """The weighted mean of the cosines of the first ``split`` and the other dimensions; a block without length in
    either vector is left out, null if both are."""
    parts = [(F.slice(a, 1, split), F.slice(b, 1, split), weights[0]), (F.slice(a, split + 1, width - split), F.slice(b, split + 1, width - split), weights[1])]
    use = [F.when((dot(x, x) > 0) & (dot(y, y) > 0), F.lit(w)).otherwise(0.0) for x, y, w in parts]
    top = sum((u * cosine(x, y) for u, (x, y, _) in zip(use, parts, strict=True)), F.lit(0.0))
    return top / F.nullif(use[0] + use[1], F.lit(0.0))


def block_scaled(v: Column, split: int, width: int, weights: tuple[float, float]) -> Column:
    """``v`` with each block scaled to the root of its weight, so plain cosines are those of ``block_cosine`` for
    vectors whose blocks all have length."""

    def scaled(part: Column, w: float) -> Column:
        norm = F.sqrt(dot(part, part))
        return F.transform(part, lambda x: F.when(norm > 0, x.cast("double") / norm * math.sqrt(w)).otherwise(0.0))

    return F.concat(scaled(F.slice(v, 1, split), weights[0]), scaled(F.slice(v, split + 1, width - split), weights[1]))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query, id, similarity, rank``: the ``k`` vectors of largest cosine to each query, itself left out.

    ``queries`` and ``vectors`` have ``id, v``. Queries are a stated set; they are cut into blocks of ``BLOCK`` that go
    to all vectors in turn, and each task keeps ``k`` per query. Of equal similarity (12 digits) the smaller id comes first.
    """
    spark = vectors.sparkSession

    rows = queries.select("id", "v").toLocalIterator(prefetchPartitions=True)
    out, block = None, []

    def search(ids: list, m: np.ndarray) -> DataFrame:
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((np.array(ids), m / np.where(norms > 0, norms, 1)))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = sent.value
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["v"].to_numpy()).astype(float)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                sim = np.round(q @ (x / np.where(n > 0, n, 1)).T, 12)
                ids_ = b["id"].to_numpy()
                sim[q_ids[:, None] == ids_[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids_, sim.shape), -sim), axis=1)[:, :k]
                s = np.take_along_axis(sim, order, 1)
                r = pd.DataFrame({"query": np.repeat(q_ids, order.shape[1]), "id": ids_[order].ravel(), "similarity": s.ravel()})
                yield r[np.isfinite(r["similarity"])]

        return vectors.select("id", "v").mapInPandas(best, "query bigint, id bigint, similarity double")

    for r in rows:
        block.append(r)
        if len(block) == BLOCK:
            found = search([x["id"] for x in block], np.array([x["v"] for x in block], float))
            out, block = found if out is None else out.unionByName(found), []
    if block:
        found = search([x["id"] for x in block], np.array([x["v"] for x in block], float))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query bigint, id bigint, similarity double")
    return top_n(out, ["query"], [F.desc("similarity"), F.asc("id")], k)


def type_matrix(similar: DataFrame, sizes: DataFrame) -> DataFrame:
    """``t1, t2, similarity`` between types: the mean over pairs of different members, 1 within a single one.

    ``similar`` has ``t1, t2, a, b, s`` of all pairs of members; ``sizes`` has ``type, n``.
    """
    mean = similar.where("a <> b").groupBy("t1", "t2").agg(F.avg("s").alias("similarity"))
    single = sizes.where("n = 1").select(F.col("type").alias("t1"), F.col("type").alias("t2"), F.lit(1.0).alias("similarity"))
    return mean.unionByName(single)


def centroid_matrix(vectors: DataFrame) -> DataFrame:
    """``t1, t2, similarity``: the mean cosine of the members of two types, without pairs of a member with itself.

    ``vectors`` has ``id, type, v``. The mean over all pairs is the scalar product of the types' mean unit vectors, so no
    pair is formed.
    """
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    unit = vectors.select("type", F.posexplode(F.transform("v", lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))).alias("i", "x"))
    sums = unit.groupBy("type", "i").agg(F.sum("x").alias("x"))
    own = vectors.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(norm > 0).alias("self"))
    a, b = sums.select(F.col("type").alias("t1"), "i", F.col("x").alias("x1")), sums.select(F.col("type").alias("t2"), "i", F.col("x").alias("x2"))
    total = a.join(b, "i").groupBy("t1", "t2").agg(F.sum(F.col("x1") * F.col("x2")).alias("s"))
    j = total.join(own.select(F.col("type").alias("t1"), F.col("n").alias("n1"), "self"), "t1").join(own.select(F.col("type").alias("t2"), F.col("n").alias("n2")), "t2")
    same = F.col("t1") == F.col("t2")
    value = F.when(same & (F.col("n1") == 1), 1.0).when(same, (F.col("s") - F.col("self")) / F.nullif(F.col("n1") * (F.col("n1") - 1), F.lit(0))).otherwise(F.col("s") / (F.col("n1") * F.col("n2")))
    return j.select("t1", "t2", F.round(value, 6).alias("similarity"))


def mirror(roi: Column) -> Column:
    """The region of the other side: ``(L)`` and ``(R)`` swapped."""
    return F.when(roi.endswith("(L)"), F.regexp_replace(roi, r"\(L\)$", "(R)")).when(roi.endswith("(R)"), F.regexp_replace(roi, r"\(R\)$", "(L)")).otherwise(roi)


def region_screen(counts: DataFrame, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """``query, id, direct, mirrored, score, rank``: the ``top_k`` nearest region profiles, as they are and with sides swapped.

    ``counts`` has ``id, roi, n`` and maybe ``block`` (input or output); ``queries`` a stated set of ``id``, whose profiles
    the driver holds, as it does the names of regions. The cosines of the blocks that a query has are averaged, and the
    larger of both means counts. Pairs without a common region are left out. Each task passes on ``top_k`` per query and
    batch (all if it is None); of equal scores (9 digits) the smaller id comes first.
    """
    import pyarrow as pa

    spark = counts.sparkSession
    known = counts.withColumn("block", F.col("block") if "block" in counts.columns else F.lit("")).groupBy("id", "block", "roi").agg(F.sum("n").cast("double").alias("n")).where("n > 0")
    names = [(r["block"], r["roi"], r["other"]) for r in known.select("block", "roi", mirror(F.col("roi")).alias("other")).distinct().orderBy("block", "roi").collect()]
    if not names:
        return spark.createDataFrame([], "query string, id string, direct double, mirrored double, score double, rank int")
    at = {(b, roi): i for i, (b, roi, _) in enumerate(names)}
    place = spark.createDataFrame([(b, roi, i) for (b, roi), i in at.items()], "block string, roi string, i int")
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id", "block")))
    rows = known.withColumn("p", F.col("n") / norm).join(F.broadcast(place), ["block", "roi"]).groupBy("id").agg(F.collect_list("i").alias("i"), F.collect_list("p").alias("p"))

    def dense(i: list, p: list) -> np.ndarray:
        out = np.zeros((len(i), len(names)))
        for k, (a, b) in enumerate(zip(i, p, strict=True)):
            out[k, a] = b
        return out

    stated = list(rows.join(queries.select("id").distinct(), "id", "left_semi").toLocalIterator())
    own = np.array([r["id"] for r in stated], object)
    direct = dense([r["i"] for r in stated], [r["p"] for r in stated])
    mirrored = np.zeros_like(direct)
    for i, (b, _, other) in enumerate(names):
        if (b, other) in at:
            mirrored[:, at[b, other]] += direct[:, i]
    blocks = sorted({b for b, _, _ in names})
    has = sum((direct[:, [i for i, n in enumerate(names) if n[0] == b]] > 0).any(axis=1).astype(float) for b in blocks)
    direct, mirrored = direct / has[:, None], mirrored / has[:, None]
    few = max(top_k or 1, 2_000_000 // max(1, len(own)))  # ids at a time, so that a batch of pairs stays small

    def run(batches):
        mine = pa.array(own, pa.string())
        for batch in batches:
            ids, i, p = batch.column("id"), batch.column("i").to_pylist(), batch.column("p").to_pylist()
            for k in range(0, len(i), few):
                x, part = dense(i[k : k + few], p[k : k + few]), np.array(ids.slice(k, few).to_pylist(), object)
                order = np.argsort(part)  # columns in the order of ids, so that a stable sort breaks ties by them
                x, part = x[order], part[order]
                a, b = direct @ x.T, mirrored @ x.T
                score = np.round(np.maximum(a, b), 9)
                score[(score <= 0) & (a <= 0) & (b <= 0) | (own[:, None] == part[None, :])] = -1
                best = np.argsort(-score, axis=1, kind="stable")[:, :top_k]
                q = np.repeat(np.arange(len(own)), best.shape[1])
                at_ = best.ravel()
                keep = score[q, at_] >= 0
                q, at_ = q[keep], at_[keep]
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(q)), pa.array(part[at_], pa.string()), pa.array(a[q, at_]), pa.array(b[q, at_])], names=["query", "id", "direct", "mirrored"])

    met = spread(rows).mapInArrow(run, "query string, id string, direct double, mirrored double")
    met = met.select("query", "id", F.round("direct", 9).alias("direct"), F.round("mirrored", 9).alias("mirrored"), F.round(F.greatest("direct", "mirrored"), 9).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    return top_n(met, ["query"], order, top_k) if top_k else met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))


def hellinger(counts: DataFrame) -> DataFrame:
    """``id, roi, h``: the square root of each region's share."""
    total = counts.groupBy("id").agg(F.sum("n").alias("t"))
    return counts.groupBy("id", "roi").agg(F.sum("n").alias("n")).join(total, "id").where("t > 0").select("id", "roi", F.round(F.sqrt(F.col("n") / F.col("t")), 9).alias("h"))
