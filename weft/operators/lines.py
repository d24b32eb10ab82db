"""Match tables between lines and bodies: ``line, body, dataset, type, score``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import tiles

#: First letters of the lines of the class ``split_gal4``, compared without case.
SPLIT_PREFIXES = ["SS", "LH", "MB", "IS", "OL", "LC", "LLPC", "LPC", "JRC_SS", "BJD_SS"]


def line_summary(matches: DataFrame, n_queries: int) -> DataFrame:
    """Per line: mean and best score, distinct bodies and datasets, coverage of ``n_queries`` and weighted score."""
    per_body = matches.groupBy("line", "body").agg(F.max("score").alias("best"), F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    per_set = matches.groupBy("line", "dataset").agg(F.max("score").alias("top")).groupBy("line").agg(F.min("top").alias("worst_dataset"), F.avg("top").alias("mean_dataset"), F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("datasets"))
    main = per_body.groupBy("line").agg((F.sum("s") / F.sum("n")).alias("mean_score"), F.max("best").alias("max_score"), F.count(F.lit(1)).alias("n_bodies"))
    cover = F.col("n_bodies") / F.lit(n_queries)
    return main.join(per_set, "line").select("line", F.round("mean_score", 9).alias("mean_score"), "max_score", "n_bodies", "datasets", "worst_dataset", F.round("mean_dataset", 9).alias("mean_dataset"), F.round(cover, 9).alias("coverage"), F.round(F.col("mean_score") * cover, 9).alias("weighted_score"))


def type_summary(matches: DataFrame, population: DataFrame) -> DataFrame:
    """Per type: bodies, scores and exact quartiles, and the share of the type's ``population`` (``type, size``)."""
    best = matches.groupBy("type", "body").agg(F.max("score").alias("score"))
    q = F.percentile("score", [0.25, 0.5, 0.75])
    out = best.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), F.avg("score").alias("mean"), q.alias("q"))
    return out.join(population, "type", "left").select("type", "n", "max_score", F.round("mean", 9).alias("mean_score"), *[F.round(F.col("q")[i], 9).alias(f"q{25 * (i + 1)}") for i in range(3)], F.round(F.col("n") / F.nullif("size", F.lit(0)), 9).alias("share"))


def entropy(counts: DataFrame) -> DataFrame:
    """``line, entropy`` in bits of the distribution of ``n`` over types."""
    p = counts.where("n > 0").withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("line")))
    return p.groupBy("line").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 9).alias("entropy"))


def specificity(matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, specificity``: the share of a line's score that falls on the ``wanted`` types."""
    flagged = matches.join(wanted.select("type", F.lit(1).alias("hit")).distinct(), "type", "left")
    return flagged.groupBy("line").agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("score")).otherwise(0.0)) / F.nullif(F.sum("score"), F.lit(0.0)), 9).alias("specificity"))


def mutual_information(matches: DataFrame) -> DataFrame:
    """``information`` in bits between line and type, over the counts of matches."""
    cells = matches.groupBy("line", "type").agg(F.count(F.lit(1)).alias("n"))
    by_line, by_type = cells.groupBy("line").agg(F.sum("n").alias("a")), cells.groupBy("type").agg(F.sum("n").alias("b"))
    total = cells.agg(F.sum("n").alias("t"))
    j = cells.join(by_line, "line").join(by_type, "type").withColumn("t", total.scalar())
    return j.agg(F.round(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))), F.lit(0.0)), 9).alias("information"))


def _packed_lines(matches: DataFrame) -> DataFrame:
    best = matches.where("line is not null").groupBy(F.col("line").alias("entity"), "type").agg(F.max("score").cast("double").alias("s"))
    return tiles.pack(best, "type", ["s"], {"n": F.count(F.lit(1)), "t": F.sum("s")})


def _weighted(t: tiles.Tiles, tile: tuple) -> tuple:
    """How many types the lines of a tile share, and their weighted Jaccard similarity (NaN if undefined)."""
    import numpy as np

    size = (tile[1] - tile[0], tile[3] - tile[2])
    shared, low, unknown = np.zeros(size), np.zeros(size), np.zeros(size)
    least = min([0.0, *(np.nanmin(f[0]) for f in t.flat if np.isfinite(f[0]).any())])
    for (xa, sa), (xb, sb) in t.parts(tile):
        shared += xa.T @ xb
        if np.isnan(sa).any() or np.isnan(sb).any():  # the smaller of a score and none is the score
            unknown += np.isnan(sa).astype(float).T @ np.isnan(sb)
            for k in range(len(sa)):
                low += np.nan_to_num(np.where(xa[k][:, None] * xb[k] > 0, np.fmin(sa[k][:, None], sb[k]), 0.0))
        elif least < 0:  # so that a type that a line lacks does not count as the smaller score
            tiles.least_sums(sa - least * xa, sb - least * xb, low)
            low += least * (xa.T @ xb)
        else:
            tiles.least_sums(sa, sb, low)
    low[(unknown > 0) & (unknown == shared)] = np.nan
    high = t.a.fact("t")[tile[0] : tile[1], None] + t.b.fact("t")[None, tile[2] : tile[3]] - low
    high[high == 0] = np.nan
    return shared, np.divide(low, high, out=high)


def _later(t: tiles.Tiles, tile: tuple, shared) -> None:
    """Leaves each pair of a block with itself out of ``shared`` but for once."""
    import numpy as np

    if t.a.size and t.b.size and t.a.names[0] == t.b.names[0]:
        shared[np.arange(tile[0], tile[1])[:, None] >= np.arange(tile[2], tile[3])] = 0


def colabelling(matches: DataFrame) -> DataFrame:
    """``l1, l2, shared, jaccard, weighted_jaccard`` of the lines that share a type, by best score per type."""

    def work(a: tiles.Side, b: tiles.Side):
        import numpy as np
        import pyarrow as pa

        t = tiles.Tiles(a, b, "type", ["s"])
        names, before = pa.array([*a.names, *b.names], pa.string()), np.searchsorted(b.names, a.names)
        for tile in t.bounds():
            shared, weighted = _weighted(t, tile)
            _later(t, tile, shared)
            i, j = np.nonzero(shared)
            if not len(i):
                continue
            n, w = shared[i, j], weighted[i, j]
            i, j = i + tile[0], j + tile[2]
            turned, other = j < before[i], j + a.size
            jaccard = n / (a.fact("n")[i] + b.fact("n")[j] - n)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.where(turned, other, i))), names.take(pa.array(np.where(turned, i, other))), pa.array(n.astype(np.int64)), pa.array(tiles.nine(jaccard) / 1e9), pa.array(tiles.nine(w) / 1e9, from_pandas=True)], ["l1", "l2", "shared", "jaccard", "weighted_jaccard"])

    return tiles.run(tiles.triangle(_packed_lines(matches)), lambda a, b: tiles.ahead(work(a, b)), "l1 string, l2 string, shared bigint, jaccard double, weighted_jaccard double")


def sparsity(matches: DataFrame, threshold: float, n_lines: int) -> DataFrame:
    """``sparsity``: the share of all pairs of ``n_lines`` lines whose weighted Jaccard similarity exceeds the threshold."""

    def work(a: tiles.Side, b: tiles.Side):
        import numpy as np
        import pyarrow as pa

        t, n = tiles.Tiles(a, b, "type", ["s"]), 0
        for tile in t.bounds():
            shared, weighted = _weighted(t, tile)
            _later(t, tile, shared)
            n += int(np.count_nonzero((shared > 0) & (weighted > threshold)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    pairs = max(n_lines * (n_lines - 1) // 2, 1)
    alike = tiles.run(tiles.triangle(_packed_lines(matches)), work, "n bigint")
    return alike.agg(F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.lit(pairs), 9).alias("sparsity"))


def combined_rank(one: DataFrame, two: DataFrame) -> DataFrame:
    """``line, rank_1, rank_2, combined``: the ranks of two rankings (``line, score``) added; absent counts as last + 1.

    Ranks are counted from the number of better scores, found on distinct scores.
    """
    from weft.operators.skew import running_sums

    def ranks(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
        run = running_sums(n, "score", ["c"], descending=True).select("score", (F.col("upto_c") - F.col("c") + 1).alias("base"))
        own = F.row_number().over(Window.partitionBy("score").orderBy("line")) - 1
        return df.withColumn("__o", own).join(run, "score").select("line", (F.col("base") + F.col("__o")).cast("bigint").alias(name))

    last1, last2 = one.agg(F.count(F.lit(1)) + 1).scalar(), two.agg(F.count(F.lit(1)) + 1).scalar()
    j = ranks(one, "rank_1").join(ranks(two, "rank_2"), "line", "full").withColumns({"rank_1": F.coalesce("rank_1", last1), "rank_2": F.coalesce("rank_2", last2)})
    return j.withColumn("combined", F.col("rank_1") + F.col("rank_2"))


def line_class(line: Column) -> Column:
    """``split_gal4`` or ``gal4_lexa`` by the line's prefix; a null or other name is of the latter."""
    name = F.upper(line)
    return F.when(reduce(lambda a, b: a | b, [name.startswith(p) for p in SPLIT_PREFIXES]), "split_gal4").otherwise("gal4_lexa")
