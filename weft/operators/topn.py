"""The N strongest items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, which must end with a unique key, with their ``rank``.

    It is a ``row_number`` window under a rank filter, for which the optimiser plans a group limit on both sides
    of the shuffle: of a group with millions of rows each task passes on ``n`` rows at most. Groups with fewer
    rows keep them all; a null key is a group of its own; an empty table stays empty.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def strongest_partners(edges: DataFrame, n: int = 3) -> DataFrame:
    """``side, bodyId, partner, strength, rank``: the ``n`` strongest partners of each node, for either side.

    ``edges`` has ``pre, post, weight, roi, cached_date`` with canonical ids. Rows with a null id or weight are
    left out, rows equal in all five columns count once, strength is the summed weight per pair and must be
    positive. Of equal strength the numerically smaller partner comes first.
    """
    rows = edges.where(F.col("pre").isNotNull() & F.col("post").isNotNull() & F.col("weight").isNotNull())
    slices = rows.groupBy("pre", "post", "roi", "weight", "cached_date").agg(F.lit(1).alias("__one"))
    pairs = slices.groupBy("pre", "post").agg(F.sum("weight").alias("strength")).where("strength > 0")
    sides = F.array(F.struct(F.lit("post").alias("side"), F.col("post").alias("bodyId"), F.col("pre").alias("partner")), F.struct(F.lit("pre").alias("side"), F.col("pre").alias("bodyId"), F.col("post").alias("partner")))
    each = pairs.select("strength", F.inline(sides))
    return top_n(each, ["side", "bodyId"], [F.desc("strength"), F.length("partner").asc(), F.asc("partner")], n).select("side", "bodyId", "partner", "strength", "rank")
