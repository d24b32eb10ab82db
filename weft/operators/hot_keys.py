"""Per-key statistics where a few keys hold most rows.

Nothing per key is ever gathered in one task. Every statistic is an algebraic aggregate over a key that is
finer than the hot one, so the map side combines it in its bounded hash table (which spills mergeable states)
and only partial aggregates are shuffled:

* counts, sums and the median come from the histogram ``(side, key, value) -> rows``,
* the number of distinct partners from the deduplicated ``(side, key, partner)``.

The median is found in two levels (blocks of ``MEDIAN_BLOCK`` adjacent values, then the values of a block), so
that no window holds more than the values of one block or the blocks of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut

#: Adjacent integer values that form one block of the two-level median.
MEDIAN_BLOCK = 1024


def exact_median(hist: DataFrame, keys: list[str], value: str, rows: str, out: str) -> DataFrame:
    """``keys, out``: the exact median of an integer ``value`` given with its frequency in ``rows``.

    Null values do not count; a key with nothing else has no row. With an even number of rows the median is the
    mean of the two middle values.
    """
    h = hist.where(F.col(value).isNotNull() & (F.col(rows) > 0)).groupBy(*keys, value).agg(F.sum(rows).alias("__n"))
    h = h.withColumn("__block", F.floor(F.col(value) / MEDIAN_BLOCK))
    blocks = h.groupBy(*keys, "__block").agg(F.sum("__n").alias("__in_block"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"__before": F.coalesce(F.sum("__in_block").over(before), F.lit(0)), "__total": F.sum("__in_block").over(Window.partitionBy(*keys))})
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    wanted = blocks.where((low < F.col("__before") + F.col("__in_block")) & (high >= F.col("__before")))
    inside = Window.partitionBy(*keys, "__block").orderBy(value)
    chosen = wanted.select(*[F.col(k).alias(f"__w_{k}") for k in keys], F.col("__block").alias("__w_block"), "__before", "__total")
    on = F.col("__block") == F.col("__w_block")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__w_{k}"))
    fine = h.join(chosen, on, "inner")
    upto = F.col("__before") + F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fine = fine.withColumn("__upto", upto)
    hit_low = (low < F.col("__upto")) & (low >= F.col("__upto") - F.col("__n"))
    hit_high = (high < F.col("__upto")) & (high >= F.col("__upto") - F.col("__n"))
    return fine.groupBy(*keys).agg(((F.max(F.when(hit_low, F.col(value))) + F.max(F.when(hit_high, F.col(value)))) / 2).cast("double").alias(out))


def skewed_key_stats(df: DataFrame, sides: dict[str, tuple[Column, Column]], value: Column) -> DataFrame:
    """``side, key, n_rows, total, n_partners, median`` for each key of each side.

    ``sides`` maps the name of a side to its key and its partner column. All sides share one pass over the
    input. A null key is a key of its own; null partners are not counted as partners; null values count as
    rows but not in ``total`` (null if a key has nothing else) or ``median``. An empty table gives no rows.
    Columns of ``df`` that are not named here are never read.
    """
    each = F.array(*[F.struct(F.lit(s).alias("side"), k.alias("key"), p.alias("partner")) for s, (k, p) in sides.items()])
    # the value first: it may be the table's own column of the same name as one made here
    rows = df.select(value.cast("bigint").alias("__value"), each.alias("__each")).select("__value", F.inline("__each"))
    # read three times below; far smaller than the input, as equal values of a key are one row
    hist = cut(rows.groupBy("side", "key", "__value").agg(F.count(F.lit(1)).alias("__rows")))
    totals = hist.groupBy("side", "key").agg(F.sum("__rows").alias("n_rows"), F.sum(F.col("__value") * F.col("__rows")).alias("total"))
    partners = rows.where(F.col("partner").isNotNull()).groupBy("side", "key", "partner").agg(F.lit(1).alias("__one")).groupBy("side", "key").agg(F.count(F.lit(1)).alias("n_partners"))
    median = exact_median(hist, ["side", "key"], "__value", "__rows", "median")
    # one row per key and part, put together by a last aggregate rather than by joins
    parts = [
        totals.select("side", "key", "n_rows", "total", F.lit(None).cast("bigint").alias("n_partners"), F.lit(None).cast("double").alias("median")),
        partners.select("side", "key", F.lit(None).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("total"), "n_partners", F.lit(None).cast("double").alias("median")),
        median.select("side", "key", F.lit(None).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("n_partners"), "median"),
    ]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.groupBy("side", "key").agg(F.max("n_rows").alias("n_rows"), F.max("total").alias("total"), F.coalesce(F.max("n_partners"), F.lit(0)).alias("n_partners"), F.max("median").alias("median"))
