"""Joins whose keys may be hot: a few keys are found with a bounded sketch and their rows are salted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut

#: Keys that the sketch may report, and counters that it keeps; both bound its size, not the result.
HOT_KEYS, TRACKED = 64, 4096
#: Over how many tasks the rows of a hot key are spread.
SALTS = 32
#: A key is hot if it holds more than this share of all rows.
HOT_SHARE = 0.002


def hot_keys(df: DataFrame, key: Column) -> Column:
    """The keys of ``df`` that hold many rows, as a scalar array of at most ``HOT_KEYS`` strings.

    A mergeable frequent-items sketch finds them in one pass with map-side combining. It only decides how rows
    are spread; results never depend on it.
    """
    seen = df.select(key.cast("string").alias("k")).where(F.col("k").isNotNull())
    top = seen.agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    return top.select(F.transform(F.filter("top", lambda x: x["count"] > F.col("n") * HOT_SHARE), lambda x: x["item"]).alias("hot")).scalar()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: Column, hot_key: str, spread: Column, extra: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys`` (and ``extra``), rows of hot keys spread over ``SALTS`` tasks.

    Rows of ``left`` with a hot ``hot_key`` get a salt from ``spread``; the rows of ``right`` with such a key are
    repeated for each salt. For left, left semi, left anti and inner joins, in which each row of ``left`` meets
    the rows of ``right`` exactly once. ``left`` and ``right`` are aliased ``l`` and ``r`` for ``extra``.
    """
    a = left.withColumn("__salt", F.when(F.array_contains(hot, F.col(hot_key).cast("string")), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).alias("l")
    b = right.withColumn("__salt", F.explode(F.when(F.array_contains(hot, F.col(hot_key).cast("string")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "__salt"]])
    return a.join(b, on if extra is None else on & extra, how)


def running_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``df`` with ``upto_<c>`` for each of ``sums``: the sum of ``c`` over all rows up to and with this one.

    ``order`` is unique. Rows are cut into ranges of it; sums per range come first, so no window holds all rows.
    """
    key = F.desc(order) if descending else F.asc(order)
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = cut(df.repartitionByRange(n, key).withColumn("__part", F.spark_partition_id()))
    per = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    own = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # as many rows as partitions
    joined = parts.join(F.broadcast(offsets), "__part")
    return joined.withColumns({f"upto_{c}": F.col(f"__{c}") + F.sum(c).over(own) for c in sums}).drop("__part", *[f"__{c}" for c in sums])
