"""Edge slices that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, late: str = "7 days") -> DataFrame:
    """A stream of the Parquet files that appear under ``path``, late rows admitted for ``late`` after the newest."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("ingested_at", late)


def arrivals_per_window(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """``window_start, roi, n, weight``: rows and weight that arrived per window and region."""
    g = stream.groupBy(F.window("ingested_at", width).alias("w"), "roi").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return g.select(F.col("w.start").alias("window_start"), "roi", "n", "weight")


def maintain_pairs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the summed pairs of each batch under ``path/batch=N``; reading sums over batches gives the pair mass.

    A batch that is repeated after a failure replaces its own folder, so nothing counts twice. The caller keeps an
    edge delivered twice within the watermark out with ``dropDuplicatesWithinWatermark`` on its row id.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("bodyId_pre", "bodyId_post").agg(F.sum("weight").alias("weight")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.dropDuplicatesWithinWatermark(["row_id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
