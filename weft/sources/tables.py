"""The tables of the network, cleaned as their descriptions state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import canonical_id
from weft.session import table


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_bodyid_network`` as delivered."""
    return table(spark, sf_dir, "example_bodyid_network")


def current_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of one ``key`` the one with the largest ``order``, nulls counting as smallest.

    A mergeable ``max_by`` keeps one row per key and task before the shuffle. Rows with a null key are left out.
    """
    rest = [c for c in df.columns if c != key]
    keyed = df.where(F.col(key).isNotNull())
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return keyed.groupBy(key).agg(newest).select(key, "__row.*")


def current_neurons(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The current row of each canonical ``bodyId`` of ``male_cns_neuron_df`` with ``columns``."""
    df = table(spark, sf_dir, "male_cns_neuron_df").withColumn("bodyId", canonical_id(F.col("bodyId")))
    keep = list(dict.fromkeys(["bodyId", *columns, "last_fetched", "row_id"]))
    return current_rows(df.select(*keep), "bodyId", "last_fetched", "row_id")
