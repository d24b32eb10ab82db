"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    It is the one that the session names in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder is made, but only under a local master: on a cluster a machine-local folder would lose data
    with its executor, so there the setting is required.
    """
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weft-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all cores, for stages whose work is large for the bytes they read.

    Adaptive execution sizes partitions by bytes and would run such a stage in few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
