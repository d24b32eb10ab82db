"""Readers that tolerate what real deliveries differ in, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import SHORT_ID_PREFIX, canonical_id, strip

#: Other names under which the columns of deliveries come.
ALIASES = {"root_id": "bodyId", "pt_root_id": "bodyId", "side": "hemisphere", "pre_root_id": "bodyId_pre", "post_root_id": "bodyId_post", "syn_count": "weight", "neuropil": "roi", "cell_type": "type"}
#: Columns of an edge table and their types.
EDGE_COLUMNS = {"bodyId_pre": "string", "bodyId_post": "string", "weight": "bigint", "roi": "string"}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, CSV (with header) or JSON table by its suffix; index columns that writers left behind are dropped."""
    low = path.lower()
    if low.endswith((".csv", ".csv.gz", ".tsv")):
        df = spark.read.option("header", True).option("sep", "\t" if low.endswith(".tsv") else ",").option("quote", '"').option("escape", '"').csv(path)
    elif low.endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed:") or c in ("__index_level_0__", "")])


def renamed(df: DataFrame) -> DataFrame:
    """``df`` under the standard column names, where these are not taken."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def read_edges(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The edge tables of all ``paths`` together, each cast to the standard columns first.

    Files without the three required columns are refused; a missing ``roi`` is null.
    """
    out = None
    for path in paths:
        df = renamed(read_any(spark, path))
        missing = {"bodyId_pre", "bodyId_post", "weight"} - set(df.columns)
        if missing:
            raise ValueError(f"{path} lacks {sorted(missing)}")
        one = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EDGE_COLUMNS.items()])
        out = one if out is None else out.unionByName(one)
    return out


def type_chain(df: DataFrame, columns: list[str]) -> Column:
    """The first of ``columns`` that is neither null nor blank, else ``Unknown``."""
    return F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in columns if c in df.columns], F.lit("Unknown"))


def enriched_nodes(base: DataFrame, enrichments: list[DataFrame], chain: list[str]) -> DataFrame:
    """``base`` left joined with further tables on ``bodyId`` (their first row per node) and a ``type`` by ``chain``."""
    out = base
    for e in enrichments:
        new = [c for c in e.columns if c not in out.columns]
        one = e.groupBy("bodyId").agg(*[F.min(c).alias(c) for c in new])
        out = out.join(one, "bodyId", "left")
    return out.withColumn("type", type_chain(out, chain))


def converted_edges(raw: DataFrame) -> DataFrame:
    """``bodyId_pre, bodyId_post, weight, rois``: one row per pair, its regions sorted and joined with ``|``."""
    ids = raw.select(canonical_id(F.col("bodyId_pre")).alias("bodyId_pre"), canonical_id(F.col("bodyId_post")).alias("bodyId_post"), "weight", "roi").where("bodyId_pre is not null and bodyId_post is not null")
    return ids.groupBy("bodyId_pre", "bodyId_post").agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("roi")), "|").alias("rois"))


def exact_id(c: Column) -> Column:
    """An id written as a number, also with an exponent, as its digits; null if it is none."""
    number = c.try_cast("decimal(20,0)")
    text = number.cast("string")
    return F.when(F.length(text) == 9, F.concat(F.lit(SHORT_ID_PREFIX), text)).otherwise(text)


def backfilled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``post`` as the weight that arrives in ``edges``, 0 if none."""
    total = edges.groupBy(F.col("post").alias("bodyId")).agg(F.sum("weight").alias("post"))
    return nodes.drop("post").join(total, "bodyId", "left").na.fill(0, ["post"])


def cache_hits(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``cached`` that were wanted, and the wanted keys that it lacks."""
    return cached.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.select(*keys).distinct().join(cached, keys, "left_anti")


def label_members(rows: DataFrame) -> DataFrame:
    """``label, dataset, role, member_kind, member``: rows with ``;``-joined ``members`` exploded, blanks left out."""
    return rows.select("label", "dataset", "role", "member_kind", F.explode(F.split("members", ";")).alias("m")).select("label", "dataset", "role", "member_kind", strip(F.col("m")).alias("member")).where("member <> ''").distinct()


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, sort: list[str] | None = None) -> None:
    """Parquet with zstd; ``sort`` orders rows within tasks, so equal values lie together. Replaces ``path`` when done."""
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_layer(df: DataFrame, path: str, layer: int) -> None:
    """Adds one layer of labels to a store that is partitioned by layer."""
    df.withColumn("layer", F.lit(layer)).write.mode("append").partitionBy("layer").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays are written as ``[a, b]``."""
    flat = df.select(*[F.concat(F.lit("["), F.array_join(F.transform(F.col(c), lambda x: F.coalesce(x.cast("string"), F.lit(""))), ", "), F.lit("]")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def read_skeletons(spark: SparkSession, path: str) -> DataFrame:
    """``body, node_id, parent_id, x, y, z, radius`` of all SWC files under ``path``; the body is the file's name."""
    lines = spark.read.text(path, wholetext=False).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.swc$", 1).alias("body"), strip(F.col("value")).alias("v"))
    f = F.split("v", r"\s+")
    rows = lines.where("v <> '' and not startswith(v, '#')").select("body", f.alias("f")).where(F.size("f") >= 7)
    num = lambda i, t: F.col("f")[i].try_cast(t)
    return rows.select("body", num(0, "int").alias("node_id"), num(6, "int").alias("parent_id"), num(2, "double").alias("x"), num(3, "double").alias("y"), num(4, "double").alias("z"), num(5, "double").alias("radius"))
