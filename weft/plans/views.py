"""Views of the test tables that the queries share, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import canonical_id, is_untyped
from weft.plans.core_problems import SQL_CURRENT, sql_bare, sql_canonical, sql_untyped
from weft.session import table
from weft.sources.tables import current_neurons, network


def slices(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """``pre, post, roi, weight``: the deduplicated slices of the network with canonical ids, dealt once, by ``by``, if given."""
    net = network(spark, d).select(canonical_id(F.col("bodyId_pre")).alias("pre"), canonical_id(F.col("bodyId_post")).alias("post"), "roi", "weight", "cached_date")
    net = net.where("pre is not null and post is not null and weight is not null")
    return (net.repartition(*by) if by else net).distinct().select("pre", "post", "roi", "weight")


def pairs(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """``pre, post, weight``: the summed mass of each pair; ``by`` as for ``slices``."""
    return slices(spark, d, *by).groupBy("pre", "post").agg(F.sum("weight").alias("weight")).where("weight > 0")


def types(spark: SparkSession, d: str) -> DataFrame:
    """``bodyId, type`` of the typed current neurons."""
    return current_neurons(spark, d, "type").where(~is_untyped(F.col("type"))).select("bodyId", "type")


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """``dataset, pre, post, roi, weight``: lineitems from customer nation to supplier nation per order status."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("o_orderstatus").alias("dataset"), F.col("c_nationkey").cast("string").alias("pre"), F.col("s_nationkey").cast("string").alias("post"), F.col("l_returnflag").alias("roi")).agg(F.count(F.lit(1)).alias("weight"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """``bodyId, type, instance``: nations as nodes, their region as type."""
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("bodyId"), F.col("r_name").alias("type"), F.col("n_name").alias("instance"))


def type_edges(spark: SparkSession, d: str) -> DataFrame:
    """``pre, post, weight``: the network between types."""
    t = types(spark, d)
    e = pairs(spark, d).join(t.select(F.col("bodyId").alias("pre"), F.col("type").alias("tp")), "pre").join(t.select(F.col("bodyId").alias("post"), F.col("type").alias("tq")), "post")
    return e.groupBy(F.col("tp").alias("pre"), F.col("tq").alias("post")).agg(F.sum("weight").alias("weight"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """``entity, partner, weight``: quantity of each brand that a supplier delivers."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.col("p_brand").alias("partner")).agg(F.sum("l_quantity").alias("weight"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    """``line, body, dataset, type, score``: suppliers as lines that match parts."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_suppkey").cast("string").alias("line"), F.col("l_partkey").cast("string").alias("body"), F.col("l_returnflag").alias("dataset"), F.col("p_brand").alias("type"), (F.col("l_extendedprice") / 131072).alias("score"))


SLICES = f"""slices as (select pre, post, roi, weight from (select distinct {sql_canonical('bodyId_pre')} as pre, {sql_canonical('bodyId_post')} as post, roi, weight, cached_date from example_bodyid_network) where pre is not null and post is not null and weight is not null)"""
PAIRS = f"{SLICES}, pairs as (select pre, post, sum(weight)::bigint as weight from slices group by pre, post having sum(weight) > 0)"
TYPES = f"types as (select bodyId, type from {SQL_CURRENT} where not {sql_untyped(sql_bare('type'))})"
TYPE_EDGES = f"{PAIRS}, {TYPES}, type_edges as (select a.type as pre, b.type as post, sum(weight)::bigint as weight from pairs join types a on pre = a.bodyId join types b on post = b.bodyId group by 1, 2)"
NATION_EDGES = """nation_edges as (select o_orderstatus as dataset, c_nationkey::varchar as pre, s_nationkey::varchar as post, l_returnflag as roi, count(*)::bigint as weight
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"""
NATIONS = "nations as (select n_nationkey::varchar as bodyId, r_name as type, n_name as instance from nation join region on n_regionkey = r_regionkey)"
PROFILES = "profiles as (select l_suppkey::varchar as entity, p_brand as partner, sum(l_quantity) as weight from lineitem join part on l_partkey = p_partkey group by 1, 2)"
MATCHES = "matches as (select l_suppkey::varchar as line, l_partkey::varchar as body, l_returnflag as dataset, p_brand as type, l_extendedprice / 131072 as score from lineitem join part on l_partkey = p_partkey)"
