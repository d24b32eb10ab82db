"""Queries of the problems that the core solves (hot keys, orphan references, top N) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import BLANKS, canonical_id, cell_names, is_untyped, strip
from weft.operators.hot_keys import skewed_key_stats
from weft.operators.orphans import orphan_references, orphan_report
from weft.operators.topn import strongest_partners
from weft.session import table
from weft.sources.tables import current_neurons, network


def p2_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per side and type: rows, summed weight, distinct partner ids and the median weight.

    Untyped values of a side form one group whose type is null.
    """
    net = network(spark, sf_dir)
    kind = lambda c: F.when(~is_untyped(F.col(c)), strip(F.col(c)))
    sides = {"pre": (kind("type_pre"), canonical_id(F.col("bodyId_post"))), "post": (kind("type_post"), canonical_id(F.col("bodyId_pre")))}
    return skewed_key_stats(net, sides, F.col("weight")).select("side", F.col("key").alias("type"), "n_rows", F.col("total").alias("sum_weight"), "n_partners", F.col("median").alias("median_weight"))


def _network_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(c).alias("field"), canonical_id(F.col(c)).alias("ref")) for c in ("bodyId_pre", "bodyId_post")])
    rows = network(spark, sf_dir).select("row_id", F.col("cached_date").alias("at"), F.inline(fields))
    return rows.select(F.lit("example_bodyid_network").alias("table_name"), "field", "row_id", "ref", "at")


def _type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_neurons(spark, sf_dir, "flywireType").select("row_id", F.col("last_fetched").alias("at"), F.explode(cell_names(F.col("flywireType"))).alias("ref"))
    return rows.select(F.lit("male_cns_neuron_df").alias("table_name"), F.lit("flywireType").alias("field"), "row_id", "ref", "at")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    neurons = current_neurons(spark, sf_dir, "first_seen", "removed_at").withColumnRenamed("bodyId", "ref")
    catalogue = table(spark, sf_dir, "flywire_types").withColumnRenamed("flywire_type", "ref")
    return orphan_references(_network_refs(spark, sf_dir), neurons).unionByName(orphan_references(_type_refs(spark, sf_dir), catalogue))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reference without a record at its time."""
    return _orphans(spark, sf_dir).select("table_name", "field", "row_id", "ref")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month of the referring record."""
    refs = _network_refs(spark, sf_dir).unionByName(_type_refs(spark, sf_dir))
    return orphan_report(refs, _orphans(spark, sf_dir), ["table_name", "field"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest partners of every neuron on either side."""
    return _strongest(spark, sf_dir).select("side", "bodyId", "partner")


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with strength and rank."""
    return _strongest(spark, sf_dir)


def _strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir).select(canonical_id(F.col("bodyId_pre")).alias("pre"), canonical_id(F.col("bodyId_post")).alias("post"), "weight", "roi", "cached_date")
    return strongest_partners(net, 3)


QUERIES = {f.__name__: f for f in (p2_type_stats, p4_found, p4_report, p6_found, p6_ranked)}


def sql_strip(c: str) -> str:
    """DuckDB text of ``c`` without surrounding white space."""
    return f"trim({c}, '{BLANKS}')"


def sql_canonical(c: str) -> str:
    """DuckDB text of the canonical id of column ``c``."""
    t = sql_strip(c)
    d = rf"ltrim(regexp_replace({t}, '^([0-9]+)\.0+$', '\1'), '0')"
    return f"case when {t} = '' then null when {d} = '' then '0' when regexp_matches({d}, '^[0-9]{{9}}$') then '720575940' || {d} else {d} end"


def sql_bare(c: str) -> str:
    """DuckDB text of the bare label of column ``c``: one wrapper off a step, as many steps as it has characters."""
    t = sql_strip(c)
    step = sql_strip(r"regexp_replace(a, '^(?:(.*)_[LRU]|\((.*)\))$', '\1\2', 's')")
    return rf"case when regexp_matches({t}, '(?:_[LRU]|\))$') then list_reduce(list_prepend({t}, list_transform(range(length({t})), lambda i: '')), lambda a, b: {step}) else {t} end"


def sql_untyped(bare: str) -> str:
    """DuckDB text: whether the bare label ``bare`` is untyped."""
    return f"coalesce({bare} = '' or lower({bare}) in ('unknown','nan','none','null','<na>','<null>') or regexp_matches({bare}, '^(?:[hH][bB])?[0-9]+$'), true)"


SQL_CURRENT = "(select * from (select *, row_number() over (partition by bodyId order by last_fetched desc, row_id desc) as rn from male_cns_neuron_df) where rn = 1)"
_REFS = f"""
network_refs as (
  select 'example_bodyid_network' as table_name, 'bodyId_pre' as field, row_id, {sql_canonical('bodyId_pre')} as ref, cached_date as seen_at from example_bodyid_network
  union all
  select 'example_bodyid_network', 'bodyId_post', row_id, {sql_canonical('bodyId_post')}, cached_date from example_bodyid_network),
neurons as {SQL_CURRENT},
cells as (select distinct row_id, last_fetched as seen_at, {sql_bare('x')} as ref from (select row_id, last_fetched, unnest(string_split(flywireType, ',')) as x from neurons)),
type_refs as (select 'male_cns_neuron_df' as table_name, 'flywireType' as field, row_id, ref, seen_at from cells where not {sql_untyped('ref')}),
orphans as (
  select table_name, field, row_id, ref, seen_at from network_refs r where ref is not null and not exists
    (select 1 from neurons n where n.bodyId = r.ref and n.first_seen <= r.seen_at and (n.removed_at is null or n.removed_at > r.seen_at))
  union all
  select table_name, field, row_id, ref, seen_at from type_refs r where not exists
    (select 1 from flywire_types n where n.flywire_type = r.ref and n.first_seen <= r.seen_at and (n.removed_at is null or n.removed_at > r.seen_at)))"""
_TOP = f"""
with ids as (select {sql_canonical('bodyId_pre')} as pre, {sql_canonical('bodyId_post')} as post, weight, roi, cached_date from example_bodyid_network),
pairs as (select pre, post, sum(weight)::bigint as strength from (select distinct * from ids where pre is not null and post is not null and weight is not null) group by pre, post having sum(weight) > 0),
sides as (select 'post' as side, post as bodyId, pre as partner, strength from pairs union all select 'pre', pre, post, strength from pairs),
ranked as (select *, row_number() over (partition by side, bodyId order by strength desc, length(partner), partner) as rank from sides)"""

SQL = {
    "p2_type_stats": f"""
with bare as (select *, {sql_bare('type_pre')} as b_pre, {sql_bare('type_post')} as b_post from example_bodyid_network),
sides as (
  select 'pre' as side, case when not {sql_untyped('b_pre')} then {sql_strip('type_pre')} end as type, {sql_canonical('bodyId_post')} as partner, weight from bare
  union all
  select 'post', case when not {sql_untyped('b_post')} then {sql_strip('type_post')} end, {sql_canonical('bodyId_pre')}, weight from bare)
select side, type, count(*) as n_rows, sum(weight)::bigint as sum_weight, count(distinct partner) as n_partners, median(weight)::double as median_weight from sides group by side, type""",
    "p4_found": f"with {_REFS} select table_name, field, row_id, ref from orphans",
    "p4_report": f"""with {_REFS}, refs as (select * from network_refs where ref is not null union all select * from type_refs),
months as (select table_name, field, date_trunc('month', seen_at)::timestamp as month, count(*) as n_refs, 0 as n_orphans from refs group by all union all
  select table_name, field, date_trunc('month', seen_at)::timestamp, 0, count(*) from orphans group by all)
select table_name, field, month, sum(n_refs)::bigint as n_refs, sum(n_orphans)::bigint as n_orphans from months group by all""",
    "p6_found": f"{_TOP} select side, bodyId, partner from ranked where rank <= 3",
    "p6_ranked": f"{_TOP} select side, bodyId, partner, strength, rank::int as rank from ranked where rank <= 3",
}
