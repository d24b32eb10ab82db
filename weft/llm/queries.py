"""Queries of the problems of this subpackage over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import cell_names, is_untyped, strip
from weft.llm import canonical_match, components, mixing, packing, set_join, text_quality
from weft.plans.core_problems import SQL_CURRENT, sql_bare, sql_strip, sql_untyped
from weft.session import table
from weft.sources.tables import current_neurons


def _typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "example_label_mapping").select(F.lit("custom_label").alias("field"), "row_id", F.col("custom_label").alias("value"))
    posts = table(spark, sf_dir, "example_bodyid_network").select(F.lit("type_post").alias("field"), "row_id", F.col("type_post").alias("value"))
    return labels.unionByName(posts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical entry of each freely typed value, -1 if there is none."""
    return canonical_match.map_rows(_typed_values(spark, sf_dir), table(spark, sf_dir, "canonical_types")).select("field", "row_id", "type_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that denote no entry and how often they occur."""
    return canonical_match.unmatched_report(canonical_match.map_rows(_typed_values(spark, sf_dir), table(spark, sf_dir, "canonical_types")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each neuron that shares a name with another, directly or through others."""
    columns = ["flywireType", "hemibrainType", "mancType"]
    cells = current_neurons(spark, sf_dir, *columns).select("bodyId", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), cell_names(F.col(c)).alias("names")) for c in columns])))
    names = cells.select(F.col("bodyId").alias("id"), F.explode(F.transform("names", lambda x: F.concat_ws(":", "field", x))).alias("name"))
    return components.groups_by_shared_names(names).select(F.col("id").alias("bodyId"), "group_id")


#: Similarity of partner sets as a fraction.
ALIKE = (7, 10)


def _partner_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(d).alias("scope"), F.from_json(F.col(f"{d}_partners"), "map<string,double>").alias("w")) for d in ("upstream", "downstream")])
    rows = table(spark, sf_dir, "connectivity_profile").select(F.col("profile_id").alias("id"), F.inline(cells))
    keys = F.map_keys(F.map_filter("w", lambda k, v: v > 0))
    return rows.select("scope", "id", F.array_distinct(F.filter(F.transform(keys, strip), lambda k: ~is_untyped(k))).alias("tokens"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of profiles whose partner sets are alike, per direction."""
    member, links = set_join.similarity_links(_partner_sets(spark, sf_dir), *ALIKE)
    return set_join.all_pairs(member, links).select(F.col("scope").alias("direction"), F.col("a").alias("profile_id_a"), F.col("b").alias("profile_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile with its class of equal sets and the number of classes that are alike."""
    member, links = set_join.similarity_links(_partner_sets(spark, sf_dir), *ALIKE)
    return set_join.class_summary(member, links).select(F.col("scope").alias("direction"), F.col("id").alias("profile_id"), "class_id", "n_copies", "n_links")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of every piece of every text, for each pack size."""
    return packing.pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the packs of each size are."""
    return packing.fill_report(p7_packing(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often they are used."""
    return mixing.mix_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each mix reaches, by labels and by memberships, and the facts of the fit."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each text, the probability of each kind and the likeliest."""
    return text_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that are lists, tables or junk."""
    return text_quality.not_prose(p9_statistics(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p5_found, p5_classes, p7_packing, p7_fill, p8_choice, p8_shares, p9_statistics, p9_found)}
_SETS = f"""cells as (select profile_id, unnest(['upstream', 'downstream']) as direction, unnest([upstream_partners, downstream_partners]) as j from connectivity_profile),
kv as (select direction, profile_id, unnest(map_entries(cast(cast(j as json) as map(varchar, double)))) as e from cells where j is not null),
sets as (select distinct direction, profile_id, {sql_strip('e.key')} as t from kv where e.value > 0 and not {sql_untyped(sql_bare('e.key'))}),
sizes as (select direction, profile_id, count(*) as n from sets group by all),
pairs as (select a.direction, a.profile_id as profile_id_a, b.profile_id as profile_id_b, count(*) as c from sets a join sets b on a.direction = b.direction and a.t = b.t and a.profile_id < b.profile_id group by all),
alike as (select p.direction, profile_id_a, profile_id_b from pairs p join sizes x on x.direction = p.direction and x.profile_id = profile_id_a join sizes y on y.direction = p.direction and y.profile_id = profile_id_b where c * 10 >= (x.n + y.n - c) * 7)"""
_CELLS = " union ".join(f"select bodyId as id, '{c}:' || x as name from (select bodyId, {sql_bare('y')} as x from (select bodyId, unnest(string_split({c}, ',')) as y from {SQL_CURRENT})) where not {sql_untyped('x')}" for c in ("flywireType", "hemibrainType", "mancType"))

SQL: dict[str, str] = {
    "p3_found": f"""with recursive names as ({_CELLS}), links as (select distinct a.id as x, b.id as y from names a join names b on a.name = b.name), reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x)
select x as bodyId, min(y::decimal(38, 0))::varchar as group_id from reach group by x having count(*) >= 2""",
    "p5_found": f"with {_SETS} select * from alike",
    "p5_classes": f"""with {_SETS}, tok as (select direction, profile_id, list_sort(list(t)) as ts from sets group by all),
cls as (select direction, profile_id, min(profile_id) over (partition by direction, ts) as class_id, count(*) over (partition by direction, ts) as n_copies from tok),
reps as (select direction, profile_id from cls where profile_id = class_id), ends as (select direction, unnest([profile_id_a, profile_id_b]) as class_id from alike a where exists (select 1 from reps r where r.direction = a.direction and r.profile_id = profile_id_a) and exists (select 1 from reps r where r.direction = a.direction and r.profile_id = profile_id_b)),
n as (select direction, class_id, count(*) as n_links from ends group by all)
select c.direction, profile_id, c.class_id, n_copies, coalesce(n_links, 0)::bigint as n_links from cls c left join n on n.direction = c.direction and n.class_id = c.class_id""",
}
