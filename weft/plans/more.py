"""Further operators of the inventory: path lanes, two-hop profiles, pools, text forms and route scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import edges as E
from weft.operators import filters, lines
from weft.operators import graph as G
from weft.operators import profiles as P
from weft.plans import views as V
from weft.plans.compare import _ALL_SCORES
from weft.plans.core_problems import SQL_CURRENT
from weft.plans.graphs import _EDGES, _PATHS, _SRC, _TGT, SOURCES, TARGETS, _ends, _network
from weft.plans.registry import Registry
from weft.session import table
from weft.sources import formats
from weft.sources.tables import current_neurons

R = Registry()
QUERIES, SQL = R.queries, R.sql
_RATIO = f"with recursive {V.TYPE_EDGES}, net as (select pre, post, weight / t as weight from (select *, sum(weight) over (partition by post) as t from type_edges) where weight / t >= 0.01 and pre <> post)"


@R.add(f"{_RATIO}, {_PATHS}, k as (select path, w from p where path[-1] in (select node from {_TGT})) select array_to_string(path, '->') as path, round(w, 9) as bottleneck from k where w >= (select min(w) from (select w from k order by w desc limit 30))")
def g29_ratio_paths(spark: SparkSession, d: str) -> DataFrame:
    """G29, O1, SC3: the strongest paths by share of input, end to end."""
    paths, _ = G.ratio_paths(V.type_edges(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 0.01, 2, None, 30)
    return paths.select(F.array_join("path", "->").alias("path"), F.round("bottleneck", 9).alias("bottleneck"))


@R.add(f"with recursive {_EDGES}, {_PATHS}, k as (select path, w, len(path) as n, path[1] as s, path[-1] as t from p where path[-1] in (select node from {_TGT})), m as (select s, t, min(n) as n from k group by 1, 2) select array_to_string(path, '->') as path, w::double as bottleneck from k join m using (s, t, n)")
def g28_batched_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths to all targets in batches of six."""
    return G.batched_shortest(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3, 6).select(F.array_join("path", "->").alias("path"), "bottleneck")


_LETTER = "l as (select type as node, type[1] as label from canonical_types)"


@R.add(f"with {_EDGES}, {_LETTER} select a.pre || '->' || a.post || '->' || b.post as path, least(a.weight, b.weight)::double as bottleneck from net a join net b on a.post = b.pre join l x on x.node = a.pre and x.label = 'd' join l y on y.node = a.post and y.label = 'm' join l z on z.node = b.post and z.label = 'v' where a.pre <> b.post")
def g43_chain_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths behind a chain of labels."""
    lab = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))
    return G.chain_paths(_network(spark, d), ["d", "m", "v"], lab).select(F.array_join("path", "->").alias("path"), "bottleneck")


@R.add(f"with {V.TYPE_EDGES}, r as (select pre, post, weight / sum(weight) over (partition by post) as ratio from type_edges), {_LETTER}, j as (select a.ratio as r1, b.ratio as r2 from r a join r b on a.post = b.pre join l x on x.node = a.pre and x.label = 'd' join l y on y.node = a.post and y.label = 'm' join l z on z.node = b.post and z.label = 'v') select 1 as hop, round(min(r1), 9) as least from j union all select 2, round(min(r2), 9) from j")
def g39_layered_least(spark: SparkSession, d: str) -> DataFrame:
    """The weakest hop among realisations of a chain."""
    lab = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))
    return G.layered_least(E.with_ratio(V.type_edges(spark, d)), ["d", "m", "v"], lab).select("hop", F.round("least", 9).alias("least"))


@R.add(f"""with {V.PAIRS}, {V.TYPES}, f as (select post as entity, pre as mid, weight as w1 from pairs where pre not in (select bodyId from types)), b as (select * from (select *, row_number() over (partition by post order by weight desc, length(pre), pre) as r from pairs) where r <= 5)
select entity, type as partner, sum(w1 * b.weight)::bigint as weight from f join b on b.post = mid join types on types.bodyId = b.pre group by 1, 2""")
def a24_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """The inputs of untyped inputs."""
    return P.two_hop_profile(V.pairs(spark, d), V.types(spark, d), 5)


@R.add(f"with {_ALL_SCORES}, s as (select * from scores where source <> target) select target, count(distinct source) as n_sources, (select source from s t where t.target = s.target order by jaccard desc, coalesce(rank_union, -2) desc, source desc limit 1) as best_source, max(jaccard) as jaccard from s group by target")
def e16_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all sources pooled by target."""
    return P.pooled(V.profiles(spark, d))


@R.add(f"with {V.PROFILES}, v as (select distinct p_brand as b from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#13')) select entity, round(coalesce(sum(weight) filter (partner = 'Brand#11'), 0), 6) as v1, round(coalesce(sum(weight) filter (partner = 'Brand#12'), 0), 6) as v2, round(coalesce(sum(weight) filter (partner = 'Brand#13'), 0), 6) as v3 from profiles group by 1")
def o05_vectors(spark: SparkSession, d: str) -> DataFrame:
    """O5, SC31, W16: profiles as vectors."""
    v = P.as_vectors(V.profiles(spark, d), ["Brand#11", "Brand#12", "Brand#13"])
    return v.select("entity", *[F.round(F.col("v")[i], 6).alias(f"v{i + 1}") for i in range(3)])


@R.add("with c as (select n_regionkey as k, count(*) as n from nation group by 1), r as (select r_name, r_regionkey from region), s as (select r_name, (hash_key) as s from (select r_name, r_regionkey * 7 % 5 as hash_key from region)), o as (select r_name, s, row_number() over (order by s desc, r_name) - 1 as r, count(*) over () as n from s) select r_name, s::int as s, ((n - 1) // 2 + case when r % 2 = 1 then (r + 1) // 2 else -(r // 2) end)::int as place from o")
def w17_mountain(spark: SparkSession, d: str) -> DataFrame:
    """The largest in the middle."""
    s = table(spark, d, "region").select("r_name", (F.col("r_regionkey") * 7 % 5).cast("int").alias("s"))
    return P.mountain(s, "s", "r_name")


_LINE_NAMES = ["ss", "LH", "mb", "IS", "OL", "LC", "LLPC", "LPC_", "JRC_SS", "bjd_ss", "VT", "R", "GMR", "L", "xSS"]


@R.add(f"with s as (select distinct l_suppkey, ({_LINE_NAMES})[(l_suppkey % {len(_LINE_NAMES)} + 1)::int] || l_suppkey as line from lineitem) select l_suppkey, case when " + " or ".join(f"starts_with(upper(line), '{p}')" for p in lines.SPLIT_PREFIXES) + " then 'split_gal4' else 'gal4_lexa' end as class from s")
def x24_line_class(spark: SparkSession, d: str) -> DataFrame:
    """The class of a line by its name."""
    s = table(spark, d, "lineitem").select("l_suppkey").distinct()
    name = F.element_at(F.array(*[F.lit(x) for x in _LINE_NAMES]), (F.col("l_suppkey") % len(_LINE_NAMES) + 1).cast("int"))
    return s.select("l_suppkey", lines.line_class(F.concat(name, F.col("l_suppkey"))).alias("class"))


@R.add("""with s as (select o_orderkey, strftime(o_orderdate, 'run_%Y%m%d_%H%M%S') as name from orders) select o_orderkey, strptime(regexp_extract(name, '([0-9]{8}_[0-9]{6})', 1), '%Y%m%d_%H%M%S') as at_time from s""")
def x23_run_time(spark: SparkSession, d: str) -> DataFrame:
    """The time in a folder's name."""
    name = F.date_format("o_orderdate", "'run_'yyyyMMdd_HHmmss")
    return table(spark, d, "orders").select("o_orderkey", F.to_timestamp(F.regexp_extract(name, "([0-9]{8}_[0-9]{6})", 1), "yyyyMMdd_HHmmss").alias("at_time"))


@R.add("select row_id, case when length(v) = 9 then '720575940' || v else v end as id from (select row_id, cast(try_cast(trim(bodyId_pre) as decimal(20, 0)) as varchar) as v from example_bodyid_network)")
def x20_exact_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are written as numbers."""
    return table(spark, d, "example_bodyid_network").select("row_id", formats.exact_id(F.trim("bodyId_pre")).alias("id"))


@R.add(f"with recursive {_EDGES}, {_PATHS} select array_to_string(path, '->') as path, contains(array_to_string(path, '->'), 'Nok') as excluded from p where path[-1] in (select node from {_TGT})")
def f19_path_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Paths by a literal keyword."""
    paths = G.simple_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3).select(F.array_join("path", "->").alias("path"))
    return paths.select("path", F.col("path").contains("Nok").alias("excluded"))


@R.add(f"select distinct flywire_type as name, n.type from flywire_types f join {SQL_CURRENT} n on n.flywireType = f.flywire_type where f.super_class = 'motor' and n.type is not null")
def f26_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """the types under a value of the taxonomy."""
    f = table(spark, d, "flywire_types").where("super_class = 'motor'").select(F.col("flywire_type").alias("name"))
    n = current_neurons(spark, d, "type", "flywireType").where("type is not null").select(F.col("flywireType").alias("name"), "type")
    return f.join(n, "name").select("name", "type").distinct()


@R.add("select a.row_id as a, count(b.row_id) as n from (select * from example_label_mapping where role = 'source') a left join (select * from example_label_mapping where role = 'target') b on a.custom_label is not distinct from b.custom_label and a.dataset = b.dataset group by 1")
def j15_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """A join in which missing labels are equal."""
    m = table(spark, d, "example_label_mapping")
    b = m.where("role = 'target'").groupBy(F.col("custom_label").alias("l2"), F.col("dataset").alias("d2")).agg(F.count(F.lit(1)).alias("k"))
    a = m.where("role = 'source'").groupBy("row_id", "custom_label", "dataset").agg(F.count(F.lit(1)).alias("c"))
    j = a.join(b, F.col("custom_label").eqNullSafe(F.col("l2")) & (F.col("dataset") == F.col("d2")), "left")
    return j.groupBy(F.col("row_id").alias("a")).agg(F.sum(F.coalesce("k", F.lit(0)) * F.col("c")).alias("n"))


@R.add(f"with {_EDGES}, scope as (select pre, post from net) select a.type as pre, b.type as post, count(*) as n, sum(weight) filter (weight >= 5)::bigint as strong from pairs join types a on pairs.pre = a.bodyId join types b on pairs.post = b.bodyId where (a.type, b.type) in (select pre, post from scope) group by 1, 2")
def j13_route_scope(spark: SparkSession, d: str) -> DataFrame:
    """Body-level edges within the routes of the type network, in tiers."""
    t = V.types(spark, d)
    e = V.pairs(spark, d).join(t.select(F.col("bodyId").alias("pre"), F.col("type").alias("a")), "pre").join(t.select(F.col("bodyId").alias("post"), F.col("type").alias("b")), "post")
    scope = _network(spark, d).select(F.col("pre").alias("a"), F.col("post").alias("b"))
    return e.join(scope, ["a", "b"], "left_semi").groupBy(F.col("a").alias("pre"), F.col("b").alias("post")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("weight") >= 5, F.col("weight"))).alias("strong"))


@R.add(f"select bodyId from {SQL_CURRENT} where (ends_with(type, '19') or ends_with(instance, '19')) and not contains(type, 'Nok') and not contains(instance, 'Nok')")
def f02_negative_filter(spark: SparkSession, d: str) -> DataFrame:
    """negative operators never match null."""
    n = current_neurons(spark, d, "type", "instance")
    return n.where(filters.structured(n, {"endswith": ["19"], "not_contains": ["Nok"]}, ["type", "instance"])).select("bodyId")
