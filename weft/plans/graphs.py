"""Graph queries over the whole network between types, from the dorsal descending to the ventral projection neurons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import edges as E
from weft.operators import graph as G
from weft.plans import views as V
from weft.plans.registry import Registry
from weft.session import cut, table
from weft.sources.tables import current_neurons

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: The ends of the path queries, by the direction and the kind that a type's full name states.
SOURCES, TARGETS = ("dorsal", "descending neuron"), ("ventral", "projection neuron")


def _network(spark: SparkSession, d: str) -> DataFrame:
    return cut(V.type_edges(spark, d).where(F.col("pre") != F.col("post")))


def _ends(spark: SparkSession, d: str, which: tuple[str, str]) -> DataFrame:
    direction, kind = which
    return table(spark, d, "canonical_types").where(F.col("full_name").like(f"{direction} % {kind} %")).select(F.col("type").alias("node"))


_EDGES = f"{V.TYPE_EDGES}, net as (select * from type_edges where pre <> post)"
_SRC, _TGT = (f"(select type as node from canonical_types where full_name like '{direction} % {kind} %')" for direction, kind in (SOURCES, TARGETS))
_STEP = f"with recursive {_EDGES}"


@R.add(f"{_STEP}, walk as (select node, 0 as dist from {_SRC} union select h.post, w.dist + 1 from walk w join net h on h.pre = w.node where w.dist < 3) select node, min(dist)::int as dist from walk group by 1")
def g07_hops(spark: SparkSession, d: str) -> DataFrame:
    """Fewest hops from a set."""
    return G.hops(_network(spark, d), _ends(spark, d, SOURCES), 3)


@R.add(f"""{_STEP}, f as (select node, 0 as dist from {_SRC} union select h.post, f.dist + 1 from f join net h on h.pre = f.node where f.dist < 3), b as (select node, 0 as dist from {_TGT} union select h.pre, b.dist + 1 from b join net h on h.post = b.node where b.dist < 3),
fs as (select node, min(dist) as ds from f group by 1), bs as (select node, min(dist) as dt from b group by 1) select pre, post, weight from net join fs on pre = fs.node join bs on post = bs.node where ds + 1 + dt <= 3""")
def g08_cone(spark: SparkSession, d: str) -> DataFrame:
    """Edges that fit a bound of hops."""
    return G.cone(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3).select("pre", "post", "weight")


_PATHS = f"""p as (select [h.pre, h.post] as path, weight as w from net h where h.pre in (select node from {_SRC}) union all select list_append(p.path, h.post), least(p.w, h.weight) from p join net h on h.pre = p.path[-1] where len(p.path) < 4 and not list_contains(p.path, h.post))"""


@R.add(f"{_STEP}, {_PATHS} select array_to_string(path, '->') as path, w::double as bottleneck from p where path[-1] in (select node from {_TGT})")
def g14_simple_paths(spark: SparkSession, d: str) -> DataFrame:
    """All simple paths of up to three hops."""
    return G.simple_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3).select(F.array_join("path", "->").alias("path"), "bottleneck")


@R.add(f"{_STEP}, {_PATHS} select array_to_string(path, '->') as path from p where path[-1] in (select node from {_TGT})")
def g16_meet_in_the_middle(spark: SparkSession, d: str) -> DataFrame:
    """The same paths from halves."""
    return G.half_way_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3).select(F.array_join("path", "->").alias("path"))


@R.add(f"{_STEP}, {_PATHS}, k as (select path, w from p where path[-1] in (select node from {_TGT})) select array_to_string(path, '->') as path, w::double as bottleneck from k where w >= (select min(w) from (select w from k order by w desc limit 40))")
def g13_strongest_first(spark: SparkSession, d: str) -> DataFrame:
    """The forty strongest paths with all ties of the last."""
    paths, _ = G.strongest_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3, 40)
    return paths.select(F.array_join("path", "->").alias("path"), "bottleneck")


@R.add(f"{_STEP}, {_PATHS}, k as (select path, w, len(path) as n, path[1] as s, path[-1] as t from p where path[-1] in (select node from {_TGT})), m as (select s, t, min(n) as n from k group by 1, 2) select array_to_string(path, '->') as path, w::double as bottleneck from k join m using (s, t, n)")
def g20_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """All shortest paths of each pair."""
    return G.shortest_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3).select(F.array_join("path", "->").alias("path"), "bottleneck")


@R.add(f"{_STEP}, w as (select pre as node, max(weight)::double as width, 1 as h from net where post in (select node from {_TGT}) group by 1 union select x.node, x.width, x.h from (select e.pre as node, max(least(e.weight::double, w.width)) as width, max(w.h) + 1 as h from w join net e on e.post = w.node where w.h < 3 group by 1) x) select node, max(width) as width from w group by 1")
def g11_widest(spark: SparkSession, d: str) -> DataFrame:
    """The widest way to a target."""
    return G.widest(_network(spark, d), _ends(spark, d, TARGETS), 3)


@R.add(f"{_STEP}, c as (select node, 0 as hops, 1::hugeint as n from {_SRC} union all select x.node, x.hops, x.n from (select h.post as node, c.hops + 1 as hops, sum(c.n)::hugeint as n from c join net h on h.pre = c.node where c.hops < 4 group by 1, 2) x) select node, hops::int as hops, n::bigint as n from c where hops > 0")
def g38_walk_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many walks of each length arrive."""
    return G.walk_counts(_network(spark, d), _ends(spark, d, SOURCES), 4)


@R.add(f"{_STEP}, {_PATHS}, k as (select path from p where path[-1] in (select node from {_TGT})), l as (select list_transform(path, lambda x: x[1]) as labels from k) select array_to_string(labels, '->') as labels, count(*) as n_paths from l group by 1")
def g31_label_paths(spark: SparkSession, d: str) -> DataFrame:
    """The sequences of labels behind paths."""
    e = _network(spark, d)
    paths = G.simple_paths(e, _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3)
    lab = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))
    return G.label_paths(paths, lab)


@R.add(f"""{_STEP}, tot as (select post, sum(weight) as t from type_edges group by 1), {_PATHS}, k as (select row_number() over () as id, path from p where path[-1] in (select node from {_TGT})),
h as (select id, path, path[i] as a, path[i + 1] as b from k, unnest(range(1, len(path))) as u(i)), j as (select id, path, weight, weight / t as r from h join net on pre = a and post = b join tot on tot.post = b)
select path[1] as source, path[-1] as target, array_to_string(path, '->') as path, count(*)::int as hops, min(weight)::bigint as min_weight, round(min(r), 9) as min_ratio from j group by id, j.path""")
def g32_path_table(spark: SparkSession, d: str) -> DataFrame:
    """Paths with what their hops carry."""
    ratio = cut(E.with_ratio(V.type_edges(spark, d)).where(F.col("pre") != F.col("post")))
    return G.path_table(ratio, _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3).select("source", "target", "path", "hops", "min_weight", F.round("min_ratio", 9).alias("min_ratio"))


@R.add(f"""{_STEP}, {_PATHS}, k as (select path, w from p where path[-1] in (select node from {_TGT})) select path[1] as source, path[-1] as target, count(*) as n_paths, min(len(path) - 1)::int as least_hops, max(w)::double as best from k group by 1, 2""")
def a39_pair_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Paths summed up per source and target."""
    paths = G.simple_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3)
    return paths.groupBy(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("target")).agg(F.count(F.lit(1)).alias("n_paths"), F.min(F.size("path") - 1).alias("least_hops"), F.max("bottleneck").alias("best"))


@R.add(f"""{_STEP}, {_PATHS}, k as (select path from p where path[-1] in (select node from {_TGT})) select x as node, count(*) as n_paths from (select unnest(path[2:-2]) as x from k) group by 1""")
def a40_intermediates(spark: SparkSession, d: str) -> DataFrame:
    """How many paths pass through a node."""
    paths = G.simple_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3)
    inner = paths.where(F.size("path") > 2).select(F.explode(F.slice(F.col("path"), F.lit(2), F.size("path") - 2)).alias("node"))
    return inner.groupBy("node").agg(F.count(F.lit(1)).alias("n_paths"))


@R.add()
def g10_edge_budget(spark: SparkSession, d: str) -> DataFrame:
    """The weakest tier whose cone fits a budget of edges."""
    return G.edge_budget(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3, 40)[0].select("pre", "post", "weight")


@R.add(f"""with {V.TYPE_EDGES}, t as (select post, sum(weight) as t from type_edges group by 1), r as (select pre, post, weight, weight / t as ratio from type_edges join t using (post)) select pre, post, weight, round(ratio, 9) as ratio, greatest(1.0, round(0.3 * t, 6))::double as cutoff from r join t using (post) where ratio >= 0.3""")
def g40_pruned_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Type pairs by their share of input, and the weight that stands for."""
    r = E.with_ratio(V.type_edges(spark, d))
    t = E.incoming_by_node(V.type_edges(spark, d))
    return r.where("ratio >= 0.3").join(t, "post").select("pre", "post", "weight", F.round("ratio", 9).alias("ratio"), F.greatest(F.lit(1.0), F.round(F.col("total") * 0.3, 6)).alias("cutoff"))


@R.add(f"with {V.TYPE_EDGES}, n as (select type as node, type[1] as label from canonical_types) select coalesce(a.label, pre) as pre, coalesce(b.label, post) as post, sum(weight)::bigint as weight from type_edges left join n a on pre = a.node left join n b on post = b.node group by 1, 2")
def g05_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one label merged."""
    lab = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))
    return G.collapse(V.type_edges(spark, d), lab)


@R.add("""with recursive e as (select distinct flywire_type as x, super_class as y from flywire_types where super_class is not null), c as (select distinct y as a, y as b from e union select c.a, w.y from c join e v on v.y = c.b join e w on w.x = v.x),
m as (select c.a as y, least(min('n:' || e.x), min('s:' || c.b)) as component from c join e on e.y = c.b group by 1)
select 'n:' || x as node, min(component) as component from e join m using (y) group by 1 union all select 's:' || y, component from m""")
def u08_name_components(spark: SparkSession, d: str) -> DataFrame:
    """Names that share a member, directly or through others."""
    e = table(spark, d, "flywire_types").where("super_class is not null").select(F.concat(F.lit("n:"), "flywire_type").alias("a"), F.concat(F.lit("s:"), "super_class").alias("b")).distinct()
    return G.name_components(e)


@R.add()
def g46_wl_features(spark: SparkSession, d: str) -> DataFrame:
    """Weisfeiler-Lehman labels of the network of types."""
    lab = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))
    return G.wl_features(V.type_edges(spark, d), lab, 2)


@R.add()
def g47_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Kernel similarity of the left and the right network."""
    n = current_neurons(spark, d, "type", "somaSide")
    lab = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))

    def side(s: str) -> DataFrame:
        own = n.where(F.col("somaSide") == s).select("bodyId", "type").where("type is not null")
        e = V.pairs(spark, d).join(own.select(F.col("bodyId").alias("pre"), F.col("type").alias("a")), "pre").join(own.select(F.col("bodyId").alias("post"), F.col("type").alias("b")), "post")
        return e.select(F.col("a").alias("pre"), F.col("b").alias("post"), "weight")

    return G.kernel_similarity(G.wl_features(side("L"), lab, 1), G.wl_features(side("R"), lab, 1))


@R.add()
def w15_diverse_top(spark: SparkSession, d: str) -> DataFrame:
    """Strong paths that do not all use the same edges."""
    return G.diverse_top(G.simple_paths(_network(spark, d), _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 3), 5, 2)


@R.add(f"{_STEP}, walk as (select node, 0 as dist from {_SRC} union select h.post, w.dist + 1 from walk w join net h on h.pre = w.node where w.dist < 3), r as (select distinct node from walk), p as (select type as node, type[1] as label from canonical_types) select label, count(*) as n, count(r.node) as reached, count(r.node) >= greatest(1, ceil(count(*) * 0.1)) as met from p left join r using (node) group by 1")
def g25_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each population is reached."""
    r = G.hops(_network(spark, d), _ends(spark, d, SOURCES), 3).select("node", F.lit(1).alias("hit"))
    p = table(spark, d, "canonical_types").select(F.col("type").alias("node"), F.substring("type", 1, 1).alias("label"))
    g = p.join(r, "node", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("reached"))
    return g.withColumn("met", F.col("reached") >= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1)))
