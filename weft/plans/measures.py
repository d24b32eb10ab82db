"""Queries of the further measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import edges as E
from weft.operators import measures as M
from weft.operators import profiles as P
from weft.plans import views as V
from weft.plans.compare import _SCORES, _scores
from weft.plans.core_problems import SQL_CURRENT
from weft.plans.registry import Registry
from weft.plans.relational import LONG, _long
from weft.session import table
from weft.sources.tables import current_neurons

R = Registry()
QUERIES, SQL = R.queries, R.sql

_FORMS = ["_R", "-left", "_12", "-like", "", "_L", "7", "_LIKE"]
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(lower(case n when 'Brand#11_R' then 'Own' else n end), '[_-]?(?:[lr]|left|right)$', ''), '[_-]?[0-9]+$', ''), '[_-]?like$', '')"


@R.add(f"with s as (select p_partkey, p_brand || ({_FORMS})[(p_partkey % 8 + 1)::int] as n from part) select p_partkey, case {_NORMAL} when 'brand#' then 'brand' else {_NORMAL} end as name from s")
def x04_normalized_types(spark: SparkSession, d: str) -> DataFrame:
    """Partner types without case, side, number and likeness, with own names."""
    own = spark.createDataFrame([("Brand#11_R", "Own"), ("brand#", "brand")], "name string, target string")
    form = F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", M.normalized_type(F.concat("p_brand", form), own).alias("name"))


@R.add(f"with {LONG} select dataset, count(*) filter (value >= 5) as actual_edges, 625::bigint as possible_edges, count(*) filter (value >= 5) / 625 as edge_density from long group by 1")
def a30_edge_density(spark: SparkSession, d: str) -> DataFrame:
    """Edges by possible edges between 25 sources and 25 targets."""
    return M.edge_density(_long(spark, d), 25, 25, 5)


#: Walks of one and two hops between nations as paths of a dataset; the second is there if both hops are heavy enough.
_NATION_PATHS = f"{V.NATION_EDGES}, e as (select dataset, pre, post, sum(weight)::bigint as w from nation_edges group by 1, 2, 3 having sum(weight) >= 4), p as (select dataset, pre || ' -> ' || post as key, 1 as hops, w as value from e union all select a.dataset, a.pre || ' -> ' || a.post || ' -> ' || b.post, 2, least(a.w, b.w) from e a join e b on a.dataset = b.dataset and a.post = b.pre and a.pre <> b.post and a.pre <> a.post and b.pre <> b.post)"


def _nation_paths(spark: SparkSession, d: str) -> DataFrame:
    e = V.nation_edges(spark, d).groupBy("dataset", "pre", "post").agg(F.sum("weight").alias("w")).where("w >= 4")
    one = e.select("dataset", F.concat("pre", F.lit(" -> "), "post").alias("key"), F.lit(1).alias("hops"), F.col("w").alias("value"))
    loops = e.where("pre <> post")
    two = loops.alias("a").join(loops.alias("b"), (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.post") == F.col("b.pre")) & (F.col("a.pre") != F.col("b.post")))
    return one.unionByName(two.select("a.dataset", F.concat("a.pre", F.lit(" -> "), "a.post", F.lit(" -> "), "b.post").alias("key"), F.lit(2).alias("hops"), F.least("a.w", "b.w").alias("value")))


@R.add(f"with {_NATION_PATHS}, ds as (select dataset, count(distinct key) as n from p group by 1), f as (select a.dataset as d1, b.dataset as d2, a.n as n1, b.n as n2 from ds a join ds b on a.dataset < b.dataset) select d1, d2, n1, n2, round(case when n1 >= 5 and n2 >= 5 then c / (n1 + n2 - c) end, 9) as jaccard from f join lateral (select count(*) as c from (select distinct key from p where dataset = d1) x join (select distinct key from p where dataset = d2) y using (key)) z on true")
def u06_path_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Paths that two datasets share, with a least support of five."""
    return M.supported_jaccard(_nation_paths(spark, d), 5)


@R.add(f"with {_NATION_PATHS}, s as (select dataset, count(*) filter (hops = 1) / count(*) as one from p group by 1) select a.dataset as d1, b.dataset as d2, round(abs(a.one - b.one), 9) as w1 from s a join s b on a.dataset < b.dataset")
def m08_hop_profile(spark: SparkSession, d: str) -> DataFrame:
    """M8: the distance between distributions of hops (of one and two hops, so the difference of the first share)."""
    return M.hop_profile_distance(_nation_paths(spark, d))


_CURVE = f"{LONG}, g as (select unnest(range(1, 31)) as t), m as (select dataset, key, max(value) as v from long group by 1, 2), curve as (select d.dataset, t, count(v) as n from (select distinct dataset from long) d cross join g left join m on m.dataset = d.dataset and v >= t group by 1, 2)"


@R.add(f"""with {_CURVE}, k as (select *, max(n) over (partition by dataset) as most, row_number() over (partition by dataset order by abs(n - 300), t) as r from curve), b as (select * from k where r = 1), p as (select b.dataset, min(c.t) as t_from, max(c.t) as t_to from b join curve c on c.dataset = b.dataset and c.n = b.n group by 1)
select dataset, case when most >= 300 then t end::int as best_t, case when most >= 300 then t_from end::int as t_from, case when most >= 300 then t_to end::int as t_to, n, round(abs(300 - n) / greatest(300, n, 1), 9) as distance, case when most < 300 then 'target_density_below_range' when n = 300 then 'exact' when abs(300 - n) / greatest(300, n, 1) <= 0.1 then 'within_tolerance' else 'outside_tolerance' end as status from b join p using (dataset)""")
def m26_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each dataset that leaves nearest to three hundred edges."""
    return M.best_thresholds(M.threshold_curve(_long(spark, d), 30), 300, 0.1)


@R.add(f"with {_CURVE}, a as (select dataset as d1, t as t1, n as n1 from curve), b as (select dataset as d2, t as t2, n as n2 from curve) select d1, t1, d2, t2, round(abs(n1 - n2) / greatest(n1, n2, 1), 9) as distance from a join b on d1 < d2")
def m27_alignment_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The distance in number of edges of every pair of datasets at every pair of thresholds up to thirty."""
    c = M.threshold_curve(_long(spark, d), 30)
    a, b = c.select(F.col("dataset").alias("d1"), F.col("t").alias("t1"), F.col("n").alias("n1")), c.select(F.col("dataset").alias("d2"), F.col("t").alias("t2"), F.col("n").alias("n2"))
    return a.join(b, F.col("d1") < F.col("d2")).select("d1", "t1", "d2", "t2", F.round(M.edge_count_distance(F.col("n1"), F.col("n2")), 9).alias("distance"))


@R.add(f"with {_CURVE}, nodes as (select dataset, count(distinct x) as nodes from (select dataset, unnest([pre, post]) as x from nation_edges) group by 1), c as (select curve.dataset, t, n / nodes as density from curve join nodes using (dataset)), ends as (select dataset, arg_max(density, t) as low, arg_min(density, t) as high from c group by 1), band as (select max(low) as lo, min(high) as hi from ends), l as (select i as level, lo + i * (hi - lo) / 3 as wanted from band, unnest(range(4)) as u(i) where lo <= hi) select level::int as level, dataset, min(t)::int as t from l join c on round(density, 12) <= round(wanted, 12) group by 1, 2")
def m29_same_density(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds at which datasets are equally dense, at four levels."""
    e = V.nation_edges(spark, d)
    nodes = e.select("dataset", F.explode(F.array("pre", "post")).alias("x")).distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("nodes"))
    return M.same_density_rows(M.threshold_curve(_long(spark, d), 30), nodes, 4)


@R.add("with s as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) as w from lineitem group by 1) select l_orderkey, round(case when len(w) > 2 then list_min(w[2:-2]) else list_min(w) end, 6)::double as interior from s")
def x15_interior_strength(spark: SparkSession, d: str) -> DataFrame:
    """The weakest inner hop of lists that were written as text."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("h"))
    text = F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: x["l_quantity"].cast("string")), ", "), F.lit("]"))
    return s.select("l_orderkey", F.round(M.interior_strength(M.hop_list(text)), 6).alias("interior"))


@R.add(f"""with p as (select distinct bodyId || chr(31) || coalesce(type, '') as p from {SQL_CURRENT}), s as (select {", ".join(f"sum(('0x' || md5(p)[{a}:{a + 7}])::bigint)::hugeint::varchar as s{a}" for a in (1, 9, 17, 25))} from p) select md5(concat_ws('-', s1, s9, s17, s25))[1:12] as digest from s""")
def x19_mapping_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the mapping from bodies to types."""
    return M.mapping_digest(current_neurons(spark, d, "type"), "bodyId", "type")


@R.add(f"""with {V.TYPE_EDGES}, s as (select type as node from canonical_types where full_name like 'dorsal % descending neuron %'), t as (select type as node from canonical_types where full_name like 'ventral % projection neuron %'),
f as (select *, pre in (select node from s) or post in (select node from t) as own from type_edges), h as (select pre, post, weight from f where own order by weight desc, pre, post limit 50), k as (select pre, post, weight from f where (pre, post) not in (select (pre, post) from h) order by weight desc, pre, post limit 100) select *, true as reserved from h union all select *, false from k""")
def t07_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The hundred heaviest edges besides fifty of the sources and targets."""
    from weft.plans.graphs import SOURCES, TARGETS, _ends

    return M.trim_to_strongest(V.type_edges(spark, d), 100, _ends(spark, d, SOURCES), _ends(spark, d, TARGETS), 50)


_NATION_OF = "n as (select s_suppkey::varchar as entity, s_nationkey::varchar as type from supplier)"


def _nation_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_nationkey").cast("string").alias("type"))


@R.add(f"""with {_SCORES}, r as (select *, rank() over (partition by source order by jaccard desc nulls last) as rj, rank() over (partition by source order by rank_union desc nulls last) as rc from scores where source <> target), {_NATION_OF},
g as (select source, min(rj) filter (a.type = b.type and rj <= 3) as j, min(rc) filter (a.type = b.type and rc <= 3) as c from r join n a on a.entity = source left join n b on b.entity = target group by 1) select source, least(j, c)::int as rank, case when least(j, c) is null then null when j = least(j, c) then 'jaccard' else 'rank_union' end as via, case when least(j, c) = 1 then 'high' when least(j, c) is not null then 'medium' else 'low' end as grade from g""")
def w08_own_type_grade(spark: SparkSession, d: str) -> DataFrame:
    """The best rank of a candidate of the own type, and the grade that it gives."""
    return M.own_type_grade(P.rank_candidates(_scores(spark, d).where("source <> target")), _nation_of(spark, d), 3)


@R.add(f"""with {_SCORES}, r as (select source, target, row_number() over (partition by source order by jaccard desc nulls last, rank_union desc nulls last, target) as place from scores where source <> target), {_NATION_OF}, w as (select entity, 2 * count(*) over (partition by type) as w from n) select source, target, place::int as place from r join w on entity = source where place <= w""")
def w14_own_windows(spark: SparkSession, d: str) -> DataFrame:
    """As many candidates as twice the size of the own type."""
    return P.best_places(V.profiles(spark, d), F.col("entity").cast("bigint") % 20 == 0, M.own_windows(_nation_of(spark, d), 2))


def _aggregated(spark: SparkSession, d: str, method: str) -> DataFrame:
    e, lab = V.pairs(spark, d), V.types(spark, d).select("bodyId", F.col("type").alias("label"))
    g = E.aggregate_groups(e, lab, E.incoming_by_node(e), 0.0, method)
    return g.select("pre", "post", "weight", "n_pairs", F.round("probability", 7).alias("probability"))


_JOINED = f"""{V.PAIRS}, {V.TYPES}, tot as (select post, sum(weight) as t from pairs group by 1), r as (select p.*, tot.t, least(weight / tot.t / 0.3, 1) as p, coalesce(a.type, p.pre) as a, coalesce(b.type, p.post) as b from pairs p join tot using (post) left join types a on a.bodyId = p.pre left join types b on b.bodyId = p.post)"""


@R.add(f"with {_JOINED} select a as pre, b as post, sum(weight)::bigint as weight, count(*) as n_pairs, round(1 - product(1 - p), 7) as probability from r group by 1, 2")
def a05_product(spark: SparkSession, d: str) -> DataFrame:
    """A5: the probability that one of the pairs of two types is crossed."""
    return _aggregated(spark, d, "product")


@R.add(f"with {_JOINED}, l as (select b, sum(t) as t from (select distinct b, post, t from r) group by 1) select a as pre, r.b as post, sum(weight)::bigint as weight, count(*) as n_pairs, round(least(sum(weight) / any_value(l.t) / 0.3, 1), 7) as probability from r join l on l.b = r.b group by 1, 2")
def a05_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A5: the probability by the share of the input of a whole type."""
    return _aggregated(spark, d, "ratio")
