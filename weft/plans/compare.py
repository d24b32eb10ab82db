"""Comparisons of datasets, profiles and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import canonical_id
from weft.operators import profiles as P
from weft.operators import similarity as S
from weft.operators import skeleton, vectors
from weft.plans import views as V
from weft.plans.registry import Registry
from weft.plans.relational import LONG, _long
from weft.session import table
from weft.sources.tables import network

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add(f"with {LONG} select key, max(value) filter (dataset = 'F') as \"F\", max(value) filter (dataset = 'O') as \"O\", max(value) filter (dataset = 'P') as \"P\" from long group by 1")
def u05_aligned(spark: SparkSession, d: str) -> DataFrame:
    """U5, U7, D11, SC25: one column per dataset."""
    return S.aligned(_long(spark, d), ["F", "O", "P"])


@R.add(f"""with {LONG}, sh as (select *, value / sum(value) over (partition by dataset) as p from long), ds as (select distinct dataset from long), fr as (select a.dataset as d1, b.dataset as d2 from ds a join ds b on a.dataset < b.dataset),
j as (select fr.d1, fr.d2, k.key, a.value as x, b.value as y, a.p as px, b.p as py from fr join (select distinct key from long) k on true left join sh a on a.dataset = d1 and a.key = k.key left join sh b on b.dataset = d2 and b.key = k.key where a.key is not null or b.key is not null),
rk as (select *, case when x is not null and y is not null then rank() over (partition by d1, d2, x is null or y is null order by x) + (count(*) over (partition by d1, d2, x is null or y is null, x) - 1) / 2 end as rx, case when x is not null and y is not null then rank() over (partition by d1, d2, x is null or y is null order by y) + (count(*) over (partition by d1, d2, x is null or y is null, y) - 1) / 2 end as ry from j)
select d1, d2, count(x) as n1, count(y) as n2, count(*) filter (x is not null and y is not null) as shared, round(case when count(*) = 0 then 1.0 else count(*) filter (x is not null and y is not null) / count(*) end, 9) as jaccard, round(case when count(x) > 0 then count(*) filter (x is not null and y is not null) / count(x) else 0.0 end, 9) as overlap_1, round(case when count(y) > 0 then count(*) filter (x is not null and y is not null) / count(y) else 0.0 end, 9) as overlap_2,
round(coalesce(sum(least(coalesce(px, 0), coalesce(py, 0))) / nullif(sum(greatest(coalesce(px, 0), coalesce(py, 0))), 0), 0), 9) as ruzicka, round(case when count(*) filter (x is not null and y is not null) >= 2 then corr(x, y) end, 9) as pearson, round(case when count(*) filter (x is not null and y is not null) >= 3 then corr(rx, ry) end, 9) as spearman,
round(coalesce(sum(coalesce(x, 0) * coalesce(y, 0)) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 0), 9) as cosine, round(greatest(1 - sqrt(sum(pow(coalesce(x, 0) - coalesce(y, 0), 2))) / (sqrt(coalesce(sum(x * x), 0)) + sqrt(coalesce(sum(y * y), 0))), 0), 9) as frobenius from rk group by 1, 2""")
def u01_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All measures of all pairs of datasets, of all edges."""
    long = _long(spark, d)
    return S.pair_metrics(long, long.select("dataset").distinct())


@R.add(f"""with {LONG}, t as (select unnest([1, 5, 20]) as threshold), l as (select threshold::bigint as threshold, long.* from t join long on value >= threshold), ds as (select a.dataset as d1, b.dataset as d2 from (select distinct dataset from long) a join (select distinct dataset from long) b on a.dataset < b.dataset)
select t.threshold::bigint as threshold, d1, d2, round(case when u = 0 then 1.0 else s / u end, 9) as jaccard from t join ds on true join lateral (select count(*) filter (x and y) as s, count(*) as u from (select bool_or(dataset = d1) as x, bool_or(dataset = d2) as y from l where l.threshold = t.threshold and dataset in (d1, d2) group by key)) z on true""")
def m13_across_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Similarity at each threshold."""
    grid = spark.createDataFrame([(1,), (5,), (20,)], "threshold bigint")
    long = _long(spark, d)
    at = F.broadcast(grid).join(long, F.col("value") >= F.col("threshold")).select("threshold", "dataset", "key", "value")
    ds = long.select("dataset").distinct().join(grid, F.lit(True))
    return S.pair_metrics(at, ds, ["threshold"]).select("threshold", "d1", "d2", "jaccard")


@R.add(f"with {LONG}, p as (select key, count(*) filter (value >= 3) as n from long group by 1) select key, n, case when n = 3 then 'common' when n = 1 then 'unique' else 'shared' end as kind from p where n > 0")
def u03_presence(spark: SparkSession, d: str) -> DataFrame:
    """Keys common to all datasets or unique to one."""
    return S.presence(_long(spark, d), 3, 3)


@R.add(f"with {LONG}, r as (select *, row_number() over (partition by dataset order by value desc, key) as r from long), s as (select dataset, least(count(*), 50) as n from long group by 1), f as (select a.dataset as d1, b.dataset as d2, least(a.n, b.n) as k from s a join s b on a.dataset < b.dataset) select d1, d2, k, count(x.key) as common, round(count(x.key) / k, 9) as share from f left join (select a.dataset as p, b.dataset as q, a.key, a.r as r1, b.r as r2 from r a join r b on a.key = b.key) x on p = d1 and q = d2 and r1 <= k and r2 <= k group by 1, 2, 3")
def t02_top_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What the heaviest fifty have in common."""
    return S.top_overlap(_long(spark, d), 50)


@R.add(f"with {LONG}, ds as (select distinct dataset from long), f as (select k.key, a.dataset as d1, b.dataset as d2 from (select distinct key from long) k cross join ds a join ds b on a.dataset < b.dataset), j as (select f.*, coalesce(a.value, 0) as x, coalesce(b.value, 0) as y from f left join long a on a.key = f.key and a.dataset = d1 left join long b on b.key = f.key and b.dataset = d2) select *, round(greatest((x + 1) / (y + 1), (y + 1) / (x + 1)), 9) as fold from j where round(greatest((x + 1) / (y + 1), (y + 1) / (x + 1)), 9) >= 2")
def m12_differential(spark: SparkSession, d: str) -> DataFrame:
    """Edges that differ twofold."""
    return S.differential(_long(spark, d), 2.0)


@R.add(f"""with {LONG}, v as (select dataset, round(ln(1 + value), 6) as value, count(*) as n from long group by 1, 2), s as (select *, n / sum(n) over (partition by dataset) as sh from v), ds as (select distinct dataset from v), f as (select a.dataset as d1, b.dataset as d2 from ds a join ds b on a.dataset < b.dataset),
st as (select d1, d2, value, sum(case when dataset = d1 then sh else -sh end) as g from f join s on dataset in (d1, d2) group by 1, 2, 3), r as (select *, sum(g) over (partition by d1, d2 order by value) as gap, lead(value) over (partition by d1, d2 order by value) - value as width from st) select d1, d2, round(coalesce(sum(abs(gap) * width), 0), 6) as w1 from r group by 1, 2""")
def m09_strength_distance(spark: SparkSession, d: str) -> DataFrame:
    """M8, M9: the distance between distributions of strength."""
    v = _long(spark, d).select("dataset", F.round(F.log1p("value"), 6).alias("value"), F.lit(1).alias("n"))
    return S.wasserstein(v).withColumn("w1", F.round("w1", 6))


_SIG = f"{V.NATION_EDGES}, e as (select dataset, pre, post, sum(weight)::double as weight from nation_edges group by 1, 2, 3), n as (select distinct dataset, pre as node from e union select distinct dataset, post from e), f as (select n.dataset, n.node, (select coalesce(sum(weight), 0) from e where e.dataset = n.dataset and pre = node) as out_strength, (select coalesce(sum(weight), 0) from e where e.dataset = n.dataset and post = node) as in_strength, (select count(*) from e where e.dataset = n.dataset and pre = node)::double as out_degree, (select count(*) from e where e.dataset = n.dataset and post = node)::double as in_degree from n), l as (select dataset, unnest(['out_strength', 'in_strength', 'out_degree', 'in_degree']) as feature, unnest([out_strength, in_strength, out_degree, in_degree]) as v from f), m as (select dataset, feature, median(v) as median from l group by 1, 2), s as (select l.dataset, l.feature, m.median, median(abs(v - m.median)) as mad from l join m on l.dataset = m.dataset and l.feature = m.feature group by 1, 2, 3)"


@R.add(f"with {_SIG} select * from s")
def m10_netsimile(spark: SparkSession, d: str) -> DataFrame:
    """Medians and deviations of node features."""
    return S.netsimile(V.nation_edges(spark, d).groupBy("dataset", "pre", "post").agg(F.sum("weight").alias("weight")))


@R.add(f"with {_SIG}, v as (select dataset, feature || 'm' as k, median as v from s union all select dataset, feature || 'd', mad from s) select a.dataset as d1, b.dataset as d2, round(1 / (1 + avg(case when abs(a.v) + abs(b.v) > 0 then abs(a.v - b.v) / (abs(a.v) + abs(b.v)) else 0 end)), 9) as similarity from v a join v b on a.k = b.k and a.dataset < b.dataset group by 1, 2")
def m11_netsimile_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Canberra similarity of the signatures."""
    return S.netsimile_similarity(m10_netsimile(spark, d))


@R.add(f"""with {V.NATION_EDGES}, a as (select pre, post, sum(weight)::double as x from nation_edges where dataset = 'F' group by 1, 2), b as (select pre, post, sum(weight)::double as y from nation_edges where dataset = 'O' group by 1, 2), j as (select coalesce(a.pre, b.pre) as pre, coalesce(a.post, b.post) as post, coalesce(x, 0) as x, coalesce(y, 0) as y from a full join b on a.pre = b.pre and a.post = b.post), n as (select count(*) * count(*)::double as n from (select pre from j union select post from j)), s as (select sum(x) as sx, sum(y) as sy, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy from j)
select round(pow(xy - sx * sy / n, 2) / ((xx - sx * sx / n) * (yy - sy * sy / n)), 9) as rv from s, n""")
def m06_rv(spark: SparkSession, d: str) -> DataFrame:
    """M6: the RV coefficient of two matrices."""
    e = V.nation_edges(spark, d).groupBy("dataset", "pre", "post").agg(F.sum("weight").alias("weight"))
    return S.rv_coefficient(e.where("dataset = 'F'"), e.where("dataset = 'O'"))


@R.add()
def m07_mantel(spark: SparkSession, d: str) -> DataFrame:
    """M7: the permutation test of two matrices."""
    e = V.nation_edges(spark, d).groupBy("dataset", "pre", "post").agg(F.sum("weight").alias("weight"))
    return S.mantel(e.where("dataset = 'F'"), e.where("dataset = 'O'"))


_SCORES = f"""{V.PROFILES}, sf as (select *, rank() over (partition by entity order by weight) + (count(*) over (partition by entity, weight) - 1) / 2 as rk from profiles where weight > 0), sq as (select * from sf where entity::bigint % 20 = 0), se as (select q.entity as source, t.entity as target from (select distinct entity from sq) q, (select distinct entity from sf) t),
sk as (select source, target, x.partner, a.weight as wa, b.weight as wb from se e join (select distinct partner from sf) x on true left join sf a on a.entity = source and a.partner = x.partner left join sf b on b.entity = target and b.partner = x.partner where a.partner is not null or b.partner is not null),
sz as (select *, rank() over (partition by source, target order by coalesce(wa, 0)) + (count(*) over (partition by source, target, coalesce(wa, 0)) - 1) / 2 as ra, rank() over (partition by source, target order by coalesce(wb, 0)) + (count(*) over (partition by source, target, coalesce(wb, 0)) - 1) / 2 as rb from sk),
scores as (select source, target, count(*) filter (wa is not null and wb is not null) as shared, count(*) as total, round(count(*) filter (wa is not null and wb is not null) / count(*), 9) as jaccard, round(sum(least(coalesce(wa, 0), coalesce(wb, 0))) / sum(greatest(coalesce(wa, 0), coalesce(wb, 0))), 9) as weighted_jaccard, round(sum(coalesce(wa, 0) * coalesce(wb, 0)) / sqrt(sum(wa * wa) * sum(wb * wb)), 9) as cosine, round(case when count(*) >= 3 and stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end, 9) as rank_union from sz group by 1, 2 having count(*) filter (wa is not null and wb is not null) > 0)"""


_ALL_SCORES = _SCORES.replace(" where entity::bigint % 20 = 0", "")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    p = V.profiles(spark, d)
    return P.score_pairs(p.where(F.col("entity").cast("bigint") % 20 == 0), p)


@R.add(f"with {_SCORES} select * from scores")
def m16_profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth entity against all."""
    return _scores(spark, d)


@R.add(f"with {_SCORES}, h as (select source, target, round(0.5 * greatest(coalesce(rank_union, 0), 0) + 0.3 * jaccard, 9) as score from scores where shared >= 3 and source <> target) select source, target, score, rank::int as rank from (select *, row_number() over (partition by source order by score desc, target) as rank from h) where rank <= 5")
def m19_homologs(spark: SparkSession, d: str) -> DataFrame:
    """Counterparts by the strict score."""
    return P.homologs_strict(_scores(spark, d).where("source <> target"), 3, 5)


@R.add(f"""with {_SCORES}, r as (select *, rank() over (partition by source order by jaccard desc nulls last) as rank_jaccard, rank() over (partition by source order by rank_union desc nulls last) as rank_corr from scores where source <> target),
k as (select *, row_number() over (partition by source order by rank_jaccard, jaccard desc nulls last, rank_union desc nulls last, target) as k1, row_number() over (partition by source order by rank_corr, jaccard desc nulls last, rank_union desc nulls last, target) as k2 from r)
select source, target, rank_jaccard::int as rank_jaccard, rank_corr::int as rank_corr, least(rank_jaccard, rank_corr)::int as bar_rank, case when least(rank_jaccard, rank_corr) <= 2 and rank_union >= 0.2 then 'matched' when least(rank_jaccard, rank_corr) <= 2 then 'near' else 'far' end as tier from k where k1 <= 5 or k2 <= 5""")
def w07_top_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by two rankings, and their tier."""
    top = P.top_union(P.rank_candidates(_scores(spark, d).where("source <> target")), 5)
    return P.admit(top, 2, 0.2).select("source", "target", "rank_jaccard", "rank_corr", "bar_rank", "tier")


@R.add(f"""with {_ALL_SCORES}, s as (select * from scores where source <> target), f as (select *, row_number() over (partition by source order by jaccard desc nulls last, rank_union desc nulls last, target) as f from s), b as (select *, row_number() over (partition by target order by jaccard desc nulls last, rank_union desc nulls last, source) as b from s) select f.source, f.target, f.jaccard, f.rank_union from f join b on f.source = b.source and f.target = b.target where f = 1 and b = 1""")
def j19_mutual_best(spark: SparkSession, d: str) -> DataFrame:
    """Each other's first candidate, of all entities."""
    return P.mutual_best(V.profiles(spark, d))


@R.add(f"with {V.PROFILES} select entity, sum(weight) as total, count(*) as n from profiles where weight > 0 group by 1 having sum(weight) >= 100 and count(*) >= 20")
def m20_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Entities with enough of a profile."""
    return P.quality_gate(V.profiles(spark, d), 100, 20)


@R.add(f"with {V.PROFILES}, g as (select (entity::bigint % 7)::varchar as grp, partner, sum(weight) as weight, var_pop(weight) as variance from profiles group by 1, 2) select grp, partner, weight, round(variance, 6) as variance, rank() over (partition by grp order by weight desc) as rank from g")
def a22_merged_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of groups."""
    p = V.profiles(spark, d)
    g = p.select("entity", (F.col("entity").cast("bigint") % 7).cast("string").alias("grp")).distinct()
    return P.merge_profiles(p, g).select("grp", "partner", "weight", F.round("variance", 6).alias("variance"), F.col("rank").cast("bigint").alias("rank"))


@R.add(f"with {V.PAIRS}, q as (select distinct post from pairs where post[-1] = '7'), p as (select distinct pre from pairs where post in (select post from q)) select post, count(distinct pre) as shared, sum(weight)::bigint as weight from pairs where pre in (select pre from p) and post not in (select post from q) group by 1 having count(distinct pre) >= 5 order by 2 desc, 3 desc, 1 limit 100")
def j09_shared_partners(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the same inputs as a set."""
    e = V.pairs(spark, d)
    return P.shared_partner_candidates(e, e.where(F.col("post").endswith("7")).select("post").distinct(), 5, 100)


_SCORED = "scored as (select round(l_extendedprice, 0) as score, l_quantity > 25 as good from lineitem)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.round("l_extendedprice", 0).alias("score"), (F.col("l_quantity") > 25).alias("good"))


@R.add(f"with {_SCORED}, r as (select good, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as r from scored), s as (select sum(r) filter (good) as r, count(*) filter (good)::double as g, count(*) filter (not good)::double as b from r) select round((r - g * (g + 1) / 2) / (g * b), 9) as auc from s")
def m23_auc(spark: SparkSession, d: str) -> DataFrame:
    """The area under the curve."""
    return P.auc(_scored(spark, d))


@R.add(f"with {_SCORED}, p as (select score, count(*) filter (good)::double as g, count(*) filter (not good)::double as b from scored group by 1), r as (select score, lead(score) over (order by score) as nx, sum(g) over (order by score) as ug, sum(b) over (order by score) as ub, sum(g) over () as tg, sum(b) over () as tb from p) select round((score + nx) / 2, 9) as threshold, round((1 - ug / tg) - (1 - ub / tb), 9) as j from r where nx is not null order by j desc, threshold limit 1")
def m24_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold that separates best."""
    return P.youden(_scored(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("v"))


@R.add("""with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), t as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query, t.vec_id as id, round(list_cosine_similarity(q.v, t.v), 9) as similarity from q join t on q.vec_id <> t.vec_id) select query, id, similarity, rank::int as rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from s) where rank <= 5""")
def m36_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all."""
    v = _vectors(spark, d).select("id", "v")
    return vectors.nearest(v.where("id % 20 = 0"), v, 5).withColumn("similarity", F.round("similarity", 9))


@R.add("""with u as (select label::varchar as t, vec_id as id, embedding::double[] as v from embeddings), s as (select a.t as t1, b.t as t2, avg(list_cosine_similarity(a.v, b.v)) as s from u a join u b on a.id <> b.id group by 1, 2) select t1, t2, round(s, 6) as similarity from s""")
def a43_type_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity between types."""
    return vectors.centroid_matrix(_vectors(spark, d))


@R.add("""with x as (select vec_id as id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), m as (select i, avg(v) as m, stddev_pop(v) as s from x group by 1) select id, round(sum(pow((v - m) / s, 2)), 6) as norm2, round(sum((v - m) / s), 6) as total from x join m using (i) group by 1""")
def m33_standardised(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in standard deviations."""
    z = vectors.standardise(_vectors(spark, d), "v", 64)
    return z.select("id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@R.add()
def m33_whitened(spark: SparkSession, d: str) -> DataFrame:
    """ZCA whitening after standardising."""
    w = vectors.zca(vectors.standardise(_vectors(spark, d), "v", 64), "v", 64)
    return w.select("id", F.round(vectors.dot(F.col("v"), F.col("v")), 4).alias("norm2"))


@R.add("""with b as (select vec_id, embedding::double[] as v from embeddings), q as (select * from b where vec_id % 20 = 0), s as (select q.vec_id as query, b.vec_id as id, round(0.3 * list_cosine_similarity(q.v[:32], b.v[:32]) + 0.7 * list_cosine_similarity(q.v[33:], b.v[33:]), 9) as similarity from q join b on q.vec_id <> b.vec_id) select query, id, similarity, rank::int as rank from (select *, row_number() over (partition by query order by similarity desc, id) as rank from s) where rank <= 5""")
def m34_block_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all by the cosines of two blocks, weighted."""
    v = _vectors(spark, d).select("id", vectors.block_scaled(F.col("v"), 32, 64, (0.3, 0.7)).alias("v"))
    return vectors.nearest(v.where("id % 20 = 0"), v, 5).withColumn("similarity", F.round("similarity", 9))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return network(spark, d).select(canonical_id(F.col("bodyId_post")).alias("id"), "roi", F.col("weight").alias("n")).where("id is not null and roi is not null and n > 0")


def _both_regions(spark: SparkSession, d: str) -> DataFrame:
    """``id, block, roi, n``: the deduplicated slices of either side of each neuron."""
    once = network(spark, d).where("roi is not null and weight > 0").select(canonical_id(F.col("bodyId_pre")).alias("pre"), canonical_id(F.col("bodyId_post")).alias("post"), "roi", "weight", "cached_date").distinct()
    sides = once.select("roi", F.col("weight").alias("n"), F.inline(F.array(F.struct(F.lit("in").alias("block"), F.col("post").alias("id")), F.struct(F.lit("out").alias("block"), F.col("pre").alias("id")))))
    return sides.where("id is not null")


_REGIONS = f"{V.SLICES.split(' as (')[0].replace('slices', 'c')} as (select " + V.sql_canonical("bodyId_post") + " as id, roi, weight::double as n from example_bodyid_network where roi is not null and weight > 0), s as (select id, roi, sum(n) as n from c where id is not null group by 1, 2), p as (select id, roi, n / sum(n) over (partition by id) as p from s)"


_SCREEN = f"""once as (select distinct {V.sql_canonical("bodyId_pre")} as pre, {V.sql_canonical("bodyId_post")} as post, roi, weight, cached_date from example_bodyid_network where roi is not null and weight > 0),
c as (select post as id, 'in' as block, roi, sum(weight)::double as n from once where post is not null group by all union all select pre, 'out', roi, sum(weight)::double from once where pre is not null group by all),
u as (select id, block, roi, n / sqrt(sum(n * n) over (partition by id, block)) as p from c), q as (select *, case when roi like '%(L)' then roi[:-4] || '(R)' when roi like '%(R)' then roi[:-4] || '(L)' else roi end as other from u where try_cast(id as decimal(38, 0)) % 20 = 0), k as (select id, count(distinct block) as k from q group by 1),
g as (select q.id as query, u.id, sum(case when q.roi = u.roi then q.p * u.p else 0 end) as a, sum(case when q.other = u.roi then q.p * u.p else 0 end) as b from q join u on q.block = u.block and (q.roi = u.roi or q.other = u.roi) where q.id <> u.id group by 1, 2),
s as (select query, g.id, round(a / k, 9) as direct, round(b / k, 9) as mirrored, round(greatest(a, b) / k, 9) as score from g join k on k.id = query)"""


@R.add(f"with {_SCREEN} select query, id, direct, mirrored, score, rank::int as rank from (select *, row_number() over (partition by query order by score desc, id) as rank from s) where rank <= 10")
def m30_region_screen(spark: SparkSession, d: str) -> DataFrame:
    """M30, M31, SC22: input and output region profiles of every twentieth neuron against all, as they are and mirrored;
    the ten nearest of each."""
    c = _both_regions(spark, d)
    return vectors.region_screen(c, c.where(F.try_mod(F.col("id").try_cast("decimal(38,0)"), F.lit(20)) == 0).select("id"), 10)


@R.add(f"with {_REGIONS} select id, roi, round(sqrt(p), 9) as h from p")
def m32_hellinger(spark: SparkSession, d: str) -> DataFrame:
    """Square roots of shares."""
    return vectors.hellinger(_regions(spark, d))


@R.add(f"with {_SCORES}, s as (select source as query, target as id, weighted_jaccard as score from scores where source <> target), n as (select query, avg(score) as m, stddev_samp(score) as sd from s where id::bigint % 2 = 1 group by 1) select s.query, id, score, round((score - m) / nullif(sd, 0), 5) as z, coalesce((score - m) / nullif(sd, 0) >= 1, false) as qualified from s left join n on s.query = n.query")
def m39_null_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Scores against every second target as null."""
    number = F.col("entity").cast("bigint")
    return P.null_baseline(V.profiles(spark, d), number % 20 == 0, number % 2 == 1, 1.0).withColumn("z", F.round("z", 5))


def _skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a skeleton: each hangs on the one at half its place."""
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return e.select(F.col("user_id").alias("body"), F.col("i").alias("node_id"), F.when(F.col("i") == 0, -1).otherwise(F.floor((F.col("i") - 1) / 2)).cast("int").alias("parent_id"), F.col("value").alias("x"), (F.col("event_id") % 17).cast("double").alias("y"), F.col("i").cast("double").alias("z"), F.lit(1.0).alias("radius"))


_SKEL = "e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events), n as (select user_id as body, i as node_id, case when i = 0 then -1 else (i - 1) // 2 end as parent_id, value as x, (event_id % 17)::double as y, i::double as z from e), c as (select n.body, n.node_id, sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2) + pow(n.z - p.z, 2)) as length from n join n p on n.body = p.body and n.parent_id = p.node_id)"


@R.add(f"with {_SKEL}, k as (select body, parent_id as node_id, count(*) as c from n where parent_id >= 0 group by 1, 2), g as (select n.body, count(*) as n_nodes, count(*) filter (c >= 2) as n_branches, count(*) filter (c is null) as n_tips, count(*) filter (parent_id < 0) as n_roots, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as extent from n left join k on n.body = k.body and n.node_id = k.node_id group by 1) select g.*, coalesce(round(l, 6), 0) as cable from g left join (select body, sum(length) as l from c group by 1) x on g.body = x.body")
def y03_morphometrics(spark: SparkSession, d: str) -> DataFrame:
    """The shape of trees."""
    return skeleton.morphometrics(_skeleton(spark, d))


@R.add(f"with {_SKEL}, m as (select body, median(length) as m from c group by 1) select c.body, node_id, round(length, 6) as length from c join m on c.body = m.body where length > 3 * m")
def y04_extrusions(spark: SparkSession, d: str) -> DataFrame:
    """Edges far longer than usual."""
    return skeleton.extrusions(_skeleton(spark, d), 3).withColumn("length", F.round("length", 6)).withColumn("node_id", F.col("node_id").cast("bigint"))


@R.add(f"with {_SKEL}, b as (select * from (values ('low', 0.0, 50.0), ('high', 50.0, 1e9)) as t(roi, x0, x1)) select c.body, coalesce(b.roi, 'outside') as roi, round(sum(length), 6) as length from c join n on c.body = n.body and c.node_id = n.node_id left join b on x >= x0 and x < x1 group by 1, 2")
def y02_cable_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Cable per region."""
    boxes = spark.createDataFrame([("low", 0.0, 50.0), ("high", 50.0, 1e9)], "roi string, x0 double, x1 double").select("roi", "x0", "x1", F.lit(-1e9).alias("y0"), F.lit(1e9).alias("y1"), F.lit(-1e9).alias("z0"), F.lit(1e9).alias("z1"))
    return skeleton.cable_by_region(_skeleton(spark, d), boxes)
