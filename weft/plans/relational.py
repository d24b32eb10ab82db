"""Scans, filters, joins, aggregates, rankings and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import labels
from weft.operators import edges as E
from weft.operators import filters, lines, mapping, profiles, similarity
from weft.operators.topn import top_n
from weft.plans import views as V
from weft.plans.core_problems import SQL_CURRENT, sql_bare, sql_canonical, sql_untyped
from weft.plans.registry import Registry
from weft.session import table
from weft.sources import formats
from weft.sources.tables import current_neurons, current_rows, network

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add(f"with {V.PAIRS} select pre, post, weight from pairs where weight >= 5")
def sc01_pair_mass(spark: SparkSession, d: str) -> DataFrame:
    """SC1, A1: pair mass over slices, thresholded after summing."""
    return E.pair_mass(V.slices(spark, d), 5)


@R.add(f"select bodyId, type, instance, row_id from {SQL_CURRENT} where trim(type) <> ''")
def sc02_current_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SC2: the newest row per node, empty types dropped."""
    return current_neurons(spark, d, "type", "instance").where("trim(type) <> ''").select("bodyId", "type", "instance", "row_id")


@R.add(f"""with n as {SQL_CURRENT}, f as (select flywire_type as name, min(super_class) as super_class from flywire_types group by 1)
select n.bodyId, coalesce(nullif(trim(n.type), ''), nullif(trim(f.super_class), ''), nullif(trim(n.status), ''), 'Unknown') as type from n left join f on n.flywireType = f.name""")
def sc10_type_chain(spark: SparkSession, d: str) -> DataFrame:
    """SC10: enrichment by left joins, then the first type that is known."""
    cat = table(spark, d, "flywire_types").groupBy(F.col("flywire_type").alias("flywireType")).agg(F.min("super_class").alias("super_class"))
    n = current_neurons(spark, d, "type", "flywireType", "status").join(cat, "flywireType", "left")
    return n.select("bodyId", formats.type_chain(n, ["type", "super_class", "status"]).alias("type"))


@R.add(f"""select bodyId_pre, bodyId_post, sum(weight)::bigint as weight, array_to_string(list_sort(list(distinct roi)), '|') as rois
from (select {sql_canonical('bodyId_pre')} as bodyId_pre, {sql_canonical('bodyId_post')} as bodyId_post, weight, roi from example_bodyid_network) where bodyId_pre is not null and bodyId_post is not null group by 1, 2""")
def sc11_converted_edges(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SC15: one row per pair with its region list."""
    return formats.converted_edges(network(spark, d))


@R.add(f"with {V.PAIRS}, n as {SQL_CURRENT} select n.bodyId, coalesce(t.w, 0)::bigint as post from n left join (select post, sum(weight)::bigint as w from pairs group by 1) t on n.bodyId = t.post")
def sc14_post_backfill(spark: SparkSession, d: str) -> DataFrame:
    """SC14: counts of received weight from the edge table."""
    return formats.backfilled(current_neurons(spark, d, "post"), V.pairs(spark, d)).select("bodyId", "post")


@R.add(f"with {V.PAIRS}, n as {SQL_CURRENT} select n.bodyId, coalesce(t.c, 0)::bigint as out_degree from n left join (select pre, count(*) as c from pairs group by 1) t on n.bodyId = t.pre")
def sc16_completeness(spark: SparkSession, d: str) -> DataFrame:
    """SC16: out-degree per node, 0 for nodes without edges."""
    out = V.pairs(spark, d).groupBy(F.col("pre").alias("bodyId")).agg(F.count(F.lit(1)).alias("out_degree"))
    return current_neurons(spark, d).select("bodyId").join(out, "bodyId", "left").na.fill(0, ["out_degree"])


@R.add("""with cells as (select row_id, 'type' as "column", 0 as priority, type as value from male_cns_neuron_df union all select row_id, 'instance', 1, instance from male_cns_neuron_df union all select row_id, 'status', 2, status from male_cns_neuron_df)
select "column", priority, value, lower(value) as folded, count(distinct row_id) as n_rows, min(row_id) as first_row from cells where trim(value) <> '' group by 1, 2, 3""")
def sc21_search_index(spark: SparkSession, d: str) -> DataFrame:
    """SC21, SC20: each searchable value with its rows."""
    return filters.search_index(table(spark, d, "male_cns_neuron_df"), ["type", "instance", "status"]).select("column", "priority", "value", "folded", F.size("rows").cast("bigint").alias("n_rows"), F.element_at("rows", 1).alias("first_row"))


@R.add(f"""with {V.PAIRS}, wanted as (select distinct bodyId as pre from {SQL_CURRENT} where status = 'anchor')
select 'hit' as kind, pre, count(*) as n from pairs where pre in (select pre from wanted) group by 2 union all select 'miss', pre, 0 from wanted where pre not in (select pre from pairs)""")
def sc23_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """SC23: what a cache holds of a request, and what it lacks."""
    wanted = current_neurons(spark, d, "status").where("status = 'anchor'").select(F.col("bodyId").alias("pre"))
    hit, miss = formats.cache_hits(wanted, V.pairs(spark, d), ["pre"])
    return hit.groupBy("pre").agg(F.count(F.lit(1)).alias("n")).select(F.lit("hit").alias("kind"), "pre", "n").unionByName(miss.select(F.lit("miss").alias("kind"), "pre", F.lit(0).cast("bigint").alias("n")))


@R.add("select distinct custom_label as label, dataset, role, member_kind, trim(member) as member from example_label_mapping where trim(member) <> ''")
def sc30_label_members(spark: SparkSession, d: str) -> DataFrame:
    """SC30: label members, lists exploded."""
    return formats.label_members(table(spark, d, "example_label_mapping").select(F.col("custom_label").alias("label"), "dataset", "role", "member_kind", F.col("member").alias("members")))


@R.add(f"select bodyId from {SQL_CURRENT} where (contains(type, 'Nok') or contains(instance, 'Nok')) and (regexp_matches(type, '[0-9]+a$') or regexp_matches(instance, '[0-9]+a$')) and type is not null and not contains(type, 'zzz') and instance is not null and not contains(instance, 'zzz')")
def f01_structured_filter(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary filter."""
    n = current_neurons(spark, d, "type", "instance")
    return n.where(filters.structured(n, {"contains": ["Nok"], "regex": ["[0-9]+a$"], "not_contains": ["zzz"]}, ["type", "instance"])).select("bodyId")


_TOKENS = "(values ('lNokfupi19'), ('mDemmamlur24_L'), ('traced'), ('no such name')) as t(token)"


@R.add(f"""with n as {SQL_CURRENT}, hits as (select token, bodyId, 0 as p, 'type' as hit from n, {_TOKENS} where type = token union all select token, bodyId, 1, 'instance' from n, {_TOKENS} where instance = token union all select token, bodyId, 2, 'status' from n, {_TOKENS} where status = token)
select token, bodyId, hit from hits h where p = (select min(p) from hits g where g.token = h.token) union all select token, null, 'none' from {_TOKENS} where token not in (select token from hits)""")
def f04_resolve_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens resolved by the first column that knows them."""
    tokens = spark.createDataFrame([("lNokfupi19",), ("mDemmamlur24_L",), ("traced",), ("no such name",)], "token string")
    return filters.resolve_tokens(current_neurons(spark, d, "type", "instance", "status"), tokens, ["type", "instance", "status"])


@R.add(f"""with n as {SQL_CURRENT}, s as (select bodyId, case when starts_with(lower(type), 'fupi') then 0 when starts_with(lower(instance), 'fupi') then 1 else 2 end as stage,
  case when starts_with(lower(type), 'fupi') then type when starts_with(lower(instance), 'fupi') then instance when contains(lower(type), 'fupi') then type when contains(lower(instance), 'fupi') then instance end as value from n)
select bodyId, stage, value from (select * from s where value is not null and stage = (select min(stage) from s where value is not null) order by stage, value, bodyId limit 50)""")
def f06_staged_search(spark: SparkSession, d: str) -> DataFrame:
    """staged prefix and substring search."""
    return filters.staged_search(current_neurons(spark, d, "type", "instance"), "fupi", ["type", "instance"], 50)


@R.add(f"select distinct type from {SQL_CURRENT} where starts_with(instance, 'm')")
def f11_types_of_query(spark: SparkSession, d: str) -> DataFrame:
    """Info, types, ids and instances of a query."""
    n = current_neurons(spark, d, "type", "instance")
    return n.where(filters.matches(F.col("instance"), "startswith", ["m"])).select("type").distinct()


@R.add(f"select row_id, {sql_untyped('b')} as untyped from (select row_id, {sql_bare('flywireType')} as b from male_cns_neuron_df)")
def f15_untyped(spark: SparkSession, d: str) -> DataFrame:
    """labels that mean no type."""
    return table(spark, d, "male_cns_neuron_df").select("row_id", labels.is_untyped(F.col("flywireType")).alias("untyped"))


@R.add(f"""with {V.PAIRS}, n as {SQL_CURRENT}, t as (select bodyId, type, coalesce(nullif(trim(somaSide), ''), 'U') as side, {sql_untyped(sql_bare('type'))} as u from n)
select p.pre, p.post, p.weight, a.type as type_pre, b.type as type_post from pairs p join t a on p.pre = a.bodyId join t b on p.post = b.bodyId where not a.u and not b.u and a.type <> b.type and a.side in ('L', 'U') and b.side in ('L', 'U')""")
def f16_admitted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Guards on edges."""
    t = current_neurons(spark, d, "type", "somaSide").select("bodyId", "type", F.coalesce(F.nullif(F.trim("somaSide"), F.lit("")), F.lit("U")).alias("side"))
    return filters.admit_edges(V.pairs(spark, d), t, True, True, "L")


@R.add(f"with {V.PAIRS}, n as {SQL_CURRENT} select pre, post, weight from pairs where pre not in (select bodyId from n where status = 'traced')")
def f18_without_searched(spark: SparkSession, d: str) -> DataFrame:
    """edges without the sources that were searched."""
    seen = current_neurons(spark, d, "status").where("status = 'traced'").select(F.col("bodyId").alias("pre"))
    return V.pairs(spark, d).join(seen, "pre", "left_anti").select("pre", "post", "weight")


@R.add(f"with {V.TYPE_EDGES}, k as (select post from type_edges group by 1 having max(weight) > 10 and max(weight) <= 200) select pre, post, weight from type_edges where post in (select post from k)")
def f21_filtered_matrix(spark: SparkSession, d: str) -> DataFrame:
    """columns by their largest weight."""
    return filters.filter_matrix(V.type_edges(spark, d), "column", 10, 200, "max").select("pre", "post", "weight")


@R.add(f"with {V.TYPE_EDGES} select pre, post, weight from type_edges where not (pre = 'lNokfupi19' and post = 'mDemmamlur24') and not (pre = 'pLamvolka2a' and post = 'lNokfupi19')")
def f23_excluded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """An exclusion list of type pairs."""
    return filters.exclude_pairs(V.type_edges(spark, d), "lNokfupi19->mDemmamlur24, pLamvolka2a->lNokfupi19")


@R.add(f"select row_id, {sql_canonical('bodyId_pre')} as pre, {sql_canonical('bodyId_post')} as post from example_bodyid_network")
def f27_canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """F27, SC12: canonical ids."""
    return network(spark, d).select("row_id", labels.canonical_id(F.col("bodyId_pre")).alias("pre"), labels.canonical_id(F.col("bodyId_post")).alias("post"))


_LABELS = "l as (select bodyId, case when not u then type end as label from (select bodyId, type, " + sql_untyped(sql_bare("type")) + f" as u from {SQL_CURRENT}))"


@R.add(f"""with {V.PAIRS}, {_LABELS}, tot as (select post, sum(weight) as total from pairs group by 1), e as (select p.*, p.weight / tot.total as r from pairs p join tot using (post)),
g as (select coalesce(a.label, e.pre) as a, coalesce(b.label, e.post) as b, e.* from e left join l a on e.pre = a.bodyId left join l b on e.post = b.bodyId),
m as (select b, sum(total) as total from (select distinct b, post from g) x join tot using (post) group by b)
select g.a as pre, g.b as post, sum(weight)::bigint as weight, count(*) as n_pairs, round(sum(weight) / max(m.total), 9) as ratio, round(sum(least(1.0, r / 0.3) * weight) / sum(weight), 6) as probability from g join m on g.b = m.b group by 1, 2""")
def a03_group_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Nodes to labels with the global denominator."""
    p = V.pairs(spark, d)
    lab = V.types(spark, d).withColumnRenamed("type", "label")
    out = E.aggregate_groups(p, lab, E.incoming_by_node(p), method="average")
    return out.select("pre", "post", "weight", "n_pairs", F.round("ratio", 9).alias("ratio"), F.round("probability", 6).alias("probability"))


@R.add(f"with {V.NATION_EDGES}, {V.NATIONS}, p as (select pre, post, sum(weight)::bigint as weight from nation_edges group by 1, 2), t as (select post, sum(weight) as total from p group by 1) select pre, post, weight, round(weight / total, 12) as ratio from p join t using (post)")
def j04_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The share of the receiver's input."""
    return E.with_ratio(E.pair_mass(V.nation_edges(spark, d))).select("pre", "post", "weight", F.round("ratio", 12).alias("ratio"))


@R.add(f"with {V.PAIRS}, {V.TYPES} select type, sum(weight)::bigint as total from pairs join types on post = bodyId group by 1")
def j03_incoming_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Incoming weight per type."""
    return E.incoming_by_type(V.pairs(spark, d), V.types(spark, d))


@R.add(f"with {V.PAIRS}, {V.TYPES} select a.type as pre, b.type as post, sum(weight)::bigint as w_sum, max(weight)::bigint as w_max, count(*) as n from pairs join types a on pre = a.bodyId join types b on post = b.bodyId where weight >= 3 group by 1, 2")
def a07_type_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sums, maxima and counts between types."""
    return E.type_pairs(V.pairs(spark, d), V.types(spark, d), 3)


@R.add(f"with {V.PAIRS} select post, " + ", ".join(f"sum(case when weight >= {t} then weight else 0 end)::bigint as w_{t}, count(*) filter (weight >= {t}) as n_{t}" for t in (1, 5, 20)) + " from pairs group by 1")
def a09_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Several thresholds in one pass."""
    return E.tiered(V.pairs(spark, d), ["post"], [1, 5, 20])


@R.add(f"with {V.TYPE_EDGES}, o as (select pre as node, count(*) as c, sum(weight)::bigint as w from type_edges where weight > 2 group by 1), i as (select post as node, count(*) as c, sum(weight)::bigint as w from type_edges where weight > 2 group by 1) select coalesce(o.node, i.node) as node, coalesce(o.c, 0)::bigint as out_degree, coalesce(i.c, 0)::bigint as in_degree, coalesce(o.w, 0)::bigint as out_weight, coalesce(i.w, 0)::bigint as in_weight from o full join i on o.node = i.node")
def a10_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees and strengths."""
    return E.degrees(V.type_edges(spark, d), 2)


@R.add(f"with {V.TYPE_EDGES}, deg as (select pre, count(*)::double as c from type_edges group by 1) select round(avg(c), 9) as mean, median(c) as median, round(stddev_samp(c), 9) as sd, max(c) as most from deg")
def a27_degree_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Summary of degrees."""
    deg = V.type_edges(spark, d).groupBy("pre").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return deg.agg(F.round(F.avg("c"), 9).alias("mean"), F.median("c").alias("median"), F.round(F.stddev_samp("c"), 9).alias("sd"), F.max("c").alias("most"))


@R.add(f"with {V.TYPE_EDGES} select pre, post, round(weight / sum(weight) over (partition by pre), 9) as share from type_edges")
def a11_standardised(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a row."""
    return E.standardised(V.type_edges(spark, d), "row").select("pre", "post", F.round("share", 9).alias("share"))


@R.add(f"with {V.NATION_EDGES}, p as (select pre, post, sum(weight)::bigint as weight from nation_edges where dataset = 'P' and roi = 'R' group by 1, 2), n as (select n_nationkey::varchar as x from nation) select a.x as pre, b.x as post, coalesce(weight, 0)::bigint as weight from n a cross join n b left join p on p.pre = a.x and p.post = b.x")
def a12_full_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix with zeros."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("x"))
    return E.full_matrix(n.withColumnRenamed("x", "pre"), n.withColumnRenamed("x", "post"), V.nation_edges(spark, d).where("dataset = 'P' and roi = 'R'"))


@R.add(f"""with {V.MATCHES}, b as (select line, body, max(score) as best, sum(score) as s, count(*) as n from matches group by 1, 2), ds as (select line, dataset, max(score) as top from matches group by 1, 2)
select b.line, round(sum(s) / sum(n), 9) as mean_score, max(best) as max_score, count(*) as n_bodies, max(x.datasets) as datasets, max(x.worst) as worst_dataset, round(max(x.mean), 9) as mean_dataset, round(count(*) / 20000.0, 9) as coverage, round(sum(s) / sum(n) * (count(*) / 20000.0), 9) as weighted_score
from b join (select line, array_to_string(list_sort(list(dataset)), ',') as datasets, min(top) as worst, avg(top) as mean from ds group by 1) x on b.line = x.line group by b.line""")
def a13_line_summary(spark: SparkSession, d: str) -> DataFrame:
    """Matches summed up per line."""
    return lines.line_summary(V.matches(spark, d), 20000)


@R.add(f"""with {V.MATCHES}, b as (select type, body, max(score) as score from matches group by 1, 2), p as (select p_brand as type, count(*) as size from part group by 1)
select b.type, count(*) as n, max(score) as max_score, round(avg(score), 9) as mean_score, round(quantile_cont(score, 0.25), 9) as q25, round(quantile_cont(score, 0.5), 9) as q50, round(quantile_cont(score, 0.75), 9) as q75, round(count(*) / max(size), 9) as share from b left join p on b.type = p.type group by b.type""")
def a15_type_summary(spark: SparkSession, d: str) -> DataFrame:
    """Matches summed up per type."""
    return lines.type_summary(V.matches(spark, d), table(spark, d, "part").groupBy(F.col("p_brand").alias("type")).agg(F.count(F.lit(1)).alias("size")))


@R.add(f"with {V.MATCHES}, c as (select line, type, count(*) as n from matches group by 1, 2), p as (select line, n / sum(n) over (partition by line) as p from c) select line, round(-sum(p * log2(p)), 9) as entropy from p group by 1")
def a17_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of types per line."""
    return lines.entropy(V.matches(spark, d).groupBy("line", "type").agg(F.count(F.lit(1)).alias("n")))


@R.add(f"with {V.MATCHES} select line, round(sum(case when type in ('Brand#11', 'Brand#12') then score else 0 end) / sum(score), 9) as specificity from matches group by 1")
def a18_specificity(spark: SparkSession, d: str) -> DataFrame:
    """The share of score on wanted types."""
    return lines.specificity(V.matches(spark, d), spark.createDataFrame([("Brand#11",), ("Brand#12",)], "type string"))


@R.add(f"with {V.MATCHES}, c as (select line, type, count(*)::double as n from matches group by 1, 2), j as (select n, sum(n) over (partition by line) as a, sum(n) over (partition by type) as b, sum(n) over () as t from c) select round(sum(n / t * log2(n * t / (a * b))), 9) as information from j")
def a19_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of line and type."""
    return lines.mutual_information(V.matches(spark, d))


@R.add(f"""with {V.MATCHES}, b as (select line, type, max(score) as s from matches group by 1, 2), u as (select line, count(*) as n, sum(s) as t from b group by 1), m as (select a.line as l1, c.line as l2, count(*) as shared, sum(least(a.s, c.s)) as low from b a join b c on a.type = c.type and a.line < c.line group by 1, 2)
select l1, l2, shared, round(shared / (x.n + y.n - shared), 9) as jaccard, round(low / (x.t + y.t - low), 9) as weighted_jaccard from m join u x on l1 = x.line join u y on l2 = y.line""")
def a20_colabelling(spark: SparkSession, d: str) -> DataFrame:
    """Lines that label the same types."""
    return lines.colabelling(V.matches(spark, d))


@R.add(f"""with {V.MATCHES}, b as (select line, type, max(score) as s from matches group by 1, 2), u as (select line, sum(s) as t from b group by 1), m as (select a.line as l1, c.line as l2, sum(least(a.s, c.s)) as low from b a join b c on a.type = c.type and a.line < c.line group by 1, 2)
select round(count(*) filter (low / (x.t + y.t - low) > 0.9) / ((select count(*) from supplier) * ((select count(*) from supplier) - 1) / 2), 9) as sparsity from m join u x on l1 = x.line join u y on l2 = y.line""")
def a21_sparsity(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of lines are alike."""
    return lines.sparsity(V.matches(spark, d), 0.9, table(spark, d, "supplier").count())


@R.add(f"with {V.NATION_EDGES}, p as (select dataset, pre || '->' || post as key, sum(weight)::double as value from nation_edges group by 1, 2) select key, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as sd, round(stddev_pop(value) / avg(value), 9) as cv, max(value) - min(value) as range from p group by 1")
def a28_weight_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The spread of an edge over datasets."""
    g = _long(spark, d).groupBy("key").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("value").alias("a"), F.min("value").alias("b"))
    return g.select("key", F.round("m", 9).alias("mean"), F.round("s", 9).alias("sd"), F.round(F.col("s") / F.col("m"), 9).alias("cv"), (F.col("a") - F.col("b")).alias("range"))


@R.add("select coalesce(l_linenumber::varchar, 'all') as hop, count(*) as n from lineitem group by rollup (l_linenumber)")
def a29_counts_with_total(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hop number with a row for all."""
    return table(spark, d, "lineitem").rollup("l_linenumber").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.col("l_linenumber").cast("string"), F.lit("all")).alias("hop"), "n")


@R.add(f"with {V.PAIRS}, t as (select unnest([1, 2, 3, 5, 8, 13, 21, 34, 55, 89]) as t) select t::bigint as t, count(weight) as n, coalesce(sum(weight), 0)::bigint as mass from t left join pairs on weight >= t group by 1")
def a33_density_curve(spark: SparkSession, d: str) -> DataFrame:
    """Edges at each threshold."""
    return E.density_curve(V.pairs(spark, d), [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])


@R.add(f"with n as {SQL_CURRENT} select count(*) as n_neurons, count(*) filter (not {sql_untyped(sql_bare('type'))}) as n_typed, sum(pre)::bigint as pre, sum(post)::bigint as post, round(sum(pre) / count(*), 6) as pre_per_neuron from n")
def a34_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The totals of a dataset."""
    n = current_neurons(spark, d, "type", "pre", "post")
    return n.agg(F.count(F.lit(1)).alias("n_neurons"), F.count_if(~labels.is_untyped(F.col("type"))).alias("n_typed"), F.sum("pre").alias("pre"), F.sum("post").alias("post"), F.round(F.sum("pre") / F.count(F.lit(1)), 6).alias("pre_per_neuron"))


_NT = f"with n as {SQL_CURRENT}, c as (select type, consensusNt as nt, count(*) as k from n where type is not null and consensusNt is not null group by 1, 2)"


@R.add(f"{_NT} select type, nt from (select *, row_number() over (partition by type order by k desc, nt) as r from c) where r = 1")
def a37_majority_transmitter(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent transmitter of a type, the smallest of equals."""
    return current_neurons(spark, d, "type", "consensusNt").where("type is not null and consensusNt is not null").groupBy("type").agg(F.expr("mode(consensusNt, true)").alias("nt"))


@R.add(f"with {V.PAIRS} select a.pre as a, a.post as b, a.weight as forward, b.weight as backward from pairs a join pairs b on a.pre = b.post and a.post = b.pre where a.pre < a.post")
def j20_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    """Pairs linked both ways."""
    return E.reciprocal(V.pairs(spark, d))


@R.add(f"""with {V.PAIRS}, n as (select bodyId, instance from {SQL_CURRENT}), e as (select a.instance as p, b.instance as q, weight from pairs join n a on pre = a.bodyId join n b on post = b.bodyId where regexp_matches(a.instance, '_[LR]$') and regexp_matches(b.instance, '_[LR]$')),
g as (select p[:-3] as base_pre, q[:-3] as base_post, case when p[-1] = q[-1] then 'ipsi' else 'contra' end as kind, sum(case when p[-1] = 'L' then weight else 0 end)::bigint as "left", sum(case when p[-1] = 'R' then weight else 0 end)::bigint as "right" from e group by 1, 2, 3)
select *, "left" > 0 and "right" > 0 as conserved, round(least("left", "right") / greatest("left", "right"), 9) as ratio, abs("left" - "right") as diff from g""")
def j21_mirror_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The left and right image of an edge."""
    n = current_neurons(spark, d, "instance").select("bodyId", "instance")
    e = V.pairs(spark, d).join(n.select(F.col("bodyId").alias("pre"), F.col("instance").alias("p")), "pre").join(n.select(F.col("bodyId").alias("post"), F.col("instance").alias("q")), "post")
    return E.mirror_pairs(e.select(F.col("p").alias("pre"), F.col("q").alias("post"), "weight"))


@R.add(f"with {V.PAIRS}, n as {SQL_CURRENT} select pre, post, weight from pairs where pre in (select bodyId from n where status = 'anchor') and post in (select bodyId from n where somaSide = 'L')")
def g44_direct(spark: SparkSession, d: str) -> DataFrame:
    """Edges from sources to targets."""
    n = current_neurons(spark, d, "status", "somaSide")
    return E.direct(V.pairs(spark, d), n.where("status = 'anchor'").select(F.col("bodyId").alias("pre")), n.where("somaSide = 'L'").select(F.col("bodyId").alias("post"))).select("pre", "post", "weight")


@R.add(f"with {V.PAIRS}, n as (select bodyId from {SQL_CURRENT} where somaSide = 'R') select pre, post, weight from pairs where pre in (select * from n) and post in (select * from n) and pre <> post")
def g45_network_of(spark: SparkSession, d: str) -> DataFrame:
    """The network among one set."""
    return E.network_of(V.pairs(spark, d), current_neurons(spark, d, "somaSide").where("somaSide = 'R'")).select("pre", "post", "weight")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return V.nation_edges(spark, d).groupBy("dataset", F.concat_ws("->", "pre", "post").alias("key")).agg(F.sum("weight").cast("double").alias("value"))


LONG = f"{V.NATION_EDGES}, long as (select dataset, pre || '->' || post as key, sum(weight)::double as value from nation_edges group by 1, 2)"


@R.add("with s as (select user_id, event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) select a as pre, b as post, count(*) as n from s where b is not null group by 1, 2")
def w01_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive elements of a path as edges."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("event_type").alias("pre"), nxt.alias("post")).where("post is not null").groupBy("pre", "post").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {V.PROFILES} select entity, partner, weight, rank() over (partition by entity order by weight desc) as rank, (rank() over (partition by entity order by weight desc) + (count(*) over (partition by entity, weight) - 1) / 2)::double as mean_rank from profiles")
def w02_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Competition and mean ranks."""
    p = V.profiles(spark, d)
    return p.select("entity", "partner", "weight", F.rank().over(Window.partitionBy("entity").orderBy(F.desc("weight"))).cast("bigint").alias("rank"), similarity.average_rank(["entity"], F.col("weight"), True).alias("mean_rank"))


@R.add(f"with {V.MATCHES}, o as (select line, max(score) as s from matches where dataset = 'R' group by 1), t as (select line, max(score) as s from matches where dataset = 'A' group by 1), a as (select line, row_number() over (order by s desc, line) as r from o), b as (select line, row_number() over (order by s desc, line) as r from t) select coalesce(a.line, b.line) as line, coalesce(a.r, (select count(*) + 1 from o)) as rank_1, coalesce(b.r, (select count(*) + 1 from t)) as rank_2, coalesce(a.r, (select count(*) + 1 from o)) + coalesce(b.r, (select count(*) + 1 from t)) as combined from a full join b on a.line = b.line")
def w09_combined_rank(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings put together."""
    m = V.matches(spark, d)
    best = lambda s: m.where(F.col("dataset") == s).groupBy("line").agg(F.max("score").alias("score"))
    return lines.combined_rank(best("R"), best("A"))


@R.add(f"with {LONG} select dataset, key, value, r::int as rank from (select *, row_number() over (partition by dataset order by value desc, key) as r from long) where r <= 50")
def t01_top_edges(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest edges of each dataset."""
    return top_n(_long(spark, d), ["dataset"], [F.desc("value"), F.asc("key")], 50)


@R.add(f"with {V.PAIRS}, s as (select min(weight) as tau from (select weight from pairs order by weight desc limit 100)) select pre, post, weight from pairs where weight >= (select tau from s)")
def t06_budget_with_ties(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred and all ties of the last."""
    p = V.pairs(spark, d)
    tau = p.select("weight").orderBy(F.desc("weight")).limit(100).agg(F.min("weight"))
    return p.where(F.col("weight") >= tau.scalar()).select("pre", "post", "weight")


@R.add(f"with {V.PAIRS}, {V.TYPES}, l as (select pre, post, weight, a.type as tp from pairs left join types a on pre = a.bodyId), r as (select *, row_number() over (partition by post order by weight desc, pre) as r from l) select post as entity, tp as partner, sum(weight)::bigint as weight from (select *, sum(new) over (partition by post order by r) as seen from (select *, case when tp is not null and row_number() over (partition by post, tp order by r) = 1 then 1 else 0 end as new from r where r <= 30)) x join (select post as p2, min(case when seen >= 8 then r end) as at_r from (select *, sum(new) over (partition by post order by r) as seen from (select *, case when tp is not null and row_number() over (partition by post, tp order by r) = 1 then 1 else 0 end as new from r where r <= 30)) group by 1) y on post = p2 where r <= case when at_r is null then 30 when at_r <= 10 then 10 else least(10 + 5 * ceil((at_r - 10) / 5.0), 30) end and tp is not null group by 1, 2")
def a23_dynamic_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles that grow until enough types are covered."""
    t = V.types(spark, d).select(F.col("bodyId").alias("pre"), "type")
    e = V.pairs(spark, d).join(t, "pre", "left").select(F.col("post").alias("entity"), F.col("pre").alias("other"), F.col("type").alias("partner"), "weight")
    return profiles.dynamic_profile(e, 10, 8, 3)


@R.add("select event_id, try_cast(json_extract(props, '$.k') as double) as k from events")
def x22_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON cells."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:double>")["k"].alias("k"))


@R.add("select n_name, upper(n_name[1]) || lower(n_name[2:]) as display, '[' || n_name || ', ' || r_name || ']' as cell, sha256(n_name || '|' || r_name) as key from nation join region on n_regionkey = r_regionkey")
def x07_labels(spark: SparkSession, d: str) -> DataFrame:
    """Composed labels, list cells and keys."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))).alias("display"), F.concat(F.lit("["), F.array_join(F.array("n_name", "r_name"), ", "), F.lit("]")).alias("cell"), F.sha2(F.concat_ws("|", "n_name", "r_name"), 256).alias("key"))


@R.add(f"with n as {SQL_CURRENT}, x as (select bodyId, unnest(string_split(hemibrainType, ',')) as c from n), b as (select distinct bodyId, {sql_bare('c')} as name from x) select bodyId, name from b where not {sql_untyped('name')}")
def x03_cell_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of comma-joined cells."""
    return current_neurons(spark, d, "hemibrainType").select("bodyId", F.explode(labels.cell_names(F.col("hemibrainType"))).alias("name"))


def _walk(spark: SparkSession, d: str, column: str) -> DataFrame:
    return mapping.crosswalk(current_neurons(spark, d, "type", column).where(~labels.is_untyped(F.col("type"))), "type", column)


def _sql_walk(column: str, name: str) -> str:
    return f"""{name}_v as (select distinct bodyId, type as source_name, {sql_bare('c')} as target_name from (select bodyId, type, unnest(string_split({column}, ',')) as c from {SQL_CURRENT} where not {sql_untyped(sql_bare('type'))})),
{name}_p as (select source_name, target_name, count(*) as votes from {name}_v where not {sql_untyped('target_name')} group by 1, 2),
{name} as (select *, count(*) over (partition by source_name) as n_targets, count(*) over (partition by target_name) as n_sources from {name}_p)"""


@R.add(f"with {_sql_walk('flywireType', 'w')} select source_name, target_name, votes, n_targets, n_sources, case when n_targets > 1 and n_sources > 1 then 'N-N' when n_targets > 1 then '1-N' when n_sources > 1 then 'N-1' else '1-1' end as conflict from w")
def e05_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Names of one release against those of another."""
    return _walk(spark, d, "flywireType")


@R.add(f"with {_sql_walk('flywireType', 'w')}, r as (select *, row_number() over (partition by source_name order by votes desc, target_name) as r, lead(votes) over (partition by source_name order by votes desc, target_name) as nx, sum(votes) over (partition by source_name) as t from w) select source_name, target_name, votes from r where r = 1 and votes * 2 > t and votes >= 2 * coalesce(nx, 0)")
def a35_dominant_vote(spark: SparkSession, d: str) -> DataFrame:
    """Winners with a majority and twice the next."""
    return mapping.dominant(_walk(spark, d, "flywireType"))


@R.add(f"with {_sql_walk('flywireType', 'w')}, {_sql_walk('mancType', 'm')} select w.target_name as source_name, m.target_name, sum(least(w.votes, m.votes))::bigint as votes from w join m on w.source_name = m.source_name group by 1, 2")
def e08_composed(spark: SparkSession, d: str) -> DataFrame:
    """Names linked over a third release."""
    w = _walk(spark, d, "flywireType")
    return mapping.compose(w.select(F.col("target_name").alias("source_name"), F.col("source_name").alias("target_name"), "votes"), _walk(spark, d, "mancType"))


@R.add(f"""with {_sql_walk('mancType', 'w')}, {V.PAIRS}, {V.TYPES}, p as (select post as entity, type as partner, sum(weight) as weight from pairs join types on pre = bodyId group by 1, 2) select entity, coalesce(target_name, partner) as partner, round(sum(weight / coalesce(n_targets, 1)), 6) as weight from p left join w on partner = source_name group by 1, 2""")
def e11_expanded_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles in the names of another release, splits shared evenly."""
    t = V.types(spark, d).select(F.col("bodyId").alias("pre"), F.col("type").alias("partner"))
    p = V.pairs(spark, d, "pre", "post").join(t, "pre").groupBy(F.col("post").alias("entity"), "partner").agg(F.sum("weight").alias("weight"))
    return mapping.expand_profile(p, _walk(spark, d, "mancType"), 6)


@R.add(f"with {_sql_walk('mancType', 'w')}, n as (select type as name from canonical_types), g as (select source_name, count(*) as n, min(target_name) as t, max(n_sources) as s from w group by 1) select name, case when n is null then 'unmapped' when n > 1 then 'split' when s > 1 then 'merged' else 'mapped' end as status, case when n = 1 then t end as target from n left join g on name = source_name")
def e06_mapping_status(spark: SparkSession, d: str) -> DataFrame:
    """The decision per name."""
    return mapping.mapping_status(table(spark, d, "canonical_types").select(F.col("type").alias("name")), _walk(spark, d, "mancType"))


@R.add(f"""with n as (select bodyId, type, instance from {SQL_CURRENT}), m as (select member_kind, member, min(custom_label) as label from example_label_mapping where dataset = 'male-cns' and custom_label is not null and member is not null group by 1, 2)
select bodyId, coalesce(a.label, b.label || coalesce(regexp_extract(type, '(_[LRU])$', 1), ''), c.label, type, bodyId) as label from n left join m a on a.member_kind = 'bodyId' and a.member = bodyId left join m b on b.member_kind = 'type' and b.member = regexp_replace(type, '_[LRU]$', '') left join m c on c.member_kind = 'instance' and c.member = instance""")
def e01_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by id, type or instance."""
    members = table(spark, d, "example_label_mapping").where("custom_label is not null and member is not null").withColumnRenamed("custom_label", "label")
    nodes = current_neurons(spark, d, "type", "instance").select("bodyId", "type", "instance", F.lit("male-cns").alias("dataset"))
    return mapping.apply_labels(nodes, members).select("bodyId", "label")


@R.add(f"""with n as (select bodyId, type, case when somaSide = 'L' then type || '_left' when bodyId[-1] = '7' then 'lNokfupi19' end as label from {SQL_CURRENT} where type is not null), g as (select type, count(*) as c, count(label) as l from n group by 1)
select bodyId, coalesce(label, case when l < c and (l > 0 or n.type in (select label from n where label is not null)) then n.type || '*' end, n.type) as effective from n join g on n.type = g.type""")
def e03_residual(spark: SparkSession, d: str) -> DataFrame:
    """The rest of partly labelled types."""
    n = current_neurons(spark, d, "type", "somaSide").where("type is not null")
    n = n.select("bodyId", "type", F.when(F.col("somaSide") == "L", F.concat("type", F.lit("_left"))).when(F.col("bodyId").endswith("7"), "lNokfupi19").alias("label"))
    return mapping.residual_types(n)


@R.add("with w as (select type from canonical_types), p as (select neuron_type as type, dataset, count(*) as n from connectivity_profile group by 1, 2) select w.type, x.dataset, coalesce(n, 0)::bigint as n from w cross join (select distinct dataset from connectivity_profile) x left join p on p.type = w.type and p.dataset = x.dataset")
def e17_type_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which types each dataset covers."""
    p = table(spark, d, "connectivity_profile").select(F.col("neuron_type").alias("type"), "dataset")
    return mapping.type_coverage(table(spark, d, "canonical_types"), p, p)


@R.add("select flywire_type as name, super_class, first_seen, removed_at from (select *, row_number() over (partition by flywire_type order by first_seen desc, coalesce(removed_at, timestamp '9999-01-01') desc, super_class) as r from flywire_types) where r = 1")
def sc05_latest_listing(spark: SparkSession, d: str) -> DataFrame:
    """SC4-SC6, SC22: the latest period of each name."""
    t = table(spark, d, "flywire_types").withColumn("__end", F.coalesce("removed_at", F.to_timestamp(F.lit("9999-01-01"))))
    w = Window.partitionBy("flywire_type").orderBy(F.desc("first_seen"), F.desc("__end"), F.asc_nulls_last("super_class"))
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("flywire_type").alias("name"), "super_class", "first_seen", "removed_at")
