"""Partner profiles of entities and the search for their counterparts. Profiles are ``entity, partner, weight`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import tiles
from weft.operators.similarity import average_rank, pearson
from weft.operators.skew import running_sums


def dynamic_profile(edges: DataFrame, top_k: int, top_m: int, factor: int) -> DataFrame:
    """``entity, partner, weight``: the partner types of each entity's strongest edges.

    ``edges`` has ``entity, other, partner, weight`` (``partner`` null if untyped). Of each entity the ``top_k``
    heaviest edges are taken, and five more at a time until ``top_m`` distinct partners are covered or
    ``top_k * factor`` edges are reached; of equal weights the smaller ``other`` comes first.
    """
    own = Window.partitionBy("entity").orderBy(F.desc("weight"), "other")
    ranked = edges.withColumn("r", F.row_number().over(own)).where(F.col("r") <= top_k * factor)
    first = Window.partitionBy("entity", "partner").orderBy("r")
    flagged = ranked.withColumn("new", F.when(F.col("partner").isNotNull() & (F.row_number().over(first) == 1), 1).otherwise(0))
    seen = flagged.withColumn("seen", F.sum("new").over(Window.partitionBy("entity").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    enough = seen.groupBy("entity").agg(F.min(F.when(F.col("seen") >= top_m, F.col("r"))).alias("at"))
    steps = F.ceil((F.col("at") - top_k) / 5.0)
    limit = F.when(F.col("at").isNull(), top_k * factor).when(F.col("at") <= top_k, top_k).otherwise(F.least(top_k + 5 * steps, F.lit(top_k * factor)))
    kept = seen.join(enough, "entity").where((F.col("r") <= limit) & F.col("partner").isNotNull())
    return kept.groupBy("entity", "partner").agg(F.sum("weight").alias("weight"))


def merge_profiles(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, partner, weight, variance, rank`` of the members (``entity, grp``) of each group together.

    ``rank`` is the competition rank of the summed weight.
    """
    sums = profiles.join(groups, "entity").groupBy("grp", "partner").agg(F.sum("weight").alias("weight"), F.var_pop("weight").alias("variance"))
    return sums.withColumn("rank", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("weight"))))


def proportions(profiles: DataFrame) -> DataFrame:
    """Profiles with each partner's ``share`` of the weight of its entity."""
    return profiles.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("entity")))


def score_pairs(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target`` and their scores, of all pairs that share a partner.

    Shared partners meet in an equality join; what the union needs follows from sums per side. ``rank_union`` is the
    Spearman correlation over the union of partners, absent ones counting 0: absent partners of a side share the
    lowest ranks, so it has a closed form; null with fewer than three partners or a constant side. Pairs without a
    shared partner have Jaccard 0 and are left to ``disjoint_rank_union``.
    """

    def side(df: DataFrame, name: str, x: str) -> DataFrame:
        known = df.where("weight > 0").withColumn("rk", average_rank(["entity"], F.col("weight")))
        total = Window.partitionBy("entity")
        return known.select(F.col("entity").alias(name), "partner", F.col("weight").cast("double").alias(f"w{x}"), F.col("rk").alias(f"r{x}"), F.count(F.lit(1)).over(total).alias(f"n{x}"), F.sum("weight").over(total).cast("double").alias(f"s{x}"), F.sum(F.col("weight") * F.col("weight")).over(total).cast("double").alias(f"ss{x}"), F.sum(F.col("rk") * F.col("rk")).over(total).alias(f"rr{x}"))

    met = side(queries, "source", "a").join(side(targets, "target", "b"), "partner")
    g = met.groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("na", "nb", "sa", "sb", "ssa", "ssb", "rra", "rrb")], F.sum(F.least("wa", "wb")).alias("low"), F.sum(F.col("wa") * F.col("wb")).alias("ab"), F.sum(F.col("ra") * F.col("rb")).alias("rab"), F.sum("ra").alias("ra"), F.sum("rb").alias("rb"))
    c = F.col
    n = (c("na") + c("nb") - c("shared")).cast("double")
    rank_union = _union_rank(n, c("na"), c("nb"), c("shared"), c("rra"), c("rrb"), c("rab"), c("ra"), c("rb"))
    return g.select("source", "target", "shared", n.cast("bigint").alias("total"), F.round(c("shared") / n, 9).alias("jaccard"), F.round(c("low") / (c("sa") + c("sb") - c("low")), 9).alias("weighted_jaccard"), F.round(c("ab") / F.sqrt(c("ssa") * c("ssb")), 9).alias("cosine"), F.round(rank_union, 9).alias("rank_union"))


def _union_rank(n: Column, p: Column, q: Column, s: Column, rra: Column, rrb: Column, rab: Column, ra: Column, rb: Column) -> Column:
    """Spearman over ``n`` keys of which a side knows ``p`` (``q``) with ranks 1..p and both know ``s``.

    Its absent keys take the ranks below, ``n - p`` of them at their mean; all sums follow.
    """
    oa, ob = n - p, n - q  # offsets of known ranks, and numbers of absent keys
    za, zb = (oa + 1) / 2, (ob + 1) / 2
    sa, sb = p * (p + 1) / 2, q * (q + 1) / 2
    sxx = rra + 2 * oa * sa + p * oa * oa + oa * za * za
    syy = rrb + 2 * ob * sb + q * ob * ob + ob * zb * zb
    both = rab + ob * ra + oa * rb + s * oa * ob
    only_a = (sa - ra + (p - s) * oa) * zb
    only_b = (sb - rb + (q - s) * ob) * za
    total = n * (n + 1) / 2
    return F.when(n >= 3, pearson(n, total, total, sxx, syy, both + only_a + only_b))


def _packed(profiles: DataFrame, values: list[str]) -> DataFrame:
    """Entities with the sizes and sums of their profiles, and of their partners the weight ``w`` or the rank ``rk``."""
    known = profiles.where("weight > 0 and entity is not null").withColumn("rk", average_rank(["entity"], F.col("weight"))).withColumn("w", F.col("weight").cast("double"))
    return tiles.pack(known, "partner", values, {"n": F.count(F.lit(1)), "s": F.sum("weight").cast("double"), "rr": F.sum(F.col("rk") * F.col("rk"))})


def _chain_keys(t: tiles.Tiles, tile: tuple):
    """Numbers that order the pairs of a tile like Jaccard and then rank correlation (nulls last) rise, both to nine
    decimals; -1 for pairs that share no partner."""
    import numpy as np

    size = (tile[1] - tile[0], tile[3] - tile[2])
    s, rab, ra, rb = (np.zeros(size) for _ in range(4))
    for (xa, ka), (xb, kb) in t.parts(tile):
        s += xa.T @ xb
        rab += ka.T @ kb
        ra += ka.T @ xb
        rb += xa.T @ kb
    p, rra = (t.a.fact(c)[tile[0] : tile[1], None].astype(float) for c in ("n", "rr"))
    q, rrb = (t.b.fact(c)[None, tile[2] : tile[3]].astype(float) for c in ("n", "rr"))
    n = p + q - s
    oa, ob = n - p, n - q  # as in _union_rank
    za, zb, sa, sb, total = (oa + 1) / 2, (ob + 1) / 2, p * (p + 1) / 2, q * (q + 1) / 2, n * (n + 1) / 2
    sxx = rra + oa * (2 * sa + oa * p + za * za)
    syy = rrb + ob * (2 * sb + ob * q + zb * zb)
    sxy = rab + ob * ra + oa * rb + s * oa * ob + (sa - ra + (p - s) * oa) * zb + (sb - rb + (q - s) * ob) * za
    tt = total * total
    sxx *= n
    syy *= n
    vx, vy = sxx - tt, syy - tt
    known = (n >= 3) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
    vx *= vy
    vx[~known] = 1
    rank = tiles.nine((n * sxy - tt) / np.sqrt(vx))
    rank = np.where(known, np.clip(rank, -1e9, 1e9) + 1000000001, 0).astype(np.int64)
    out = (tiles.nine(s / n).astype(np.int64) << 31) + rank
    out[s == 0] = -1
    return out


def disjoint_rank_union(sizes: DataFrame) -> DataFrame:
    """``rank_union`` of pairs that share nothing, from ``p, rr_a, q, rr_b`` alone (sizes and sums of squared ranks)."""
    c = F.col
    n = (c("p") + c("q")).cast("double")
    zero = F.lit(0.0)
    return sizes.withColumn("rank_union", F.round(_union_rank(n, c("p"), c("q"), zero, c("rr_a"), c("rr_b"), zero, zero, zero), 9))


def homologs_strict(scores: DataFrame, least_shared: int, n: int) -> DataFrame:
    """``source, target, score, rank``: half the positive rank correlation, 0.3 of the Jaccard of typed partners and
    0.2 of that of two-hop partners (column ``jaccard_2hop``); an undefined correlation counts 0."""
    two = F.coalesce(F.col("jaccard_2hop"), F.lit(0.0)) if "jaccard_2hop" in scores.columns else F.lit(0.0)
    score = 0.5 * F.greatest(F.coalesce("rank_union", F.lit(0.0)), F.lit(0.0)) + 0.3 * F.col("jaccard") + 0.2 * two
    out = scores.where(F.col("shared") >= least_shared).withColumn("score", F.round(score, 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))).where(F.col("rank") <= n).select("source", "target", "score", "rank")


def chain_order() -> list[Column]:
    """The order of candidates: Jaccard, then rank correlation (both falling, nulls last), then id."""
    return [F.desc_nulls_last("jaccard"), F.desc_nulls_last("rank_union"), F.asc("target")]


def rank_candidates(scores: DataFrame) -> DataFrame:
    """``scores`` with ``rank_jaccard``, ``rank_corr`` (competition ranks) and ``place`` in the chain order per source."""
    w = lambda c: Window.partitionBy("source").orderBy(F.desc_nulls_last(c))
    return scores.withColumns({"rank_jaccard": F.rank().over(w("jaccard")), "rank_corr": F.rank().over(w("rank_union")), "place": F.row_number().over(Window.partitionBy("source").orderBy(*chain_order()))})


def top_union(ranked: DataFrame, k: int) -> DataFrame:
    """The candidates that are among the first ``k`` by either measure, ties broken by the chain."""
    by = lambda c: F.row_number().over(Window.partitionBy("source").orderBy(F.asc(c), *chain_order()))
    return ranked.withColumns({"k1": by("rank_jaccard"), "k2": by("rank_corr")}).where((F.col("k1") <= k) | (F.col("k2") <= k)).drop("k1", "k2")


def admit(ranked: DataFrame, n: int, floor: float) -> DataFrame:
    """``tier`` of each candidate by its best rank: matched (within ``n`` and at ``floor`` or more), near, far."""
    best = F.least("rank_jaccard", "rank_corr")
    return ranked.withColumn("bar_rank", best).withColumn("tier", F.when((best <= n) & (F.col("rank_union") >= floor), "matched").when(best <= n, "near").otherwise("far"))


def nearest(profiles: DataFrame) -> DataFrame:
    """``entity, n, first, last, jaccard, rank_union``: with how many others an entity shares a partner, and the best of
    them by Jaccard, then rank correlation (nulls last); of equals the smallest (``first``) and the largest id (``last``).

    The scores are those of ``score_pairs``, which are the same both ways, so each pair is compared once.
    """

    def work(a: tiles.Side, b: tiles.Side):
        import numpy as np
        import pyarrow as pa

        t = tiles.Tiles(a, b, "partner", ["rk"])
        same = bool(a.size and b.size and a.names[0] == b.names[0])
        found = [[np.full(x.size, v, np.int64) for v in (0, -1, 0, 0)] for x in (a, b)]

        def see(side: int, lo: int, order, other: int) -> None:
            n, best, first, last = (x[lo : lo + len(order)] for x in found[side])
            n += np.count_nonzero(order >= 0, axis=1)
            top = order.max(axis=1)
            up = np.flatnonzero((top >= 0) & (top >= best))
            hit = order[up] == top[up, None]
            f, e = other + hit.argmax(axis=1), other + hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1)
            tie = best[up] == top[up]
            first[up], last[up] = np.where(tie, np.minimum(first[up], f), f), np.where(tie, np.maximum(last[up], e), e)
            best[up] = top[up]

        for tile in t.bounds():
            order = _chain_keys(t, tile)
            if same:
                order[np.arange(tile[0], tile[1])[:, None] == np.arange(tile[2], tile[3])] = -1
            see(0, tile[0], order, tile[2])
            if not same:
                see(1, tile[2], order.T, tile[0])
        for (n, best, first, last), own, other in zip(found, (a, b), (b, a), strict=True):
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(own.names[some], pa.string()), pa.array(n[some]), pa.array(best[some]), pa.array(other.names[first[some]], pa.string()), pa.array(other.names[last[some]], pa.string())], ["entity", "n", "key", "first", "last"])

    found = tiles.run(tiles.triangle(_packed(profiles, ["rk"])), work, "entity string, n bigint, key bigint, first string, last string")
    best = found.groupBy("entity").agg(F.sum("n").alias("n"), F.max("key").alias("key"), F.min(F.struct(-F.col("key"), "first"))["first"].alias("first"), F.max(F.struct("key", "last"))["last"].alias("last"))
    rank = F.expr("key & 2147483647")
    return best.select("entity", "n", "first", "last", (F.shiftright("key", 31) / 1e9).alias("jaccard"), F.when(rank > 0, (rank - 1000000001) / 1e9).alias("rank_union"))


def mutual_best(profiles: DataFrame) -> DataFrame:
    """``source, target, jaccard, rank_union``: the pairs that are each other's first candidate in the chain order."""
    best = nearest(profiles).groupBy(F.least("entity", "first").alias("a"), F.greatest("entity", "first").alias("b"))
    both = best.agg(F.count(F.lit(1)).alias("ways"), F.max("jaccard").alias("jaccard"), F.max("rank_union").alias("rank_union")).where("ways = 2")
    return both.select(F.inline(F.expr("array(struct(a as source, b as target), struct(b as source, a as target))")), "jaccard", "rank_union")


def _strip_rows(a: tiles.Side, b: tiles.Side) -> int:
    """How many sources are looked at together when all their targets are needed at once."""
    return max(1, min(tiles.TILE_ROWS, 8 * tiles.TILE // max(1, b.size)))


def _others(t: tiles.Tiles, tile: tuple, values, none) -> None:
    """Sets the pairs of an entity with itself to ``none``."""
    import numpy as np

    at = np.searchsorted(t.b.names, t.a.names[tile[0] : tile[1]]) - tile[2]
    row = np.flatnonzero((at >= 0) & (at < tile[3] - tile[2]))
    row = row[t.b.names[tile[2] + at[row]] == t.a.names[tile[0] + row]]
    values[row, at[row]] = none


def best_places(profiles: DataFrame, is_source: Column, windows: DataFrame) -> DataFrame:
    """``source, target, place``: of each source as many other entities as its window (``entity, window``) says, in the
    chain order of their scores, which are those of ``score_pairs``."""

    def work(a: tiles.Side, b: tiles.Side):
        import numpy as np
        import pyarrow as pa

        t = tiles.Tiles(a, b, "partner", ["rk"])
        names, rows = pa.array(b.names, pa.string()), _strip_rows(a, b)
        order = np.empty((rows, b.size), np.int64)
        for tile in t.bounds(rows):
            keys = _chain_keys(t, tile)
            _others(t, tile, keys, -1)
            order[: len(keys), tile[2] : tile[3]] = keys
            for i in range(tile[0], tile[1]) if tile[3] == b.size else ():
                own = order[i - tile[0]]
                first = np.argsort(-own, kind="stable")[: int(a.fact("window")[i])]
                first = first[own[first] >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([a.names[i]] * len(first), pa.string()), names.take(pa.array(first)), pa.array(np.arange(1, len(first) + 1, dtype=np.int32))], ["source", "target", "place"])

    packed = _packed(profiles, ["rk"]).join(windows.select("entity", "window"), "entity", "left")
    return tiles.run(tiles.strips(packed, is_source & F.col("window").isNotNull()), work, "source string, target string, place int")


def null_baseline(profiles: DataFrame, is_source: Column, is_null: Column, bar: float) -> DataFrame:
    """``query, id, score, z, qualified``: the weighted Jaccard similarity of the sources to all others that share a
    partner, against the mean and spread of those to the null entities, and whether it reaches ``bar``."""

    def work(a: tiles.Side, b: tiles.Side):
        import numpy as np
        import pyarrow as pa

        t = tiles.Tiles(a, b, "partner", ["w"])
        names, rows = pa.array(b.names, pa.string()), _strip_rows(a, b)
        null = b.fact("null").astype(bool)
        score = np.empty((rows, b.size))
        for tile in t.bounds(rows):
            size = (tile[1] - tile[0], tile[3] - tile[2])
            shared, low = np.zeros(size), np.zeros(size)
            for (xa, wa), (xb, wb) in t.parts(tile):
                shared += xa.T @ xb
                tiles.least_sums(wa, wb, low)
            value = tiles.nine(low / (a.fact("s")[tile[0] : tile[1], None] + b.fact("s")[None, tile[2] : tile[3]] - low)) / 1e9
            value[shared == 0] = np.nan
            _others(t, tile, value, np.nan)
            score[: size[0], tile[2] : tile[3]] = value
            for i in range(tile[0], tile[1]) if tile[3] == b.size else ():
                own = score[i - tile[0]]
                at = np.flatnonzero(~np.isnan(own))
                base, own = own[at[null[at]]], own[at]
                spread = np.std(base, ddof=1) if len(base) > 1 and base.min() < base.max() else np.nan
                z = (own - base.mean()) / spread if len(base) else np.full(len(own), np.nan)
                yield pa.RecordBatch.from_arrays([pa.array([a.names[i]] * len(at), pa.string()), names.take(pa.array(at)), pa.array(own), pa.array(z, from_pandas=True), pa.array(z >= bar)], ["query", "id", "score", "z", "qualified"])

    packed = _packed(profiles, ["w"]).withColumn("null", F.coalesce(is_null, F.lit(False)).cast("int"))
    return tiles.run(tiles.strips(packed, is_source), work, "query string, id string, score double, z double, qualified boolean")


def quality_gate(profiles: DataFrame, least_weight: float, least_partners: int) -> DataFrame:
    """The entities with enough weight and partners."""
    return profiles.where("weight > 0").groupBy("entity").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).where((F.col("total") >= least_weight) & (F.col("n") >= least_partners))


def shared_partner_candidates(edges: DataFrame, queries: DataFrame, least: int, n: int) -> DataFrame:
    """``post, shared, weight``: the nodes that share most input partners with the ``queries`` (``post``), those left out."""
    partners = edges.join(queries, "post", "left_semi").select("pre").distinct()
    met = edges.join(partners, "pre", "left_semi").join(queries, "post", "left_anti")
    return met.groupBy("post").agg(F.countDistinct("pre").alias("shared"), F.sum("weight").alias("weight")).where(F.col("shared") >= least).orderBy(F.desc("shared"), F.desc("weight"), "post").limit(n)


def auc(scored: DataFrame) -> DataFrame:
    """``auc`` of ``score`` for ``good`` (boolean) rows by the rank sum, ties at half; null if a class is missing.

    Ranks come from the distinct scores, so they are not gathered row by row.
    """
    per = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    run = running_sums(per, "score", ["b"])
    wins = run.withColumn("wins", F.col("g") * (F.col("upto_b") - F.col("b") / 2))
    return wins.agg(F.round(F.sum("wins") / F.nullif(F.sum("g") * F.sum("b"), F.lit(0)), 9).alias("auc"))


def youden(scored: DataFrame) -> DataFrame:
    """``threshold, j``: the midpoint between neighbouring scores that separates the classes best, the lowest of equals."""
    per = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    total = per.agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    run = running_sums(per, "score", ["g", "b"]).withColumns({"gt": total.select("g").scalar(), "bt": total.select("b").scalar()})
    j = (1 - F.col("upto_g") / F.nullif("gt", F.lit(0))) - (1 - F.col("upto_b") / F.nullif("bt", F.lit(0)))
    best = run.select("score", F.round(j, 9).alias("j")).orderBy(F.desc("j"), "score").limit(1)
    after = per.join(best.select(F.col("score").alias("at"), "j"), F.col("score") > F.col("at")).groupBy("at", "j").agg(F.min("score").alias("next"))
    return after.select(F.round((F.col("at") + F.col("next")) / 2, 9).alias("threshold"), "j")


def two_hop_profile(edges: DataFrame, types: DataFrame, top_k: int) -> DataFrame:
    """``entity, partner, weight``: the typed inputs of the untyped inputs of each entity.

    ``edges`` has ``pre, post, weight``, ``types`` the typed nodes. Of each untyped input its ``top_k`` heaviest inputs
    count, with the weight of the two hops multiplied; of equal weights the smaller id comes first.
    """
    first = edges.join(types.select(F.col("bodyId").alias("pre")), "pre", "left_anti").select(F.col("post").alias("entity"), F.col("pre").alias("mid"), F.col("weight").alias("w1"))
    mids = edges.join(first.select(F.col("mid").alias("post")).distinct(), "post", "left_semi")
    best = mids.withColumn("r", F.row_number().over(Window.partitionBy("post").orderBy(F.desc("weight"), F.length("pre"), "pre"))).where(F.col("r") <= top_k)
    second = best.join(types.select(F.col("bodyId").alias("pre"), "type"), "pre").select(F.col("post").alias("mid"), F.col("type").alias("partner"), F.col("weight").alias("w2"))
    return first.join(second, "mid").groupBy("entity", "partner").agg(F.sum(F.col("w1") * F.col("w2")).alias("weight"))


def pooled(profiles: DataFrame) -> DataFrame:
    """``target, n_sources, best_source, jaccard``: the candidates of all sources pooled by target; of equals the largest."""
    return nearest(profiles).select(F.col("entity").alias("target"), F.col("n").alias("n_sources"), F.col("last").alias("best_source"), "jaccard")


def as_vectors(profiles: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``entity, v``: weights in the order of ``vocabulary``, 0 where a partner is absent."""
    wide = profiles.groupBy("entity").pivot("partner", vocabulary).agg(F.sum("weight"))
    return wide.select("entity", F.array(*[F.coalesce(F.col(f"`{p}`").cast("double"), F.lit(0.0)) for p in vocabulary]).alias("v"))


def mountain(df: DataFrame, score: str, unique: str) -> DataFrame:
    """``df``, a short list, with ``place``: the largest score in the middle, falling to both sides by turns."""
    w = Window.orderBy(F.desc(score), unique)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = F.row_number().over(w) - 1
    middle = F.floor((n - 1) / 2)
    return df.withColumn("place", (middle + F.when(r % 2 == 1, (r + 1) / 2).otherwise(-r / 2)).cast("int"))
