"""All pairs of sets whose Jaccard similarity reaches a threshold.

Pigeonhole partition: sets of similar length form a group, for which the token universe is cut (by hash) into m
segments. Sets r, s with similarity d or more differ in at most H = (1-d)/(1+d) * (|r|+|s|) tokens. A set grants each
segment a budget: no probe, agreement, or agreement up to one deleted token. These count 0, 1 and 2; if they sum to
H + 1, a partner must meet one of them, as differing beyond every budget would take more than H tokens. Budgets go
where they are cheapest, so empty segments and those of frequent tokens only are left alone. Segments meet in an
equality join of signatures; candidates are verified exactly on their tokens.

Equal sets are joined once, as a class, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import hot_keys, salted_join
from weft.session import cut, spread

#: How much longer the longest set of a length group may be than its shortest.
GROUP_RATIO = 1.15
#: Segments beyond the fewest that can hold the budget; more give more choice but smaller segments.
EXTRA_SEGMENTS = 1
#: Frequent tokens whose share is known when budgets are set, and counters of the sketch that finds them.
FREQUENT, TRACKED, BUCKETS = 512, 8192, 4096
#: Share that other tokens are taken to have at most. Budgets only steer cost; results never depend on these.
RARE = 0.004


def length_groups(longest: int) -> list[tuple[int, int]]:
    """Shortest and longest length of each group up to ``longest``."""
    groups, lo = [], 1
    while lo <= longest:
        hi = max(lo, math.floor(lo * GROUP_RATIO))
        groups.append((lo, hi))
        lo = hi + 1
    return groups


def _difference(a: Column, b: Column, num: int, den: int) -> Column:
    """The most tokens in which sets of lengths ``a`` and ``b`` may differ."""
    return F.floor((a + b) * (den - num) / (den + num) + 1e-9).cast("int")


def _segments(hi: int, num: int, den: int) -> int:
    most = math.floor((den - num) / (den + num) * (hi + math.floor(hi * den / num)) + 1e-9)
    return math.ceil((most + 1) / 2) + EXTRA_SEGMENTS


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _split(items: Column, m: Column, of: Callable[[Column], Column]) -> Column:
    """``items`` by their segment of ``m``; ``of`` gives the token hash of an item."""
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.filter(items, lambda x: F.pmod(F.shiftright(of(x), 7), m) == i))


def _shares(sets: DataFrame) -> Column:
    """The share of sets that hold a frequent token, as a scalar array by a hash of the token."""
    seen = sets.select(F.explode("tokens").alias("t")).agg(F.expr(f"approx_top_k(t, {FREQUENT}, {TRACKED})").alias("top"))
    number = sets.agg(F.count(F.lit(1)).alias("n"))
    known = seen.select(F.explode("top").alias("x")).select(F.pmod(F.xxhash64("x.item"), F.lit(BUCKETS)).alias("b"), F.least(F.col("x.count") / F.greatest(number.scalar(), F.lit(1)), F.lit(1.0)).alias("share"))
    zero = sets.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").alias("b"), F.lit(0.0).alias("share"))
    dense = known.unionByName(zero).groupBy("b").agg(F.max("share").alias("share"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "share"))), lambda x: x["share"]).alias("a")).scalar()


def _key(scope: Column, group: Column, seg: Column, kind: str, signature: Column) -> Column:
    return F.xxhash64(scope, group, seg, F.lit(kind), signature)


def similar_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``scope, a, b, common, total`` of all pairs a < b of one scope with ``common / total >= num / den``.

    ``sets`` has ``scope``, a unique ``id`` per scope and ``tokens``, an array of distinct strings without nulls;
    ids and tokens as they are, no two sets of a scope equal. Empty and null sets are in no pair.
    """
    sets = sets.select("scope", "id", "tokens").where(F.size("tokens") > 0)
    longest = sets.agg(F.coalesce(F.max(F.size("tokens")), F.lit(1)).alias("longest")).first()["longest"]
    groups = length_groups(longest)
    table = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(_segments(hi, num, den)).alias("m")) for i, (lo, hi) in enumerate(groups)])
    weigh = lambda h: F.greatest(F.element_at("shares", (F.pmod(h, F.lit(BUCKETS)) + 1).cast("int")), F.lit(RARE))
    base = sets.select("scope", "id", F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), _shares(sets).alias("shares"))
    base = cut(spread(base.select("scope", "id", "n", "hashes", F.transform("hashes", weigh).alias("p")), "scope", "id"))

    index = base.select("scope", "id", "n", "hashes", F.explode(F.filter(table, lambda g: (g["lo"] <= F.col("n")) & (F.col("n") <= g["hi"]))).alias("grp"))
    index = index.select("scope", "id", "n", "grp.g", F.posexplode(_split(F.col("hashes"), F.col("grp.m"), lambda h: h)).alias("seg", "part")).withColumn("sig", _xor(F.col("part")))
    e = lambda s, kind: _key(F.col("scope"), F.col("g"), F.col("seg"), kind, s)
    stored = F.concat(F.array(e(F.col("sig"), "E")), F.transform("part", lambda h: e(F.col("sig").bitwiseXOR(h), "D")))
    index = index.select("scope", F.col("id").alias("s"), F.col("n").alias("ns"), F.explode(stored).alias("key"))

    # a set looks for partners that are not longer than itself
    probe = base.select("scope", "id", "n", "hashes", "p", F.explode(F.filter(table, lambda g: (g["lo"] <= F.col("n")) & (g["hi"] * den >= F.col("n") * num))).alias("grp"))
    weighed = F.arrays_zip("hashes", "p")
    parts = probe.select("scope", "id", "n", "grp.g", (_difference(F.col("n"), F.least(F.col("n"), F.col("grp.hi")), num, den) + 1).alias("need"), _split(weighed, F.col("grp.m"), lambda x: x["hashes"]).alias("parts"))

    def costs(part: Column, i: Column) -> Column:
        exact = F.aggregate(part, F.lit(1.0), lambda a, x: a * x["p"])
        loose = exact * F.aggregate(part, F.lit(4.0), lambda a, x: a + 1 / x["p"])
        return F.array(F.struct(exact.alias("cost"), F.lit(0).alias("level"), i.alias("seg")), F.struct(loose.alias("cost"), F.lit(1).alias("level"), i.alias("seg")))

    chosen = parts.select("scope", "id", "n", "g", "parts", F.slice(F.array_sort(F.flatten(F.transform("parts", costs))), F.lit(1), F.col("need")).alias("chosen"))
    each = chosen.select("scope", "id", "n", "g", "parts", F.explode("chosen").alias("c")).select("scope", "id", "n", "g", F.col("c.seg").alias("seg"), F.col("c.level").alias("level"), F.transform(F.element_at("parts", F.col("c.seg") + 1), lambda x: x["hashes"]).alias("part")).withColumn("sig", _xor(F.col("part")))
    asked = F.when(F.col("level") == 0, F.array(e(F.col("sig"), "E"))).otherwise(F.concat(F.array(e(F.col("sig"), "D")), F.transform("part", lambda h: e(F.col("sig").bitwiseXOR(h), "E"))))
    probe = each.select("scope", F.col("id").alias("r"), F.col("n").alias("nr"), F.explode(asked).alias("key"))

    met = probe.join(index, ["scope", "key"]).where(((F.col("ns") < F.col("nr")) | ((F.col("ns") == F.col("nr")) & (F.col("s") < F.col("r")))) & (F.col("ns") * den >= F.col("nr") * num))
    pairs = met.groupBy("scope", "r", "s").agg(F.lit(1).alias("__one")).select("scope", "r", "s")
    left = sets.select("scope", F.col("id").alias("r"), F.col("tokens").alias("tr"))
    right = sets.select("scope", F.col("id").alias("s"), F.col("tokens").alias("ts"))
    both = pairs.join(left, ["scope", "r"]).join(right, ["scope", "s"]).select("scope", "r", "s", F.size(F.array_intersect("tr", "ts")).alias("common"), (F.size("tr") + F.size("ts")).alias("sum"))
    both = both.withColumn("total", F.col("sum") - F.col("common")).where(F.col("common") * den >= F.col("total") * num)
    return both.select("scope", F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"), "common", "total")


def classes(records: DataFrame) -> DataFrame:
    """``scope, id, tokens, class_id`` with one class per distinct set; its id is the smallest of its records.

    ``records`` has ``scope, id, tokens``. Records without a scope, an id or tokens are left out; null and repeated
    tokens do not count; of repeated ids the record with the smallest tokens counts. A class with a third of all
    records is salted.
    """
    tokens = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())))
    known = records.where("scope is not null and id is not null").select("scope", "id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    keyed = known.groupBy("scope", "id").agg(F.min("tokens").alias("tokens"))
    keyed = cut(keyed.withColumn("__same", F.sha2(F.concat_ws("\x1f", "scope", F.array_join("tokens", "\x1e")), 256)))
    first = keyed.groupBy("__same").agg(F.min("id").alias("class_id"))
    return salted_join(keyed, first, ["__same"], "inner", hot_keys(keyed, F.col("__same")), "__same", F.col("id")).select("l.scope", "l.id", "l.tokens", "r.class_id")


def similarity_links(records: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The membership ``scope, id, tokens, class_id`` and the links ``scope, a, b, common, total`` between classes."""
    member = cut(classes(records))
    return member, similar_sets(member.where(F.col("id") == F.col("class_id")).select("scope", "id", "tokens"), num, den)


def all_pairs(member: DataFrame, links: DataFrame) -> DataFrame:
    """``scope, a, b`` of all pairs of records, a < b: those of linked classes and those within a class.

    The result has as many rows as there are such pairs; ``class_summary`` is the form without copies.
    """
    one = member.select("scope", F.col("id").alias("x"), F.col("class_id").alias("a"))
    two = member.select("scope", F.col("id").alias("y"), F.col("class_id").alias("b"))
    across = links.select("scope", "a", "b").join(one, ["scope", "a"]).join(two, ["scope", "b"]).select("scope", "x", "y")
    within = one.join(two.withColumnRenamed("b", "a"), ["scope", "a"]).where("x < y").select("scope", "x", "y")
    return across.unionByName(within).select("scope", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def class_summary(member: DataFrame, links: DataFrame) -> DataFrame:
    """``scope, id, class_id, n_copies, n_links``: one row per record with its class and the classes it is linked to."""
    ends = links.select("scope", F.explode(F.array("a", "b")).alias("class_id")).groupBy("scope", "class_id").agg(F.count(F.lit(1)).alias("n_links"))
    size = member.groupBy("scope", "class_id").agg(F.count(F.lit(1)).alias("n_copies"))
    known = size.join(ends, ["scope", "class_id"], "left").select("scope", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    keyed = member.select("scope", "id", "class_id")
    joined = salted_join(keyed, known, ["class_id", "scope"], "inner", hot_keys(keyed, F.col("class_id")), "class_id", F.col("id"))
    return joined.select("l.scope", "l.id", "l.class_id", "r.n_copies", "r.n_links")
