"""References to records that do not exist at their time.

A Bloom filter of the parents' keys, sized by their number, is built with native aggregates and reaches the tasks as a
constant of the scan. A reference that it rejects is an orphan for certain and is never shuffled. Only the rest meets the
parents in an exact join, in which the rows of hot keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import hot_keys, salted_join
from weft.session import cut

#: Bits of the Bloom filter per key (rounded up to a power of two), least and most bits as powers of two (8 KB, 128 MB),
#: and probes per key: of a hundred keys that are not there, one passes at most, up to a hundred million parents.
KEY_BITS, LEAST_BITS, MOST_BITS, BLOOM_HASHES = 10, 16, 30, 4


def bloom_bits(n: int) -> int:
    """The size of a filter of ``n`` keys as a power of two. Beyond ``MOST_BITS`` more keys only let more references through
    to the exact join."""
    return min(max((max(n, 1) * KEY_BITS - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _bits(key: Column, log2_bits: int) -> list[Column]:
    h = F.xxhash64(key)
    one, two = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(one + two * i).bitwiseAND(F.lit((1 << log2_bits) - 1)) for i in range(BLOOM_HASHES)]


def bloom_filter(keys: DataFrame, key: str, log2_bits: int) -> Column:
    """The Bloom filter of ``keys[key]`` as a scalar column, an array of ``2**log2_bits / 64`` words (see ``bloom_bits``)."""
    bits = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_bits(F.col(key), log2_bits))).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b"))
    zero = keys.sparkSession.range(0, 1 << (log2_bits - 6), 1, 1).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    dense = words.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words")).scalar()


def may_exist(key: Column, bloom: Column, log2_bits: int) -> Column:
    """False only if ``key`` is surely not among the keys of ``bloom``."""
    hit = F.lit(True)
    for bit in _bits(key, log2_bits):
        word = F.element_at(bloom, (F.shiftright(bit, 6) + 1).cast("int"))
        hit = hit & (F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return hit


def orphan_references(refs: DataFrame, parents: DataFrame, log2_bits: int | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``ref`` has no parent that exists at ``at``.

    ``refs`` has ``row_id, ref, at`` and any further columns, all of which come out; ``parents`` has
    ``ref, first_seen, removed_at``, with any number of periods per key. A parent exists at ``at`` if
    ``first_seen <= at`` and ``removed_at`` is null or later than ``at``; with a null ``at`` or ``first_seen`` it
    does not. Rows whose ``ref`` is null refer to nothing and never come out. Repeated rows each come out. Without
    parents every reference is an orphan. ``log2_bits`` is the size of the filter, by the number of parents unless given.
    """
    # further columns travel as one value, so they may have any name
    own = ["ref", "at", "row_id"]
    rest = [F.col(f"`{c}`") for c in refs.columns if c not in own]
    packed = refs.where(F.col("ref").isNotNull()).select(*own, F.struct(*rest, F.lit(None).cast("boolean").alias("__none")).alias("row"))
    back = [F.col(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in refs.columns]
    parents = cut(parents.where(F.col("ref").isNotNull()).select("ref", "first_seen", "removed_at"))
    log2_bits = log2_bits or bloom_bits(parents.count())
    bloom = bloom_filter(parents, "ref", log2_bits)
    flagged = packed.withColumn("maybe", may_exist(F.col("ref"), bloom, log2_bits))
    definite = flagged.where("not maybe").select(*back)
    alive = (F.col("r.first_seen") <= F.col("l.at")) & (F.col("r.removed_at").isNull() | (F.col("r.removed_at") > F.col("l.at")))
    missing = salted_join(flagged.where("maybe"), parents, ["ref"], "left_anti", hot_keys(packed, F.col("ref")), "ref", F.col("row_id"), alive)
    return definite.unionByName(missing.select(*back))


def orphan_report(refs: DataFrame, orphans: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` and month of ``at``: the number of references and of orphans among them.

    Both inputs have the columns ``by`` and ``at``. A null time falls into the month null.
    """
    month = F.date_trunc("month", F.col("at")).alias("month")
    counted = refs.where(F.col("ref").isNotNull()).select(*by, month, F.lit(0).alias("o")).unionByName(orphans.select(*by, month, F.lit(1).alias("o")))
    return counted.groupBy(*by, "month").agg((F.count(F.lit(1)) - F.sum("o")).alias("n_refs"), F.sum("o").cast("bigint").alias("n_orphans"))
