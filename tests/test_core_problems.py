"""Labels, hot keys, orphan references and top N on small cases."""

import random
import statistics
from datetime import datetime

from pyspark.sql import functions as F

from weft.functions import labels
from weft.operators.hot_keys import skewed_key_stats
from weft.operators.orphans import bloom_filter, may_exist, orphan_references, orphan_report
from weft.operators.skew import running_sums
from weft.operators.topn import strongest_partners, top_n


def test_untyped_and_bare(spark):
    cases = {None: True, "": True, "  ": True, "Unknown": True, "NaN_L": True, "(None)_R": True, "((null))": True, "<NA>": True, "12345": True, "hb123": True, "HB9_U": True, "Nok1": False, "(Nok1)_L": False, "(Nok1": False, "Unknown x": False, "hb": False, " none\t": True, "x" * 5000: False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "v string, want boolean").withColumn("got", labels.is_untyped(F.col("v")))
    assert df.where("got <> want").count() == 0
    bare = spark.createDataFrame([("(Nok1)_L",), (" Nok2_R ",), ("((Nok3)_U)",), ("(a)(b",)], "v string").select(labels.bare_label(F.col("v"))).collect()
    assert [r[0] for r in bare] == ["Nok1", "Nok2", "Nok3", "(a)(b"]


def test_canonical_id(spark):
    cases = {"17": "17", " 17\t": "17", "0017": "17", "17.0": "17", "17.5": "17.5", "123456789": "720575940123456789", "000123456789.00": "720575940123456789", "000": "0", "": None, "  ": None, None: None, "abc": "abc"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", labels.canonical_id(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in got} == cases


def test_cell_names(spark):
    got = spark.createDataFrame([("A1_L, (B2) ,A1,NULL,,77",), (None,)], "v string").select(labels.cell_names(F.col("v"))).collect()
    assert [r[0] for r in got] == [["A1", "B2"], []]


def test_hot_keys_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice(["p1", "p2", "p3", None]), rnd.choice([None, 0, 1, 2, 5000, 5001, -7]), "clash") for _ in range(800)] + [("lonely", None, None, "x")]
    df = spark.createDataFrame(rows, "k string, p string, w bigint, key string")
    got = {(r["side"], r["key"]): r for r in skewed_key_stats(df, {"one": (F.col("k"), F.col("p"))}, F.col("w")).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        w = [r[2] for r in own if r[2] is not None]
        g = got["one", k]
        assert (g["n_rows"], g["total"], g["n_partners"]) == (len(own), sum(w) if w else None, len({r[1] for r in own if r[1]}))
        assert g["median"] == (statistics.median(w) if w else None)
    assert skewed_key_stats(df.limit(0), {"one": (F.col("k"), F.col("p"))}, F.col("w")).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = bloom_filter(keys, "k", 14)
    assert keys.where(~may_exist(F.col("k"), bloom, 14)).count() == 0
    other = spark.range(3000).select(F.concat(F.lit("x"), "id").alias("k"))
    assert other.where(may_exist(F.col("k"), bloom, 14)).count() < 1500


def test_orphans(spark):
    t = lambda d: datetime(2024, 1, d)
    refs = spark.createDataFrame([(1, "a", t(5), "x"), (2, "a", t(1), "x"), (3, "a", t(20), "x"), (4, "b", t(5), "x"), (5, None, t(5), "x"), (6, "c", None, "x"), (7, "c", t(9), "x"), (1, "a", t(1), "x")], "row_id bigint, ref string, at timestamp, first_seen string")
    parents = spark.createDataFrame([("a", t(2), t(10)), ("c", t(1), None), (None, t(1), None), ("d", None, None)], "ref string, first_seen timestamp, removed_at timestamp")
    got = orphan_references(refs, parents)
    assert got.columns == refs.columns
    assert sorted(r["row_id"] for r in got.collect()) == [1, 2, 3, 4, 6]
    assert orphan_references(refs, parents.limit(0)).count() == 7
    assert orphan_references(refs.limit(0), parents).count() == 0
    report = orphan_report(refs, got, ["first_seen"]).collect()
    assert sum(r["n_refs"] for r in report) == 7 and sum(r["n_orphans"] for r in report) == 5


def test_hot_reference_is_salted_and_whole(spark):
    refs = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("ref"), F.lit(datetime(2024, 1, 5)).alias("at"))
    parents = spark.createDataFrame([("hot", datetime(2024, 1, 1), None), ("k1", datetime(2024, 1, 1), None)], "ref string, first_seen timestamp, removed_at timestamp")
    want = refs.where("ref not in ('hot', 'k1')").count()
    assert orphan_references(refs, parents).count() == want


def test_strongest_partners(spark):
    rows = [("1", "9", 5, "r", 1), ("1", "9", 5, "r", 1), ("1", "9", 5, "s", 1), ("2", "9", 10, "r", 1), ("10", "9", 10, "r", 1), ("3", "9", 1, "r", 1), ("4", "9", 0, "r", 1), (None, "9", 7, "r", 1), ("5", "8", None, "r", 1)]
    e = spark.createDataFrame(rows, "pre string, post string, weight bigint, roi string, cached_date int").withColumn("strength", F.lit("clash"))
    got = [(r["partner"], r["strength"]) for r in strongest_partners(e).where("side = 'post' and bodyId = '9'").orderBy("rank").collect()]
    assert got == [("1", 10), ("2", 10), ("10", 10)]
    assert strongest_partners(e).where("bodyId = '8'").count() == 0
    assert strongest_partners(e.limit(0)).count() == 0


def test_top_n_plans_a_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    out = top_n(df, ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6


def test_running_sums(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("c"))
    got = running_sums(df, "k", ["c"])
    assert got.where("upto_c <> k + 1").count() == 0
    assert running_sums(df, "k", ["c"], descending=True).where("upto_c <> 500 - k").count() == 0
