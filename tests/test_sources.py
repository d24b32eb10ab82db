"""Readers, writers and the stream of edges."""

import pytest
from pyspark.sql import functions as F

from weft.sources import formats
from weft.streaming import edges as stream


def test_drifting_files(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3)], "pre_root_id bigint, post_root_id bigint, syn_count int").write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.csv").write_text("bodyId_pre,bodyId_post,weight,roi,Unnamed: 0\n720575940000000001,5,4,X,0\n")
    got = formats.read_edges(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "2", 3, None), ("720575940000000001", "5", 4, "X")]
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        formats.read_edges(spark, [str(tmp_path / "c.csv")])


def test_exact_ids_and_chains(spark):
    df = spark.createDataFrame([("7.20575940E+17",), ("123456789",), ("x",)], "v string").select(formats.exact_id(F.col("v")))
    assert [r[0] for r in df.collect()] == ["720575940000000000", "720575940123456789", None]
    n = spark.createDataFrame([("1", None, "c"), ("2", " ", None)], "bodyId string, cell_type string, cell_class string")
    assert [r[0] for r in n.select(formats.type_chain(n, ["cell_type", "cell_class"])).collect()] == ["c", "Unknown"]
    extra = spark.createDataFrame([("1", "s"), ("1", "t")], "bodyId string, side string")
    assert formats.enriched_nodes(n, [extra], ["cell_type", "cell_class"]).where("bodyId = '1'").first()["side"] == "s"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, None]), (2, "b", [])], "id int, k string, v array<double>")
    formats.write_table(df, str(tmp_path / "t"), ["k"], ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).where("k = 'a'").count() == 1
    for layer in (0, 1):
        formats.append_layer(df.drop("v"), str(tmp_path / "s"), layer)
    assert spark.read.parquet(str(tmp_path / "s")).where("layer = 1").count() == 2
    formats.write_csv(df, str(tmp_path / "c"))
    assert {r["v"] for r in formats.read_any(spark, str(tmp_path / "c" / "*.csv")).collect()} == {"[1.0, ]", "[]"}


def test_label_lists(spark):
    df = spark.createDataFrame([("L", "d", "source", "type", "A; B;;A")], "label string, dataset string, role string, member_kind string, members string")
    assert sorted(r["member"] for r in formats.label_members(df).collect()) == ["A", "B"]


def test_stream_adds_up(spark, tmp_path):
    rows = [(i, "1", str(i % 3), i % 4 + 1, "X", f"2024-01-0{i % 5 + 1} 00:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, bodyId_pre string, bodyId_post string, weight bigint, roi string, t string").withColumn("ingested_at", F.to_timestamp("t")).drop("t")
    df.where("row_id < 20").write.parquet(str(tmp_path / "in" / "a"))
    df.where("row_id >= 15").write.parquet(str(tmp_path / "in" / "b"))
    s = stream.arrivals(spark, str(tmp_path / "in" / "*"), df.schema)
    stream.maintain_pairs(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("bodyId_pre", "bodyId_post").agg(F.sum("weight").alias("w"))
    want = df.groupBy("bodyId_pre", "bodyId_post").agg(F.sum("weight").alias("w"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
