import os
import random

import numpy as np
import pytest

from weft.llm import mixing as mx
from weft.llm.packing import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="the tokenizer is not here")
WORDS = {"a": ["axon", "branch", "trace"], "b": ["table", "count", "ratio"], "c": ["guide", "please", "open"]}


def documents(spark, unlabelled=0.0):
    rnd = random.Random(6)
    rows = []
    for i in range(900):
        s = rnd.choice(["a"] * 6 + ["b"] * 3 + ["c"])
        rows.append((i, " ".join(rnd.choice([*WORDS[s], "the", "of"]) for _ in range(rnd.randint(4, 60))), None if rnd.random() < unlabelled else s, "x"))
    return spark.createDataFrame([*rows, (9001, None, "a", "x"), (9002, "  ", "b", "x"), (None, "axon", "a", "x"), (9003, "axon table", "other", "x")], "doc_id bigint, text string, source string, rate string")


TARGETS = [("m", "a", 0.3, 3), ("m", "b", 0.5, 3), ("m", "c", 0.2, 3), ("n", "a", 0.9, 1), ("n", "nobody", 0.1, 1)]
SCHEMA = "mix_name string, source string, target_share double, max_repeats int"


def test_shares_are_met_within_the_cap(spark):
    targets = spark.createDataFrame(TARGETS, SCHEMA)
    chosen = mx.mix_all(documents(spark), targets).cache()
    report = {(r["mix_name"], r["source"]): r for r in mx.share_report(chosen, targets).collect()}
    for s, share in (("a", 0.3), ("b", 0.5), ("c", 0.2)):
        assert abs(report["m", s]["actual_share"] - share) < 0.01
        assert report["m", s]["most_repeats"] <= 3
    assert report["n", "a"]["actual_share"] == 1.0 and report["n", "nobody"]["actual_share"] == 0.0
    assert chosen.where("doc_id is null or doc_id > 9000").count() == 0
    assert chosen.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0


def test_unlabelled_documents_get_posteriors(spark):
    docs = documents(spark, 0.3)
    targets = spark.createDataFrame(TARGETS[:3], SCHEMA)
    w, good = mx.train_classifier(docs.where("doc_id is not null"), ["a", "b", "c"])
    assert good["accuracy"] > 0.9 > good["largest"] and 0.3 < good["skill"] <= 1
    truth = documents(spark).where("doc_id < 900").select("doc_id", "source").toPandas().set_index("doc_id")["source"]
    sized = docs.where("doc_id < 900 and source is null").selectExpr("doc_id", "source", "1L as n_tokens", "text")
    m = mx.memberships(sized, ["a", "b", "c"], w, good["skill"]).toPandas()
    assert np.allclose([sum(x) for x in m["m"]], 1)
    held_out = np.mean([["a", "b", "c"][int(np.argmax(x))] == truth[i] for i, x in zip(m["doc_id"], m["m"], strict=True)])
    assert held_out > 0.9
    assert mx.mix_all(docs, targets).where("source is null").count() > 0


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, SCHEMA)
    assert mx.mix_all(documents(spark).limit(0), targets).count() == 0
    assert mx.mix_all(documents(spark), targets.limit(0)).count() == 0
