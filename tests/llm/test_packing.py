import os
import random
from collections import defaultdict

import pytest

from weft.llm import packing as pk

pytestmark = pytest.mark.skipif(not os.path.exists(pk.TOKENIZER), reason="the tokenizer is not here")


def test_patterns_hold_all_items_and_fit():
    rnd = random.Random(4)
    hist = {rnd.randint(1, 200): rnd.randint(1, 500) for _ in range(80)} | {200: 7}
    plan = pk.shortest_pack_first(hist, 200)
    used = defaultdict(int)
    for count, pattern in plan:
        assert count > 0 and sum(n * k for n, k in pattern) <= 200
        for n, k in pattern:
            used[n] += k * count
    assert dict(used) == hist
    assert sum(n * c for n, c in hist.items()) / (200 * sum(c for c, _ in plan)) > 0.95
    assert pk.shortest_pack_first({}, 200) == []


def test_pack_cuts_only_what_is_too_long(spark):
    rnd = random.Random(9)
    size = {i: rnd.choice([0, 1, 5, 5, 5, 40, 99, 100, 101, 350]) for i in range(600)}
    sized = spark.createDataFrame(list(size.items()), "doc_id bigint, n_tokens bigint")
    got = pk.pack(sized, 100, "p").collect()
    by_doc, by_pack = defaultdict(list), defaultdict(int)
    for r in got:
        by_doc[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
        by_pack[r["pack_id"]] += r["n_tokens"]
    for i, n in size.items():
        parts = sorted(by_doc.get(i, []))
        assert sum(k for _, k in parts) == n and len(parts) == -(-n // 100)
        assert [s for s, _ in parts] == [100 * j for j in range(len(parts))]
    assert max(by_pack.values()) <= 100 and sorted(by_pack) == list(range(len(by_pack)))


def test_texts_of_every_kind(spark):
    docs = spark.createDataFrame([(1, "Hello there, world."), (2, None), (3, " \n"), (None, "no id"), (4, "a" * 300000), (5, " " * 300000 + "b"), (6, "<|endoftext|>"), (1, "Hello there, world.")], "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 16), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    packed = pk.pack_all(docs.selectExpr("*", "1 as n_tokens", "2 as rank"), sizes)
    assert {r["doc_id"] for r in packed.collect()} == {1, 4, 5, 6}
    assert packed.where("doc_id = 1").count() == 2
    report = pk.fill_report(packed, sizes).first()
    assert report["most_tokens"] <= 16 and report["fill"] > 0.9
    assert pk.pack_all(docs.limit(0), sizes).count() == 0
    assert pk.pack_all(docs, sizes.limit(0)).count() == 0


def test_token_counts_match_the_library(spark):
    texts = ["It's 3 o'clock – déjà vu?", "x\n\n  y\t<|endoftext|>", "日本語 text"]
    enc = pk._encoding(pk.TOKENIZER)
    got = pk.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r["n_tokens"] for r in got] == [len(enc.encode_ordinary(t)) for t in texts]


def test_long_runs_are_counted_as_the_library_counts_them(monkeypatch):
    import re

    enc, rnd = pk._encoding(pk.TOKENIZER), random.Random(2)
    texts = ["".join(rnd.choice(["a", "Bc", "7", ".", " " * rnd.randint(1, 9), "\n" * rnd.randint(1, 7), " \t\n" * rnd.randint(1, 3)]) for _ in range(40)) for _ in range(200)]
    want = [len(enc.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(pk, "LONG_RUN", re.compile(r"[^\S\x1c-\x1f]{3,}"))
    assert [pk.token_count(enc, t) for t in texts] == want
    monkeypatch.undo()
    assert pk.token_count(enc, "x" + " " * 2000001 + "b") == 2000002
    assert pk.token_count(enc, "a" * 50000) == len(enc.encode_ordinary("a" * 50000))
