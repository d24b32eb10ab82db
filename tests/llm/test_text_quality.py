from weft.llm import text_quality as tq

COMMON = ["the", "of", "is", "and", "was", "to", "a", "in", "it", "for", "that", "as", "be", "not", "we"]
PROSE = "It was not clear to us that the branch is a part of the cell, as the stain was poor in it. We had to look for it in the second block, and that was a lot of work."
TEXTS = {
    1: PROSE, 2: PROSE.lower().replace(".", "\n"), 3: "\n".join(f"- item {i}x: done" for i in range(12)), 4: "\r\n".join(f"{i}. item{i}" for i in range(1, 12)), 5: "name\tcount\tratio\n" + "\n".join(f"cell{i}\t{i}\t0.{i}" for i in range(10)),
    6: "\n".join(f"cell{i},{i},NA,0.{i}" for i in range(10)), 7: "again " * 80, 8: "#!?=" * 50, 9: PROSE + "\n- one\n- two", 10: "[01:02:03] INFO w=1 rc=0 mem=3\n" * 3 + "[01:02:04] INFO w=1 rc=0 mem=4", 11: None, 12: " \n\t ", 13: "a-" * 60000, 14: "word " * 60000, 15: ", " * 60000, 16: "",
}
WANT = {1: "prose", 2: "prose", 3: "list", 4: "list", 5: "table", 6: "table", 7: "junk", 8: "junk", 9: "prose", 10: "junk", 14: "junk"}


def test_kinds(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()] + [(1, PROSE, "x"), (None, PROSE, "x")], "doc_id bigint, text string, n_words string")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    out = tq.classify(docs, common)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(TEXTS) - {11, 12, 16}
    assert {i: got[i]["kind"] for i in WANT} == WANT
    assert out.where("doc_id = 1").count() == 1
    assert all(abs(sum(r[f"p_{k}"] for k in tq.KINDS) - 1) < 1e-6 for r in got.values())
    assert {r["doc_id"] for r in tq.not_prose(out).collect()} >= {3, 4, 5, 6, 7, 8, 10}


def test_statistics_by_hand(spark):
    docs = spark.createDataFrame([(1, "The cell is dark.\nIt ends\nhere!")], "doc_id bigint, text string")
    common = spark.createDataFrame([("en", "the"), ("en", "is"), ("en", "it")], "lang string, word string")
    r = tq.text_statistics(docs, common).first()
    assert (r["n_words"], r["n_lines"], r["n_chars"]) == (7, 3, 31)
    assert abs(r["stop_line_share"] - 2 / 3) < 1e-9 and abs(r["common_share"] - 3 / 7) < 1e-9
    assert abs(r["symbol_ratio"] - 2 / 25) < 1e-9 and abs(r["mean_word_length"] - 23 / 7) < 1e-9


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    common = spark.createDataFrame([], "lang string, word string")
    assert tq.classify(docs, common).count() == 0
    assert tq.classify(spark.createDataFrame([(1, "some text here")], "doc_id bigint, text string"), common).count() == 1


def test_statistics_against_brute_force():
    import re

    import numpy as np

    common = tq.word_hashes(["the", "été", "is"])
    texts = ["The Été is dark.\nIt ends; the end!\n\n- 1,2 | x_9\n", "ÀÉ  §§ a·b", "x" * 70000, ". . .", "a1 b2\tc3\n" * 9, "Same here. Same here. Other?"]
    got = tq._statistics(texts, common)
    for t, row in zip(texts, got, strict=True):
        r = dict(zip(tq.STATISTICS, row, strict=True))
        words = re.findall(r"[^\W_]+(?:_[^\W_]+)*_?", t.lower())
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        parts = [p.strip().lower() for p in re.split(r"[.!?\n]", t) if p.strip()]
        solid = [c for c in t if not c.isspace()]
        assert (r["n_chars"], r["n_words"], r["n_lines"]) == (len(t), len(words), len(lines))
        assert np.isclose(r["distinct_word_share"], len(set(words)) / max(len(words), 1))
        assert np.isclose(r["common_share"] * max(sum(any(c.isalpha() for c in w) for w in words), 1), sum(w in ("the", "été", "is") for w in words))
        assert np.isclose(r["digit_ratio"], sum(c.isdigit() for c in solid) / len(solid))
        assert np.isclose(r["symbol_ratio"], sum(not c.isalnum() for c in solid) / len(solid))
        assert np.isclose(r["stop_line_share"], sum(x[-1] in ".!?:;\"')" for x in lines) / len(lines))
        seen, again = set(), 0
        for p in parts:
            again += sum(not c.isspace() for c in p) * (p in seen)
            seen.add(p)
        assert np.isclose(r["repeated_part_share"], again / len(solid))
