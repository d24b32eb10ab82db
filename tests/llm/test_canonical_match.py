import random

from weft.llm import canonical_match as cm

TYPES = [(1, "mDemmamlur24", "medial Demmamlur interneuron 24", "TV4460"), (2, "mDemmamlur24a", "medial Demmamlur interneuron 24a", None), (3, "lNokfupi19", "lateral Nokfupi cell 19", "JW5281;AB1234"), (4, "pLamvolka2a", "posterior Lamvolka neuron 2a", None), (5, "dTokupet16", None, None)]
SCHEMA = "type_id bigint, type string, full_name string, former_names string"
CASES = {
    "MDEMMAMLUR24": 1, "mdemmamlur 024": 1, "mDemmamlur24_L": 1, "mDemmamlur24 (left)": 1, "cf. mDemmamlur24": 1, "mDemmamlur24 ??": 1, "(mDemmamlur24)": 1, "mDemmmalur24": 1, "mDmmamlur24": 1, "mDemmamlur-24A": 2, "mDemmamlur25": -1, "mDemmamlur24b": -1, "mDemmamlur240": -1,
    "TV 4460": 1, "tv-4460": 1, "ex TV4460": 1, "TV4460 (old name)": 1, "TV4461": -1, "TW4460": -1, "AB1234": 3, "Nokfupi cell 19 lateral": 3, "Nokfupi 19, lateral": 3, "lateral_Nokfupi_cell_19": 3, "lNоkfupi19": 3, "lNokfupi１９": 3, "lNökfupi19​": 3, "post. Lamvolka nueron 2a": 4, "posterior Lamvolka n. 2a": 4,
    "dTоkuрet16": 5, "lNokfupi19 / mDemmamlur24": -1, "12345": -1, "hb123": -1, "see notes": -1, "Unknown_R": -1, "lNokfupi19" + "x" * 5000: -1, "": None, "   ": None, "lNokfupi19": None, None: None,
}


def test_values_of_every_kind(spark):
    rows = [("f", i, v, "clash") for i, v in enumerate(CASES)] + [("f", 1000, "MDEMMAMLUR24", "clash")] * 2
    got = cm.map_rows(spark.createDataFrame(rows, "field string, row_id bigint, value string, letters string"), spark.createDataFrame(TYPES, SCHEMA)).collect()
    by_value = {r["value"]: r["type_id"] for r in got}
    assert by_value == {k: v for k, v in CASES.items() if v is not None}
    assert sum(r["row_id"] == 1000 for r in got) == 2
    report = cm.unmatched_report(cm.map_rows(spark.createDataFrame(rows, "field string, row_id bigint, value string, letters string"), spark.createDataFrame(TYPES, SCHEMA)))
    assert report.count() == sum(v == -1 for v in CASES.values())


def test_empty_tables(spark):
    rows, types = spark.createDataFrame([("f", 1, "abc1")], "field string, row_id bigint, value string"), spark.createDataFrame(TYPES, SCHEMA)
    assert cm.map_rows(rows.limit(0), types).count() == 0
    assert [r["type_id"] for r in cm.map_rows(rows, types.limit(0)).collect()] == [-1]


def _edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def test_edit_join_misses_no_pair(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
    a, b = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    left = spark.createDataFrame([(x, 0, x) for x in a] + [("null", 0, None)], "value string, g int, t string")
    right = spark.createDataFrame([(y, 0, y) for y in b], "ref string, g int, t string")
    got = {(r["value"], r["ref"]) for r in cm.edit_join(left, right, ["g"], "t", 2).collect()}
    assert got == {(x, y) for x in a for y in b if (_edits(x, y) <= 2 if len(y) > 2 else x == y)}


def test_values_of_any_length(spark):
    long = "x" * 3000 + "7"
    rows = spark.createDataFrame([("f", 1, long), ("f", 2, "(" * 40 + long.replace("xx7", "yx7") + ")" * 40), ("f", 3, " " * 50000 + long + "?"), ("f", 4, "z" * 100000), ("f", 5, "((" * 30000)], "field string, row_id bigint, value string")
    types = spark.createDataFrame([(5, long.upper(), None, None)], "type_id bigint, type string, full_name string, former_names string")
    assert {r["row_id"]: r["type_id"] for r in cm.map_rows(rows, types).collect()} == {1: 5, 2: 5, 3: 5, 4: -1, 5: -1}
