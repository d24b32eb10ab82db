"""Freely typed values mapped to the entry of a reference list that they denote.

The similarity join is the pigeonhole partition of edit distance: a reference text is cut into ``k + 1``
segments, of which ``k`` edits leave one whole, so a value within ``k`` edits holds that segment near its place.
Segments meet substrings in an equality join (together with a block key that must agree exactly), the built-in
``levenshtein`` verifies the candidates, and an anti-join leaves the values that denote nothing. Everything is
SQL; work is done once per distinct value.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.labels import is_untyped, strip
from weft.operators.orphans import bloom_bits, bloom_filter, may_exist
from weft.operators.skew import hot_keys, salted_join
from weft.session import cut

#: Edits that a misspelt value may be away from its reference text; two neighbours swapped are two edits.
MAX_EDITS = 2
#: Cyrillic and Greek letters that look like Latin ones, and those.
LOOKALIKE = "аеорсухкмтнвіјѕԁԛոαοριντυκχ"
LOOKS_LIKE = "aeopcyxkmthbijsdqnaopivtukx"
#: Dashes that stand for a hyphen.
DASHES = "‐‑‒–—―−﹣－"
#: Words of doubt, and side words, that do not change what a value denotes.
DOUBT = ["cf", "aff", "putative", "putatively", "possibly", "possible", "probably", "probable", "maybe", "perhaps", "likely", "tbc", "tbd", "prob", "poss", "unsure", "uncertain", "approx", "ex", "formerly", "former", "old", "fka", "aka", "alias"]
SIDES = ["left", "right", "lhs", "rhs", "l", "r", "u", "links", "rechts"]
#: Common misspellings of the word neuron, alone or in compounds.
NEURON = "nueron|neurone|neruon|nuerone|nueorn|neuorn"
#: What the first letter of a type stands for in its full name.
DIRECTIONS = ["anterior", "dorsal", "lateral", "medial", "posterior", "ventral"]


def _fold_table() -> tuple[str, str]:
    """Letters with accents and wide or otherwise styled forms, and the ASCII characters they decompose to."""
    src, dst = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x)]
        if len(base) == 1 and ord(base[0]) < 128 and base[0] not in "()[]":
            src.append(chr(code))
            dst.append(base[0])
    return "".join(src) + LOOKALIKE + LOOKALIKE.upper() + DASHES, "".join(dst) + LOOKS_LIKE + LOOKS_LIKE.upper() + "-" * len(DASHES)


def folded(c: Column) -> Column:
    """``c`` in lower case and ASCII as far as its characters have such a form, without invisible characters."""
    src, dst = _fold_table()
    return F.lower(F.translate(F.regexp_replace(c, r"[\p{M}\p{Cf}]", ""), src, dst))


def parsed(values: DataFrame, value: str) -> DataFrame:
    """``values`` with the columns ``letters``, ``num`` and ``sub`` of what each value names.

    Marks of side and doubt, quotes and trailing remarks in parentheses are taken off. ``num`` is the only number
    of the value without leading zeros, ``sub`` the single letter after it (or ''), ``letters`` all other letters.
    All are null if the value is untyped or has not exactly one number.
    """
    t = F.regexp_replace(folded(strip(F.col(value))), "[\"'`´“”„‘’«»*~?!#=<>]+", " ")
    t = strip(F.regexp_replace(t, r"(?<=[^\s(\[])[\s_]*[(\[][^()\[\]0-9]*[)\]][\s.]*$", " "))
    t = strip(F.regexp_replace(t, rf"(?:^|(?<=[^\p{{L}}\p{{N}}]))(?:{'|'.join(DOUBT)})(?:$|(?=[^\p{{L}}\p{{N}}]))\.?", " "))
    t = F.regexp_replace(t, NEURON, "neuron")
    for word in DIRECTIONS:  # shortened to three letters or more before a full stop
        t = F.regexp_replace(t, rf"(?:^|(?<=[^\p{{L}}])){word[:3]}(?:{'(?:'.join(word[3:-1])}{')?' * (len(word) - 4)}\.", f"{word} ")
    t = F.regexp_replace(t, r"^[\s(\[.,;:_-]++|(?<![\s)\].,;:_-])[\s)\].,;:_-]++$", "")
    t = strip(F.regexp_replace(t, rf"(?<![\s_.,;:(\[-])[\s_.,;:(\[-]++(?:{'|'.join(SIDES)})$", ""))
    t = strip(F.regexp_replace(t, r"(?<=[^\s(\[])[\s_]*[(\[][^()\[\]0-9]*[)\]][\s.]*$", " "))
    # explode and inline of one element keep the optimiser from repeating the long expressions in every filter
    out = values.select("*", F.explode(F.array(F.when(~is_untyped(F.col(value)), t))).alias("__t"))
    one = F.col("__t").rlike(r"^[^0-9]*[0-9]+[^0-9]*$")
    number = r"^([^0-9]*)0*([0-9]+?)(?:[\s_.-]*([a-z])(?![\p{L}])|(?![0-9]))([^0-9]*)$"
    part = lambda i: F.regexp_extract("__t", number, i)
    fields = F.struct(F.when(one, part(2)).alias("num"), F.when(one, part(3)).alias("sub"), F.when(one, F.regexp_replace(F.concat(part(1), part(4)), r"[^\p{L}]", "")).alias("letters"))
    return out.select(*values.columns, F.inline(F.array(fields)))


def reference_forms(types: DataFrame) -> DataFrame:
    """``type_id, letters, num, sub, k``: the texts under which each entry may be written, and the edits allowed.

    ``types`` has ``type_id, type, full_name, former_names``. Besides the type itself these are the full name as
    it stands, with the direction last, without the kind, and with ``neuron`` abbreviated. Former names are codes
    too short for edits. Null names give no form.
    """
    spoken = types.select("type_id", F.explode(F.array(F.col("type"), F.col("full_name"))).alias("v")).where(F.col("v").isNotNull())
    basic = parsed(spoken, "v").where(F.col("letters") != "").select("type_id", "letters", "num", "sub")
    words = F.split(F.regexp_replace(folded(F.col("full_name")), r"[0-9]+[a-z]?", " "), r"\s+")
    full = parsed(types.where(F.col("full_name").isNotNull()), "full_name").select("type_id", "num", "sub", F.filter(words, lambda w: w != "").alias("w")).where(F.size("w") >= 3)
    direction, stem, kind = F.element_at("w", 1), F.element_at("w", 2), F.array_join(F.slice(F.col("w"), F.lit(3), F.size("w") - 2), "")
    short = F.regexp_replace(kind, "neuron$", "n")
    orders = F.array(F.concat(stem, kind, direction), F.concat(stem, direction), F.concat(direction, stem), F.concat(direction, stem, short), F.concat(stem, short, direction))
    turned = full.select("type_id", F.explode(orders).alias("letters"), "num", "sub")
    old = types.select("type_id", F.explode(F.split("former_names", ";")).alias("v"))
    former = parsed(old, "v").where(F.col("letters") != "").select("type_id", "letters", "num", "sub")
    return basic.unionByName(turned).withColumn("k", F.lit(MAX_EDITS)).unionByName(former.withColumn("k", F.lit(0))).dropDuplicates(["type_id", "letters", "num", "sub"])


def _segments(text: Column, k: int) -> Column:
    """The ``k + 1`` segments of a reference text with their number, place and length."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("seg"), F.floor(n * i / (k + 1)).cast("int").alias("at"), (F.floor(n * (i + 1) / (k + 1)) - F.floor(n * i / (k + 1))).cast("int").alias("len")))


def _probes(text: Column, k: int) -> Column:
    """The substrings of a value that may equal a segment of a reference text within ``k`` edits.

    For segment ``i`` of a text longer or shorter by ``d`` characters, edits before it shift it by ``i`` at most and
    those after it by ``k - i`` at most, so only few places are left.
    """
    n = F.length(text)
    lens = F.filter(F.sequence(n - k, n + k), lambda m: m > k)

    def of(m: Column, i: Column) -> Column:
        at, end, d = F.floor(m * i / (k + 1)).cast("int"), F.floor(m * (i + 1) / (k + 1)).cast("int"), n - m
        first, last = F.greatest(at - i, at + d - (k - i), F.lit(0)), F.least(at + i, at + d + (k - i), n - (end - at))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda p: F.struct(m.alias("n"), i.alias("seg"), text.substr(p + 1, end - at).alias("piece"))))

    each = F.transform(lens, lambda m: F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: of(m, i)), lambda x: x.isNotNull())))
    return F.array_distinct(F.flatten(each))


def edit_join(values: DataFrame, refs: DataFrame, block: list[str], text: str, k: int) -> DataFrame:
    """``value, ref, edits`` of all pairs whose ``block`` columns agree and whose texts are within ``k`` edits.

    ``values`` has ``value`` and ``refs`` has ``ref`` besides the columns named. No pair is missed, none comes
    twice. Reference texts of up to ``k`` characters have no ``k + 1`` segments and must agree exactly; texts
    that are null match nothing.
    """
    a = values.select("value", *block, F.col(text).alias("__a")).where(F.col("__a").isNotNull())
    b = refs.select("ref", *block, F.col(text).alias("__b")).where(F.col("__b").isNotNull())
    index = b.where(F.length("__b") > k).select("ref", *block, "__b", F.length("__b").alias("n"), F.explode(_segments(F.col("__b"), k)).alias("s"))
    index = index.select("ref", *block, "__b", "n", F.col("s.seg").alias("seg"), F.substring("__b", F.col("s.at") + 1, F.col("s.len")).alias("piece"))
    probes = a.select("value", *block, "__a", F.explode(_probes(F.col("__a"), k)).alias("s")).select("value", *block, "__a", "s.n", "s.seg", "s.piece")
    near = probes.join(index, [*block, "n", "seg", "piece"]).select("value", "ref", F.levenshtein("__a", "__b", k).alias("edits"), "__a", "__b").where(F.col("edits") >= 0)
    same = a.join(b.where(F.length("__b") <= k), [*block]).where(F.col("__a") == F.col("__b")).select("value", "ref", F.lit(0).alias("edits"), "__a", "__b")
    swapped = (F.col("edits") == 2) & (F.length("__a") == F.length("__b")) & (F.array_sort(F.split("__a", "")) == F.array_sort(F.split("__b", "")))
    both = near.unionByName(same).withColumn("edits", F.when(swapped, 1).otherwise(F.col("edits")))
    return both.groupBy("value", "ref").agg(F.min("edits").alias("edits"))


def match_values(values: DataFrame, types: DataFrame) -> DataFrame:
    """``value, type_id`` for each distinct value; -1 if it denotes no entry, or two equally well.

    ``values`` has one column ``value`` without nulls.
    """
    known = parsed(values, "value")
    forms = reference_forms(types).withColumnRenamed("type_id", "ref")
    named = known.where(F.col("letters") != "")
    pairs = edit_join(named, forms.where(F.col("k") == MAX_EDITS), ["num", "sub"], "letters", MAX_EDITS)
    codes = named.join(forms.where(F.col("k") == 0).select("ref", "num", "sub", "letters"), ["num", "sub", "letters"]).select("value", "ref", F.lit(0).alias("edits"))
    found = pairs.unionByName(codes).groupBy("value", "edits").agg(F.min("ref").alias("type_id"), F.max("ref").alias("__other"))
    best = found.groupBy("value").agg(F.min_by(F.struct("type_id", "__other"), "edits").alias("b")).where(F.col("b.type_id") == F.col("b.__other")).select("value", F.col("b.type_id").alias("type_id"))
    unmatched = values.join(best, "value", "left_anti").select("value", F.lit(-1).cast("bigint").alias("type_id"))
    return best.unionByName(unmatched)


def map_rows(rows: DataFrame, types: DataFrame) -> DataFrame:
    """``field, row_id, value, type_id`` for each row whose ``value`` is neither null nor blank nor exactly a type.

    ``rows`` has ``field, row_id, value``, of which only these columns are read; ``types`` may be empty, then nothing is
    denoted, and its rows without an id are left out. Repeated rows each come out. Rows that are exactly a type are dropped by
    the Bloom filter of the other values before anything is shuffled; rows of hot values are salted.
    """
    rows = rows.select("field", "row_id", "value").where(strip(F.col("value")) != "")
    types = types.where("type_id is not null")
    exact = types.select(F.col("type").alias("value"))
    distinct = cut(rows.groupBy("value").agg(F.lit(1).alias("__one")).select("value").join(exact, "value", "left_anti"))
    mapped, bits = cut(match_values(distinct, types)), bloom_bits(distinct.count())
    asked = rows.where(may_exist(F.col("value"), bloom_filter(distinct, "value", bits), bits))
    return salted_join(asked, mapped, ["value"], "inner", hot_keys(asked, F.col("value")), "value", F.col("row_id")).select("l.field", "l.row_id", "l.value", "r.type_id")


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """``field, value, n_rows`` of the values that denote nothing."""
    return mapped.where(F.col("type_id") == -1).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))
