"""The filter language and the resolution of names to nodes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.labels import is_untyped

#: Columns that a search looks at first, in this order.
PRIORITY = ["bodyId", "type", "instance"]


def _pattern(p: str) -> str:
    """``p`` as a pattern; an invalid one counts as literal text."""
    try:
        re.compile(p)
    except re.error:
        return re.escape(p)
    return p


def matches(c: Column, operator: str, values: list[str]) -> Column:
    """One operator on one column, true if any value (for the negative ones: no value) matches; never for null."""
    c = c.cast("string")
    tests = {
        "exact": lambda v: c == v, "contains": lambda v: c.contains(v), "startswith": lambda v: c.startswith(v), "endswith": lambda v: c.endswith(v), "regex": lambda v: c.rlike(_pattern(v)),
        "not_contains": lambda v: ~c.contains(v), "not_regex": lambda v: ~c.rlike(_pattern(v)),
    }
    join = (lambda a, b: a & b) if operator.startswith("not_") else (lambda a, b: a | b)
    return c.isNotNull() & reduce(join, [tests[operator](str(v)) for v in values])


def structured(df: DataFrame, spec: dict[str, list], columns: list[str]) -> Column:
    """The condition of a filter: all operators must hold, each on any of ``columns`` (negative ones on all).

    Integers under ``exact`` are ids and only meet ``bodyId``.
    """
    out = F.lit(True)
    for operator, values in spec.items():
        tests = []
        for c in columns:
            own = [v for v in values if not (operator == "exact" and isinstance(v, int) and c != "bodyId")]
            if own:
                tests.append(matches(F.col(c), operator, own))
        join = (lambda a, b: a & b) if operator.startswith("not_") else (lambda a, b: a | b)
        out = out & (reduce(join, tests) if tests else F.lit(False))
    return out


def resolve_tokens(nodes: DataFrame, tokens: DataFrame, columns: list[str]) -> DataFrame:
    """``token, bodyId, hit``: the nodes of each token in the first of ``columns`` that knows it; status in ``hit``.

    A token that no column knows has a row with null ``bodyId`` and hit ``none``.
    """
    values = nodes.select("bodyId", F.inline(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(c).alias("hit"), F.col(c).cast("string").alias("token")) for i, c in enumerate(columns)])))
    met = tokens.select("token").distinct().join(values, "token", "left")
    first = met.withColumn("__first", F.min("priority").over(Window.partitionBy("token"))).where(F.col("priority").eqNullSafe(F.col("__first")))
    return first.select("token", "bodyId", F.coalesce("hit", F.lit("none")).alias("hit")).distinct()


def staged_search(nodes: DataFrame, text: str, columns: list[str], limit: int) -> DataFrame:
    """``bodyId, stage, value`` of the best stage with a hit: prefix of the first column, of any other, substring.

    Digits only search ids. Without case; of a node the first stage counts; at most ``limit`` rows in order.
    """
    low = text.lower()
    columns = ["bodyId"] if text.isdigit() else columns
    low_of = lambda c: F.lower(F.col(c).cast("string"))
    stages = [(0, columns[0], low_of(columns[0]).startswith(low)), *[(1, c, low_of(c).startswith(low)) for c in columns[1:]], *[(2, c, low_of(c).contains(low)) for c in columns]]
    hit = F.coalesce(*[F.when(test, F.struct(F.lit(s).alias("stage"), F.col(c).cast("string").alias("value"))) for s, c, test in stages])
    found = nodes.select("bodyId", hit.alias("hit")).where("hit is not null").select("bodyId", "hit.stage", "hit.value")
    best = found.agg(F.min("stage").alias("m"))
    return found.where(F.col("stage") == best.scalar()).orderBy("stage", "value", "bodyId").limit(limit)


def search_index(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``column, priority, value, folded, rows``: each value of the searchable columns and the rows that hold it."""
    cells = nodes.select("row_id", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("priority"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]))).where("trim(value) <> ''")
    return cells.groupBy("column", "priority", "value").agg(F.array_sort(F.collect_set("row_id")).alias("rows")).withColumn("folded", F.lower("value"))


def admit_edges(edges: DataFrame, types: DataFrame, drop_untyped: bool = True, exclude_intra: bool = True, hemisphere: str | None = None) -> DataFrame:
    """``edges`` with ``type_pre, type_post``, without untyped ends, within a type, or of the other hemisphere.

    With a ``hemisphere`` (L, R) both ends must be of it or have none; ``types`` then has a column ``side``.
    """
    side = F.coalesce(F.col("side"), F.lit("U")) if "side" in types.columns else F.lit("U")
    t = types.select("bodyId", "type", side.alias("side"))
    out = edges.join(t.select(F.col("bodyId").alias("pre"), F.col("type").alias("type_pre"), F.col("side").alias("side_pre")), "pre", "left").join(t.select(F.col("bodyId").alias("post"), F.col("type").alias("type_post"), F.col("side").alias("side_post")), "post", "left")
    if drop_untyped:
        out = out.where(~is_untyped(F.col("type_pre")) & ~is_untyped(F.col("type_post")))
    if exclude_intra:
        out = out.where(~F.col("type_pre").eqNullSafe(F.col("type_post")) | F.col("type_pre").isNull())
    if hemisphere:
        out = out.where(F.coalesce("side_pre", F.lit("U")).isin(hemisphere, "U") & F.coalesce("side_post", F.lit("U")).isin(hemisphere, "U"))
    return out.select("pre", "post", "weight", "type_pre", "type_post")


def exclude_pairs(edges: DataFrame, spec: str) -> DataFrame:
    """``edges`` without the pairs of a list like ``A->B, C->D``."""
    wanted = [tuple(x.strip() for x in part.split("->", 1)) for part in spec.split(",") if "->" in part]
    if not wanted:
        return edges
    return edges.join(edges.sparkSession.createDataFrame(wanted, "pre string, post string"), ["pre", "post"], "left_anti")


def filter_matrix(edges: DataFrame, axis: str, low: float, high: float, by: str) -> DataFrame:
    """The edges of rows or columns whose largest weight (``by='max'``) or partner count is in (low, high]."""
    key = "pre" if axis == "row" else "post"
    measure = F.max("weight") if by == "max" else F.count_if(F.col("weight") > 0)
    kept = edges.groupBy(key).agg(measure.alias("m")).where((F.col("m") > low) & (F.col("m") <= high)).select(key)
    return edges.join(kept, key, "left_semi")
