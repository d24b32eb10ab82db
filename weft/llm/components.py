"""Pairwise matches consolidated into groups.

The graph is reduced, the rest is solved, and labels go back to what was taken off:

* *Reduction.* Each round takes off vertices of degree one and splices out vertices of degree two. Of neighbours
  that could both go, a random priority picks one, so a chain shrinks by an independent set per round. That is list
  ranking by independent sets: a chain or cycle of n vertices is gone after O(log n) rounds, a star after one.
* *Core.* What remains has vertices of degree three or more only. Each round permutes the vertices at random, every vertex
  points to its first neighbour if that comes before itself, pointers are followed to their roots, and the edges are
  contracted. A vertex comes before a given neighbour in half of the permutations, so half of the vertices remain at most.
* *Restoring.* Every vertex that was taken off points to a neighbour that outlived it; following the pointers by
  doubling gives it the label of that neighbour.

Vertices are long numbers, so that aggregates stay in hash tables. Every step groups by vertex with a mergeable
aggregate or by edge, so a vertex with a third of all edges gathers nowhere. Each round is cut with a checkpoint in the
shared folder.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import hot_keys, salted_join
from weft.session import cut


def _edge(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("lo <> hi").groupBy("lo", "hi").agg(F.lit(1).alias("__one")).select("lo", "hi")


def _neighbours(edges: DataFrame) -> DataFrame:
    """``v, d, a, b``: degree, smallest and largest neighbour of each vertex."""
    half = edges.select(F.inline(F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("n")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("n")))))
    return half.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("a"), F.max("n").alias("b"))


def _splice(edges: DataFrame, round_no: int) -> DataFrame:
    """``v, a, b`` of an independent set of vertices with at most two neighbours."""
    low = _neighbours(edges).where("d <= 2").select("v", "a", "b")
    ends = low.select("v", F.explode(F.array_distinct(F.array("a", "b"))).alias("n"))
    both = ends.select("v", *_edge(F.col("v"), F.col("n"))).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("c")).where("c = 2")
    rank = lambda v: F.struct(F.xxhash64(F.lit(round_no), F.col(v)), F.col(v))
    beaten = both.select(F.when(rank("lo") < rank("hi"), F.col("lo")).otherwise(F.col("hi")).alias("v"))
    return low.join(beaten, "v", "left_anti")


def _follow(pointers: DataFrame) -> DataFrame:
    """``v, root`` for ``v, to``: the end of each chain of pointers, by doubling. Pointers must not form cycles."""
    at = pointers.select("v", F.col("to").alias("root"))
    while True:
        step = at.select(F.col("v").alias("root"), F.col("root").alias("next"))
        moved = cut(salted_join(at, step, ["root"], "left", hot_keys(at, F.col("root")), "root", F.col("v")).select("l.v", F.coalesce("r.next", "l.root").alias("root"), F.col("r.next").isNotNull().alias("moved")))
        at = moved.select("v", "root")
        if moved.where("moved").isEmpty():
            return at


def _core(edges: DataFrame) -> DataFrame:
    """``v, to``: pointers of all vertices of ``edges`` but the roots of their components."""
    pointers, dice = None, random.Random(7)
    while not edges.isEmpty():
        # an exclusive or with a mask permutes the numbers; pointers go down in the permuted order, so there are no cycles
        mask = F.lit(dice.getrandbits(62)).cast("bigint")
        permuted = edges.select(F.col("lo").bitwiseXOR(mask).alias("lo"), F.col("hi").bitwiseXOR(mask).alias("hi"))
        hooks = cut(_neighbours(permuted).where("a < v").select(F.col("v").bitwiseXOR(mask).alias("v"), F.col("a").bitwiseXOR(mask).alias("to")))
        roots = _follow(hooks)
        pointers = hooks if pointers is None else pointers.unionByName(hooks)
        for end in ("lo", "hi"):
            step = roots.withColumnRenamed("v", end)
            edges = salted_join(edges, step, [end], "left", hot_keys(edges, F.col(end)), end, F.xxhash64("lo", "hi")).select(F.coalesce("r.root", f"l.{end}").alias(end), "l." + ("hi" if end == "lo" else "lo"))
        edges = cut(_distinct(edges.select(*_edge(F.col("lo"), F.col("hi")))))
    return pointers


def component_roots(pairs: DataFrame) -> DataFrame:
    """``v, root`` for each vertex of ``pairs``: equal roots exactly for vertices that are linked.

    ``pairs`` has two columns of ids of one type; long numbers are taken as they are, others are numbered first. Nulls and
    pairs of equal ids link nothing, and a vertex that is only paired with itself or null has no row. Repeated pairs count once. An empty table gives none. The root is some vertex
    of the component. All vertices of degree one and two go before the core is solved.
    """
    a, b = pairs.columns[:2]
    linked = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    if dict(linked.dtypes)["x"] != "bigint":
        linked = cut(linked.where("x <> y"))
        ids = _numbered(linked.select(F.explode(F.array("x", "y")).alias("id")), "id", "v", 0)
        for end in ("x", "y"):
            step = ids.select(F.col("id").alias(end), F.col("v").alias(f"{end}_"))
            other = [c for c in linked.columns if c != end]
            linked = salted_join(linked, step, [end], "inner", hot_keys(linked, F.col(end)), end, F.xxhash64(*linked.columns)).select(f"r.{end}_", *[f"l.{c}" for c in other])
        roots = component_roots(linked.select("x_", "y_"))
        named = ids.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
        back = roots.join(ids, "v")
        return salted_join(back, named, ["root"], "inner", hot_keys(back, F.col("root")), "root", F.col("v")).select(F.col("l.id").alias("v"), F.col("r.root_id").alias("root"))
    edges = cut(_distinct(linked.select(*_edge(F.col("x"), F.col("y")))))
    vertices, pointers, round_no = edges, None, 0
    while not edges.isEmpty():
        gone = cut(_splice(edges, round_no))
        if gone.isEmpty():
            core = _core(edges)
            pointers = core if pointers is None else pointers.unionByName(core)
            break
        dead = gone.select(F.explode(F.array_distinct(F.array(F.struct(*_edge(F.col("v"), F.col("a"))), F.struct(*_edge(F.col("v"), F.col("b")))))).alias("e")).select("e.lo", "e.hi")
        kept = edges.join(dead, ["lo", "hi"], "left_anti").unionByName(gone.select(*_edge(F.col("a"), F.col("b"))))
        edges = cut(_distinct(kept))
        hooks = gone.select("v", F.col("a").alias("to"))
        pointers = hooks if pointers is None else pointers.unionByName(hooks)
        round_no += 1
    if pointers is None:
        return vertices.select(F.col("lo").alias("v"), F.col("hi").alias("root"))
    roots = _follow(cut(pointers))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").groupBy("v", "root").agg(F.lit(1).alias("__one")).select("v", "root"))


def _numbered(values: DataFrame, column: str, number: str, odd: int) -> DataFrame:
    """The distinct ``column`` of ``values`` with a ``number`` of its own, even or odd."""
    distinct = values.groupBy(column).agg(F.lit(1).alias("__one")).select(column)
    return cut(distinct.withColumn(number, F.monotonically_increasing_id() * 2 + odd))


def groups_by_shared_names(names: DataFrame) -> DataFrame:
    """``id, group_id`` of the ids whose group has two members or more; ``group_id`` is its numerically smallest id.

    ``names`` has ``id`` (a string) and ``name``. Ids match if they share a name; a name is itself a vertex, so a
    name of n ids gives n edges, not n squared pairs. Null ids and names match nothing.
    """
    known = names.select(F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name")).where("id is not null and name is not null")
    known = cut(known.groupBy("id", "name").agg(F.lit(1).alias("__one")).select("id", "name"))
    ids, names = _numbered(known, "id", "x", 0), _numbered(known, "name", "y", 1)
    sides = salted_join(known, names, ["name"], "inner", hot_keys(known, F.col("name")), "name", F.col("id")).select("l.id", "r.y").join(ids, "id").select("x", "y")
    labelled = component_roots(sides).where(F.col("v") % 2 == 0)
    labelled = labelled.join(ids.withColumnRenamed("x", "v"), "v").select("id", "root")
    first = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("id").alias("len"), F.col("id").alias("id"))).alias("m")).where("n >= 2").select("root", F.col("m.id").alias("group_id"))
    return salted_join(labelled, first, ["root"], "inner", hot_keys(labelled, F.col("root")), "root", F.col("id")).select("l.id", "r.group_id")
