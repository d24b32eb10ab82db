"""Skeletons as node tables ``body, node_id, parent_id, x, y, z, radius``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cables(nodes: DataFrame) -> DataFrame:
    """``body, node_id, length``: each node's distance to its parent; roots have none."""
    p = nodes.select("body", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    d2 = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz"), F.lit(0.0))
    return nodes.join(p, ["body", "parent_id"]).select("body", "node_id", F.sqrt(d2).alias("length"))


def morphometrics(nodes: DataFrame) -> DataFrame:
    """Per body: nodes, cable length, branch points, tips, roots and extent."""
    children = nodes.where("parent_id >= 0").groupBy("body", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("c"))
    per = nodes.join(children, ["body", "node_id"], "left").groupBy("body").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("c") >= 2).alias("n_branches"), F.count_if(F.col("c").isNull()).alias("n_tips"), F.count_if(F.col("parent_id") < 0).alias("n_roots"), F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("extent"))
    length = cables(nodes).groupBy("body").agg(F.round(F.sum("length"), 6).alias("cable"))
    return per.join(length, "body", "left").na.fill(0.0, ["cable"])


def extrusions(nodes: DataFrame, factor: float) -> DataFrame:
    """``body, node_id, length``: edges longer than ``factor`` times the median of their body."""
    e = cables(nodes)
    med = e.groupBy("body").agg(F.median("length").alias("m"))
    return e.join(med, "body").where(F.col("length") > factor * F.col("m")).select("body", "node_id", "length")


def cable_by_region(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """``body, roi, length``: cable in each box (``roi`` and the low and high corner ``x0..z1``), by the edge's end.

    Ends in no box count as ``outside``; in several, the first by name. Boxes are few and broadcast.
    """
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1"))
    placed = nodes.join(boxes, inside, "left").groupBy("body", "node_id").agg(F.min("roi").alias("roi"))
    return cables(nodes).join(placed, ["body", "node_id"]).groupBy("body", F.coalesce("roi", F.lit("outside")).alias("roi")).agg(F.round(F.sum("length"), 6).alias("length"))
