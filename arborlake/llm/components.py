"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected components in MapReduce and beyond" (SoCC 2014).
Every round is joins and grouped minima; no component is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import drop, keep
from .skew import attach


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One step over edges (u, v) with v < u; v becomes nearer to the least node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("m", "u"))
    found = attach(both, least, ["u"], "_n", total)
    if large:
        out = found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either a root or has one link, to a root."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has a link; component is the least node.

    Nodes may be any orderable type. Null ends, loops and repeated links are
    ignored; no link gives no row. Links may point either way.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = keep(e.distinct(), "links")
    for _ in range(rounds):
        if _stars(e):
            break
        total = e.count()
        big = keep(_star(e, 2 * total, True), "links")
        new = keep(_star(big, total, False), "links")
        drop(big)
        drop(e)
        e = new
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
