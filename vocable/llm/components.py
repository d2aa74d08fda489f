"""Connected components of an edge table by alternating large-star and small-star.

Every step is an aggregation to the smallest neighbour and a join back; a hub
with a third of all edges is pre-aggregated per task and its join is one that
adaptive execution splits.  Each round's edges are written to the shared folder;
the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.store import written


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of ``u`` are hung on the smallest of ``u`` and its neighbours."""
    both = _symmetric(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of ``u``, and ``u``, are hung on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): every node that has an edge, and the smallest node it can reach.

    Node ids are numbers; loops and repeated edges are allowed; an empty edge
    table gives no rows.
    """
    e = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "cc")
    state = _state(e)
    while state[0]:
        e = written(_small_star(_large_star(e)), "cc")
        now = _state(e)
        if now == state:
            break
        state = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
