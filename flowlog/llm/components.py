"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """``u, v, m``: the edges and the least neighbour of each ``u``; they are shuffled once."""
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def _pair(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's least neighbour."""
    both = edges.select(F.inline(F.array(_pair("u", "v"), _pair("v", "u"))))
    return (
        _min_neighbour(both)
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    moved = _min_neighbour(edges).select(F.inline(F.array(_pair("u", "m"), _pair("v", "m"))))
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (two columns of one orderable type) but the roots themselves.

    The root is the least node of the component. Rounds grow with the logarithm of the longest path; each one is
    checkpointed. A node's neighbours are sorted into one window, which spills, never gathered in a row. Loops and repeated
    edges are harmless.
    """
    a, b = edges.columns
    state = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = _mark(state)
    while mark[0]:
        following = materialize(_small_star(_large_star(state)))
        new_mark = _mark(following)
        if new_mark == mark:
            break
        state, mark = following, new_mark
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free hash of the edges."""
    row = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
    return row[0], row[1]
