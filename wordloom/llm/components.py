"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the smallest of them; a is the larger end."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))


def _sign(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node that is not a root.

    edges: a, b (long ids, either order; repeats and loops are harmless). Each round's table is cut
    into the shared folder; rounds end when a round changes nothing (about log2 of the longest path).
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _sign(now)
    while sign[0]:
        now = cut(_small(_large(now).where("a <> b").distinct()).where("a <> b").distinct())
        if (new := _sign(now)) == sign:
            break
        sign = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
