"""Connected components by alternating stars: links stay on the executors, each round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

MAX_ROUNDS = 60


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node of its component.

    Large and small stars in turn (Kiveris et al., 2014): each node's neighbours are hung on its smallest one
    until every component is one star. Minima are combined before each shuffle.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not last[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.expr("array(struct(b as a, m as b), struct(a as a, m as b))")).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = stash(small, "links")
        drop_stash(edges)
        edges, before = nxt, last
        last = _mark(edges)
        if last == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
