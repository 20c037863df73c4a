"""Connected components by alternating stars, in DataFrame functions, and nothing on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish import session


def components(edges: DataFrame, most_rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, root) for edges (a, b): the least node that each node of an edge reaches, roots themselves left out.

    A round lets every node pass the least neighbour to its larger ones, then to its smaller ones and itself; rounds
    grow with the logarithm of the longest path.  Least neighbours come from partial aggregates and are joined
    back, so a node of very many edges is one hot key of an equi-join.  Each round is written; edges don't grow in
    number but for one more a node.  most: a bound of their number, where it is known."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = session.written(e, "edges", most)
    before, most = None, e.count()
    for _ in range(most_rounds):
        last = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = session.written(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct(), "edges", 2 * most)
        session.discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first())
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components not found in {most_rounds} rounds")
