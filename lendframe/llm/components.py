"""Connected components of an edge table by repeated contraction.

In each round every node joins the neighbour with the smallest keyed hash, chains of
such choices are shortened by pointer jumps, and the graph is rebuilt between the
roots. Hash order makes the chains short whatever the ids are. Each table is stored
before it is joined, so hot roots are split by adaptive execution, and nothing but
an emptiness test reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendframe.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs, any direction, repeats and loops allowed).

    ``root`` is one node of the component, the same for all of it.
    """
    e = stored(_tidy(edges), "edges")
    labels = e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    step = 0
    while not e.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        p = e.groupBy("a").agg(F.min(order("b")).alias("m"))
        p = stored(p.select("a", F.least(order("a"), F.col("m"))["x"].alias("p")), "parents")
        for _ in range(2):
            q = p.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            p = stored(p.join(q, "p").select("a", F.col("pp").alias("p")), "parents")
        labels = labels.join(p.select(F.col("a").alias("root"), F.col("p").alias("up")), "root", "left").select(
            "node", F.coalesce("up", "root").alias("root"))
        labels = stored(labels, "labels")
        left, right = p.toDF("a", "pa"), p.toDF("b", "pb")
        e = stored(_tidy(e.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))),
                   "edges")
        step += 1
    return labels


def _tidy(edges: DataFrame) -> DataFrame:
    """Both directions, each once, without loops."""
    e = edges.select("a", "b").filter("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
