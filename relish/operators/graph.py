"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.session import drop_staged, stage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(g, v, root)`` for every node: ``root`` is the lowest node of its component.

    ``nodes(g, v)``, ``edges(g, a, b)``; ``g`` separates independent graphs.
    Every node hooks onto its lowest smaller neighbour, the resulting trees are
    flattened by pointer doubling, and the graph shrinks to their roots.  Each
    round at least halves the number of roots that still have edges.
    """
    labels = nodes.select("g", "v", F.col("v").alias("root"))
    rest = stage(
        edges.filter(F.col("a") != F.col("b"))
        .select("g", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct())
    while not rest.isEmpty():
        up = stage(rest.groupBy("g", "u").agg(F.min("w").alias("p")))
        while True:
            up_table = up.select("g", "u", "p")
            over = up.select("g", F.col("u").alias("p"), F.col("p").alias("pp"))
            deeper = stage(up_table.join(over, ["g", "p"], "left").select("g", "u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            done = deeper.filter("moved").isEmpty()
            drop_staged(up)
            up = deeper
            if done:
                break
        top = up.select("g", F.col("u").alias("root"), F.col("p").alias("_up"))
        labels = stage(labels.join(top, ["g", "root"], "left").select("g", "v", F.coalesce("_up", "root").alias("root")))
        tu = up.select("g", "u", F.col("p").alias("pu"))
        tw = up.select("g", F.col("u").alias("w"), F.col("p").alias("pw"))
        moved = rest.join(tu, ["g", "u"]).join(tw, ["g", "w"], "left").select(
            "g", F.col("pu").alias("a"), F.coalesce("pw", "w").alias("b"))
        smaller = stage(
            moved.filter(F.col("a") != F.col("b"))
            .select("g", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct())
        drop_staged(rest, up)
        rest = smaller
    return labels
