"""Connected components of a link table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node long, component long)``, one row for each node of an edge.

    Each round points every node at the neighbour (or itself) of the least hash and contracts the edges
    to those targets; hashes change with the round, so the expected number of nodes that are left shrinks
    by a constant factor on any graph, chains included. All state stays in distributed tables; the driver
    sees one emptiness test a round. ``component`` is the smallest node id of the component.
    """
    spark = edges.sparkSession
    pairs = edges.where("u <> v and u is not null and v is not null")
    live = checkpoint(pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    steps = []
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023,E731
        target = live.groupBy("u").agg(F.least(F.min(rank("v")), F.first(rank("u"))).getField("id").alias("to"))
        target = checkpoint(target)
        steps.append(target)
        a = live.join(target.select("u", F.col("to").alias("a")), "u").select("v", "a")
        b = a.join(target.select(F.col("u").alias("v"), F.col("to").alias("b")), "v").where("a <> b")
        live = checkpoint(b.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    else:
        raise RuntimeError("the links did not contract; raise max_rounds")
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    roots = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for later in steps[1:]:
        hop = later.select(F.col("u").alias("root"), F.col("to").alias("next"))
        roots = roots.join(hop, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
