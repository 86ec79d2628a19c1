"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.operators.skew import hot_join
from seqlens.session import drop_shared, shared_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round halves path lengths, so rounds grow with the logarithm of the
    longest chain. Minima are taken with map-side partial aggregation, never by
    gathering a neighbourhood; a hub's rows stay spread, for hubs are joined by broadcast.
    Self loops keep isolated nodes. Null nodes are ignored. Each round's tables are dropped
    once the next round's are written.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tree = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    tree = shared_table(tree, "cc")
    seen = None
    for _ in range(max_rounds):
        both = tree.select("u", "v").unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        low = shared_table(low, "cclow")
        large = hot_join(both, low, ["u"], "n", 2 * tree.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared_table(large.where("u <> v").distinct(), "cclarge")
        mins = shared_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "ccmins")
        small = hot_join(large, mins, ["u"], "n", large.count()).select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.explode(F.array("x", "u")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        last, tree = tree, shared_table(small, "cc")
        drop_shared(last, low, large, mins)
        state = tree.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = tree.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
