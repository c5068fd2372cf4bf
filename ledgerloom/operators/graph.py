"""Connected components of an identity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), longs: rows (node, component), the component's smallest node.

    Alternating large-star and small-star rounds until nothing changes: each round replaces each node's
    links by links to the smallest neighbour. Both are one min per node and a join, so a node with very many
    links is pre-aggregated and split like any skewed join. Rounds grow with the logarithm of the longest path;
    each is written to the scratch folder. Null ends and self links count for nothing; repeated ones count once.
    """
    now = saved(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "edges",
    )
    before = None
    while True:
        # large-star: each node links its larger neighbours to the smallest node it sees
        both = now.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = both.groupBy("n").agg(F.least(F.col("n"), F.min("w")).alias("m"))
        large = both.join(least, "n").where("w > n AND w <> m").select(F.col("w").alias("v"), F.col("m").alias("u")).distinct()
        # small-star: each node links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        after = saved(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
