"""Runs compared by trees of hash sums over ranges of their key: what differs is found by going down.

A leaf is a range of 2^LEAF keys with its rows and the sum of their hashes; a node of the level above has 2^FAN leaves. A tree is
a table of a few bytes for each 2^LEAF keys, made with one scan when a run is written and kept beside it. Two
runs are compared by their trees from the top, and only the rows of leaves that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .profile import row_hash

#: Bits of a leaf, bits of a node's children, and leaves that are pushed down to the scan as ranges at most.
LEAF, FAN, PUSHED = 12, 13, 200
LEVELS = (64 - LEAF + FAN - 1) // FAN


def _place(df: DataFrame, key: str) -> Column:
    """Whole numbers and dates keep their order, so that a range is a range of files; other keys are hashed."""
    kind = dict(df.dtypes)[key]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.col(key).cast("long")
    return F.unix_date(key).cast("long") if kind == "date" else F.xxhash64(key)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)]
    return df.select(F.coalesce(_place(df, key), F.lit(0)).alias("_place"), F.col(key).alias("_key"), row_hash(columns).alias("_hash"))


def tree(df: DataFrame, key: str) -> DataFrame:
    """(level, node, n, hash_sum) of all levels, 0 the leaves; each level is added up from the one below. Null keys lie at place 0, repeated rows count."""
    up = [F.col("n"), F.col("hash_sum")]
    leaf = _hashed(df, key).groupBy(F.shiftright("_place", LEAF).alias("node")).agg(F.count("*").alias("n"), F.sum("_hash").cast("decimal(38,0)").alias("hash_sum"))
    leaf = saved(leaf, "leaves")
    out = leaf.select(F.lit(0).alias("level"), "node", *up)
    # all levels in one pass over the leaves, not over the rows
    steps = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("node", FAN * k).alias("node")) for k in range(1, LEVELS + 1)))
    above = leaf.select(F.explode(steps).alias("x"), *up).groupBy("x.level", "x.node").agg(F.sum("n").alias("n"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"))
    return out.unionByName(above)


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node) of leaves that differ between two trees. A level looks at the children of the nodes that differ above; equal subtrees are left."""
    path = None
    for level in range(LEVELS, -1, -1):
        a, b = (t.where(F.col("level") == level).select("node", F.struct("n", "hash_sum").alias(s)) for t, s in ((before, "a"), (after, "b")))
        if path is not None:
            a, b = (x.join(path, F.shiftright("node", FAN) == path["parent"], "left_semi") for x in (a, b))
        unlike = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if level == 0:
            return unlike
        path = saved(unlike.select(F.col("node").alias("parent")), "differing")
    raise AssertionError


def differences(before: DataFrame, after: DataFrame, key: str, before_tree: DataFrame | None = None, after_tree: DataFrame | None = None) -> DataFrame:
    """(key, state, n_before, n_after) of the keys whose rows differ: "added", "gone" or "changed".

    Trees that were kept spare the runs a scan each. Of each run only rows in leaves that differ are read; up to PUSHED leaves become
    ranges of the key that the scan can skip files by, more are a join. Rows are compared as multisets of hashes.
    """
    leaves = saved(differing_leaves(before_tree if before_tree is not None else tree(before, key), after_tree if after_tree is not None else tree(after, key)), "leaves")
    few = [r.node for r in leaves.limit(PUSHED + 1).collect()]

    def rows(df: DataFrame, side: str) -> DataFrame:
        place = _place(df, key)
        if len(few) > PUSHED:
            near = _hashed(df, key).withColumn("node", F.shiftright("_place", LEAF)).join(leaves, "node", "left_semi")
        else:
            inside = F.lit(False)
            for node in few:
                lo, hi = node << LEAF, (node + 1 << LEAF) - 1
                inside |= place.between(lo, hi) | (F.lit(lo <= 0 <= hi) & F.col(key).isNull())
            near = _hashed(df.where(inside), key)
        return near.groupBy("_key").agg(F.count("*").alias(f"n_{side}"), F.sum("_hash").alias(f"h_{side}"))

    a, b = rows(before, "before").alias("a"), rows(after, "after").alias("b")
    both = a.join(b, F.col("a._key").eqNullSafe(F.col("b._key")), "full").where(~F.col("h_before").eqNullSafe(F.col("h_after")) | ~F.col("n_before").eqNullSafe(F.col("n_after")))
    state = F.when(F.col("n_before").isNull(), "added").when(F.col("n_after").isNull(), "gone").otherwise("changed")
    return both.select(F.coalesce("a._key", "b._key").alias(key), state.alias("state"), *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("before", "after")))
