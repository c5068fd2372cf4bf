"""Exact quantiles of groups of any size, by selection in rounds of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, saved

#: A group with at most this many values is sorted in one row; larger ones are counted in this many buckets a round.
SMALL, BUCKETS = 1024, 1024
#: Groups that are sent to every executor at most.
SENT = 50_000


def group_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A row a group: its keys and for each name in points the quantile at that share (percentile_cont: between two values
    in proportion). Null and NaN values do not count; a group without others has nulls. Null keys are a group.

    Groups of up to SMALL values are sorted in a row. For larger ones, each wanted rank is narrowed down in rounds: the values between its bounds
    are counted by bucket, partially before the shuffle, and the bucket with the rank gives the next bounds. The first round's buckets are
    sign and power of two, later ones equal parts of the rest; least and greatest always part, so it ends, after some seven rounds.
    No task or driver holds a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("_v"))
    good = F.col("_v").isNotNull() & ~F.isnan("_v")
    rows = saved(rows.withColumn("_v", F.when(good, F.col("_v") + F.lit(0.0))), "values")
    sizes = saved(rows.groupBy(*keys).agg(F.count("_v").alias("_n")), "sizes")
    large = sizes.where(F.col("_n") > SMALL)
    n_large = large.count()
    tight = rows
    if n_large:
        on = _same("a", "b", keys)
        sent = F.broadcast(large) if n_large <= SENT else large
        tight = rows.alias("a").join(sent.alias("b"), on, "left_anti")
    small = tight.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_all"), F.count("_v").alias("_n"))
    shares = {name: p * (F.col("_n") - 1) for name, p in points.items()}
    at = lambda k: F.get("_all", k.cast("int"))
    out = small.select(*keys, *(_between(at(F.floor(s)), at(F.ceil(s)), s).alias(n) for n, s in shares.items()))
    if n_large:
        ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(s), F.ceil(s)) for s in shares.values()))))
        found = _select(rows, large, ranks, keys, n_large)
        pick = lambda k: F.max(F.when(F.col("_rank") == k, F.col("_v")))
        wide = found.groupBy(*keys).agg(F.first("_n").alias("_n"), *(x for i, s in enumerate(shares.values()) for x in (pick(F.floor(s)).alias(f"_a{i}"), pick(F.ceil(s)).alias(f"_b{i}"))))
        out = out.unionByName(wide.select(*keys, *(_between(F.col(f"_a{i}"), F.col(f"_b{i}"), s).alias(n) for i, (n, s) in enumerate(shares.items()))))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *points)


def _between(low, high, share):  # noqa: ANN001, ANN202
    return F.when(low == high, low).otherwise((F.ceil(share) - share) * low + (share - F.floor(share)) * high)


def _same(a: str, b: str, keys: list[str]):  # noqa: ANN202
    test = F.lit(True)
    for k in keys:
        test &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return test


def _select(rows: DataFrame, large: DataFrame, ranks, keys: list[str], n_large: int) -> DataFrame:  # noqa: ANN001
    """(keys, _n, _rank from 0, _v) of the large groups."""
    done: list[DataFrame] = []
    # _skip values lie below the bounds; there are none in the first round
    open_ = large.withColumn("_rank", F.explode(ranks)).withColumns({"_skip": F.lit(0).cast("long"), "_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
    open_ = saved(open_, "ranks")
    power = F.when(F.col("_v") == 0, 0).otherwise(F.signum("_v") * (F.floor(F.log2(F.least(F.abs("_v"), F.lit(1.7976931348623157e308)))) + 1100))
    part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
    part = F.when(F.col("_v") == F.col("_lo"), -1).when(F.col("_v") == F.col("_hi"), BUCKETS).otherwise(part)
    infinite = (F.col("_v") == float("inf")) | (F.col("_v") == float("-inf"))
    while True:
        wanted = F.broadcast(open_) if n_large <= SENT else open_
        near = rows.where("_v IS NOT NULL").alias("a").join(wanted.alias("b"), _same("a", "b", keys) & (F.col("_lo").isNull() | F.col("_v").between(F.col("_lo"), F.col("_hi"))))
        bucket = F.when(F.col("_lo").isNull(), F.when(infinite, F.signum("_v") * 5000).otherwise(power)).otherwise(part).cast("long")
        kept = [*(F.col(f"b.{k}").alias(k) for k in keys), "_n", "_rank", "_skip", bucket.alias("_bucket"), "_v"]
        counts = near.select(*kept).groupBy(*keys, "_n", "_rank", "_skip", "_bucket").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(W.partitionBy(*keys, "_rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_skip")
        chosen = counts.withColumn("_before", before).where("_rank >= _before AND _rank < _before + _c")
        after = saved(chosen.select(*keys, "_n", "_rank", F.col("_before").alias("_skip"), "_lo", "_hi"), "ranks")
        discard(open_)
        done.append(after.where("_lo = _hi").select(*keys, "_n", "_rank", F.col("_lo").alias("_v")))
        open_ = after.where("_lo < _hi")
        if not open_.take(1):
            break
        open_ = saved(open_, "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
