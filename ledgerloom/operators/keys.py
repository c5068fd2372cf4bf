"""Dense surrogate keys without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import saved


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before, in the given order (make it total)."""
    return running_sums(df, order, {value: name})


def running_sums(df: DataFrame, order: list[Column], names: dict[str, str]) -> DataFrame:
    """df with the sums of columns over all rows before, in the given order (make it total): names gives each its name.
    Ranges of the order are summed side by side and shifted by the sums of those before; one small row a range meets in
    one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_sum_{v}") for v in names))
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sums.select("_range", *(F.coalesce(F.sum(f"_sum_{v}").over(upto), F.lit(0)).alias(f"_shift_{v}") for v in names))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = {f"_own_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in names}
    found = {name: (F.col(f"_shift_{v}") + F.col(f"_own_{v}")).cast("long") for v, name in names.items()}
    return ranged.withColumns(own).join(F.broadcast(shifts), "_range").withColumns(found).drop("_range", *own, *(f"_shift_{v}" for v in names))


def dense_keys(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1..n in the given order (make it total). Ranges of the order are numbered side by side and shifted
    by the sizes of the ranges before; one small row a range meets in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range is one task's and in order, so its rows are numbered as they come and are not dealt a second time
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranged = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return ranged.join(F.broadcast(shifts), "_range").withColumn(name, (F.col("_shift") + F.col("_place")).cast("long")).drop("_range", "_place", "_shift")
