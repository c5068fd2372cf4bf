"""Profiles that are kept for each part of a table (a day, a load) and merged later, so that old rows are not read again.

Of each column a part keeps counts, ends, a sum, a sketch of its distinct values (HyperLogLog) and one of its
quantiles (KLL), some kilobytes whatever the rows. Merged sketches are as good as sketches of all rows at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct sketch (a standard error of 0.8 %) and size of the quantile sketch (ranks within 0.7 % or so).
BITS, SIZE = 14, 400


def profile_parts(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    """(part, column, n_rows, n_null, least, greatest, total, distinct, ranks) of number columns, one scan; a null part is a part. NaN counts as null."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in columns))
    long = df.select(part.alias("part"), F.explode(cells).alias("x")).select("part", "x.column", "x.v")
    return long.groupBy("part", "column").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum("v").alias("total"),
        F.hll_sketch_agg(F.col("v").cast("string"), F.lit(BITS)).alias("distinct"), F.kll_sketch_agg_double("v", F.lit(SIZE)).alias("ranks"),
    )


def store(parts: DataFrame, path: str) -> None:
    """Keeps the parts below path; a part that is there already is replaced, others stay."""
    parts.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def merge(parts: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """(column, n_rows, n_null, least, greatest, mean, n_distinct, and each quantile) of all parts together, from their rows alone."""
    whole = parts.groupBy("column").agg(
        *(F.sum(c).alias(c) for c in ("n_rows", "n_null", "total")), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_union_agg("distinct").alias("_distinct"), F.kll_merge_agg_double("ranks").alias("_ranks")
    )
    some = F.col("n_rows") > F.col("n_null")  # the sketch of nothing has no quantiles
    values = [F.when(some, F.kll_sketch_get_quantile_double("_ranks", F.lit(float(p)))).alias(n) for n, p in quantiles.items()]
    return whole.select("column", "n_rows", "n_null", "least", "greatest", F.try_divide("total", F.col("n_rows") - F.col("n_null")).alias("mean"), F.hll_sketch_estimate("_distinct").alias("n_distinct"), *values)
