"""Assertions as one-row frames: nothing runs until the results are asked for, then all run in one query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Suite:
    """Assertions of a stage: rows (stage, name, passed, value, expected)."""

    def __init__(self, spark: SparkSession, stage: str):
        self.spark, self.stage, self._rows = spark, stage, []

    def _add(self, df: DataFrame, name: str, value: Column, passes, expected: str) -> Suite:  # noqa: ANN001
        row = df.agg(value.cast("double").alias("value"))
        self._rows.append(row.select(F.lit(self.stage).alias("stage"), F.lit(name).alias("name"), F.coalesce(passes(F.col("value")), F.lit(False)).alias("passed"), "value", F.lit(expected).alias("expected")))
        return self

    def equal(self, df: DataFrame, name: str, value: Column, expected: float) -> Suite:
        return self._add(df, name, value, lambda v: v == expected, f"= {expected}")

    def at_least(self, df: DataFrame, name: str, value: Column, low: float) -> Suite:
        return self._add(df, name, value, lambda v: v >= low, f">= {low}")

    def between(self, df: DataFrame, name: str, value: Column, low: float, high: float) -> Suite:
        return self._add(df, name, value, lambda v: v.between(low, high), f"{low}..{high}")

    def no_nulls(self, df: DataFrame, name: str, column: str) -> Suite:
        return self.equal(df, name, F.count_if(F.col(column).isNull()), 0)

    def unique(self, df: DataFrame, name: str, *columns: str) -> Suite:
        """Surplus rows of repeated keys; nulls are equal to each other."""
        groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
        return self.equal(groups, name, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), 0)

    def domain(self, df: DataFrame, name: str, column: str, allowed: list) -> Suite:
        """Values outside, a null among them."""
        return self.equal(df, name, F.count_if(~F.coalesce(F.col(column).isin(allowed), F.lit(False))), 0)

    def no_more_rows(self, after: DataFrame, before: DataFrame, name: str) -> Suite:
        counts = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))  # one row each
        return self.equal(counts, name, F.max(F.greatest(F.col("after") - F.col("before"), F.lit(0))), 0)

    def no_orphans(self, child: DataFrame, parent: DataFrame, name: str, on: list[str]) -> Suite:
        return self.equal(child.dropna(subset=on).join(parent, on, "left_anti"), name, F.count("*"), 0)

    def results(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._rows)

    def write(self, path: str) -> None:
        """Replace this stage's rows in the log, and no other stage's."""
        self.results().write.partitionBy("stage").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def failed(self) -> bool:
        return bool(self.results().where(~F.col("passed")).take(1))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per column of both frames: non-null counts and sums on either side, each frame read once."""
    from pyspark.sql.types import NumericType

    common = [f for f in left.schema if f.name in right.columns]

    def facts(df: DataFrame, side: str) -> DataFrame:
        cells = [F.struct(F.lit(f.name).alias("column"), F.count(f.name).alias("n"), (F.sum(F.col(f.name).cast("decimal(38,6)")) if isinstance(f.dataType, NumericType) else F.lit(None).cast("decimal(38,6)")).alias("total")) for f in common]
        return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.column", F.col("x.n").alias(f"n_{side}"), F.col("x.total").alias(f"total_{side}"))

    both = facts(left, "left").join(facts(right, "right"), "column")
    return both.withColumn("equal", (F.col("n_left") == F.col("n_right")) & F.col("total_left").eqNullSafe(F.col("total_right")))
