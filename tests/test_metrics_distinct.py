"""Metrics of different values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import metrics
from ledgerloom.plans.metrics import Metric, rows_that


def test_metrics_count_different_values_apart(spark):
    """No measure is held for each value: the wide aggregate has no key but the cuts."""
    df = spark.range(1_000).select((F.col("id") % 90).alias("customer"), F.when(F.col("id") % 4 == 0, F.lit("a")).alias("kind"), F.col("id").alias("v"))
    plain = [Metric("n", "t", F.count("*")), Metric("of", "t", rows_that(F.col("v") < 100), "n", "kind"), Metric("sum", "t", F.sum("v"))]
    one = plain + [Metric("customers", "t", F.countDistinct("customer")), Metric("first", "t", F.countDistinct(F.when(F.col("v") < 30, F.col("customer"))), "customers")]
    two = plain + [Metric("customers", "t", F.col("customer"), distinct=True), Metric("first", "t", F.when(F.col("v") < 30, F.col("customer")), "customers", distinct=True)]
    rows = lambda m, df=df: sorted(map(tuple, metrics.measure({"t": df}, m).collect()))
    assert rows(two) == rows(one)
    assert rows(two, df.limit(0)) == rows(one, df.limit(0))
    with pytest.raises(ValueError, match="in total only"):
        metrics.measure({"t": df}, [Metric("x", "t", F.col("v"), by="kind", distinct=True)])
