"""Different values are counted exactly, in tasks that grow with the rows."""

from pyspark.sql import functions as F

from ledgerloom.operators import distinct, profile


def test_counts_are_those_of_one_aggregate(spark, monkeypatch):
    """Nulls count for nothing, both zeros are one value and so are NaNs; a frequent value is one."""
    monkeypatch.setattr(distinct, "TASK_VALUES", 500)
    df = spark.range(3_000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("s"),
        F.expr("CASE id % 5 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D WHEN 2 THEN double('NaN') WHEN 3 THEN id / 2 END").alias("d"), F.timestamp_seconds(F.col("id") % 11).alias("t"), F.lit(None).cast("int").alias("none"),
    )
    columns = {c: F.col(c) for c in df.columns}
    want = df.agg(*(F.countDistinct(c).alias(n) for n, c in columns.items())).first().asDict()
    found = {r.name: r.n_distinct for r in distinct.distinct_counts(df, columns).collect()}
    assert found == {n: x for n, x in want.items() if x}
    assert {r.column: r.n_distinct for r in profile.profile(df).collect()} == want


def test_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    """A profile's values do not meet in the tasks of a small file; shuffles of a given number are not joined again."""
    monkeypatch.setattr(distinct, "TASK_VALUES", 1_000)
    plan = profile.profile(spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("two")))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count(", 20), REPARTITION_BY_NUM") == 2
