"""Metrics declared as specifications and computed with one scan a table.

A specification names a metric, the table it is about and what it measures. All of a table are one aggregate: plain ones in
the total, those by a column in a grouping set of it, so that sixty metrics of six tables are six scans. Different values are counted apart:
beside them in one aggregate, all measures would be held for each value. Shares of another metric are worked out on the rows of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.distinct import distinct_counts
from ..storage import saved


@dataclass(frozen=True)
class Metric:
    """key, table, an aggregate; base: the key of which it is a share; by: a column, of which each value gives a row key.value.

    A null value of `by` is named "none". With `distinct`, measure is a column whose different values are counted, in total.
    """

    key: str
    table: str
    measure: Column
    base: str | None = None
    by: str | None = None
    distinct: bool = False


def rows_that(test: Column) -> Column:
    """Rows that pass a test; null counts as no."""
    return F.count_if(F.coalesce(test, F.lit(False)))


def _of_table(df: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(key, value, base) of one table's metrics, by one aggregate over one scan; a table whose different values are counted is written once."""
    if any(m.distinct for m in metrics):
        df = saved(df, "measured")
        apart, metrics = [m for m in metrics if m.distinct], [m for m in metrics if not m.distinct]
        found = distinct_counts(df, {m.key: m.measure for m in apart})
        named = df.sparkSession.createDataFrame([(m.key, m.base) for m in apart], "name string, base string")
        counted = named.join(found, "name", "left").select(F.col("name").alias("key"), F.coalesce("n_distinct", F.lit(0)).cast("double").alias("value"), "base")
        return counted.unionByName(_of_table(df, metrics)) if metrics else counted
    if any(m.by for m in metrics) and not df.take(1):  # grouping sets have no total of no rows
        metrics = [m for m in metrics if not m.by]
    cuts = list(dict.fromkeys(m.by for m in metrics if m.by))
    measures = {f"m{i}": m.measure.cast("double") for i, m in enumerate(metrics)}
    if cuts:
        # a column may be measured and grouped by, so the grouping works on copies
        copies = {c: f"_by{i}" for i, c in enumerate(cuts)}
        named = df.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c, n in copies.items()})
        columns = [F.col(n) for n in copies.values()]
        sets = [[], *([c] for c in columns)]
        wide = named.groupingSets(sets, *columns).agg(*(a.alias(n) for n, a in measures.items()), *(F.grouping(c).alias(f"{n}_out") for c, n in zip(columns, copies.values(), strict=True)))
        inside = {c: F.col(f"{n}_out") == 0 for c, n in copies.items()}
        total = reduce(lambda a, b: a & ~b, inside.values(), F.lit(True))
        cells = [(F.concat(F.lit(f"{m.key}."), F.col(copies[m.by])), inside[m.by]) if m.by else (F.lit(m.key), total) for m in metrics]
    else:
        wide = df.agg(*(a.alias(n) for n, a in measures.items()))
        cells = [(F.lit(m.key), F.lit(True)) for m in metrics]
    rows = F.array(*(F.when(here, F.struct(key.alias("key"), F.col(f"m{i}").alias("value"), F.lit(m.base).alias("base"))) for i, (m, (key, here)) in enumerate(zip(metrics, cells, strict=True))))
    return wide.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("x.*")


def measure(tables: dict[str, DataFrame], metrics: list[Metric]) -> DataFrame:
    """(key, value, percent): one row a metric, or a metric and value of its column; percent of its base, null without one or of 0.

    Each table is evaluated once. Keys must be unique and bases must be keys of plain metrics.
    """
    keys = [m.key for m in metrics]
    plain = {m.key for m in metrics if not m.by}
    if len(set(keys)) < len(keys):
        raise ValueError("a key is given twice")
    if both := [m.key for m in metrics if m.distinct and m.by]:
        raise ValueError(f"different values are counted in total only: {', '.join(both)}")
    if unknown := {m.base for m in metrics if m.base} - plain:
        raise ValueError(f"bases that are no metrics: {', '.join(sorted(unknown))}")
    parts = [_of_table(df, own) for name, df in tables.items() if (own := [m for m in metrics if m.table == name])]
    if missing := {m.table for m in metrics} - set(tables):
        raise ValueError(f"tables that are not there: {', '.join(sorted(missing))}")
    rows = saved(reduce(DataFrame.unionByName, parts), "metrics")
    totals = rows.select(F.col("key").alias("base"), F.col("value").alias("_total"))
    return rows.join(totals, "base", "left").select("key", "value", F.when(F.col("base").isNotNull(), F.try_divide(100 * F.col("value"), F.col("_total"))).alias("percent"))
