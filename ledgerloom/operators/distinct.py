"""Exact numbers of different values in tasks of bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a task holds, about; more are dealt to more tasks.
TASK_VALUES = 250_000
#: Parts in which the rows of one value are thinned before they meet.
SALTS = 32


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, n_distinct): different values of each column but null; a column without any has no row.

    Tasks grow with the rows, which compressed files and shuffles do not show by their bytes; so the number of partitions is
    given. Rows of one value are thinned in parts first, and no task gets all rows of a frequent one. df is read twice.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * len(values) // TASK_VALUES))
    kinds = dict(df.select(*(c.alias(f"v{i}") for i, c in enumerate(values.values()))).dtypes)
    own = lambda i: [(c if i == j else F.lit(None)).cast(kinds[f"v{j}"]).alias(f"v{j}") for j, c in enumerate(values.values())]
    cells = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("name"), *own(i))) for i, (n, c) in enumerate(values.items())))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    long = df.select(salt, F.explode(cells).alias("x")).where("x IS NOT NULL").select("salt", "x.*")
    keys = ["name", *kinds]
    thin = long.repartition(parts, *keys, "salt").distinct().select(*keys)
    return thin.repartition(parts, *keys).distinct().groupBy("name").agg(F.count("*").alias("n_distinct"))
