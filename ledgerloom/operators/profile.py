"""Column profiles and order-insensitive fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .distinct import distinct_counts


def profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, blanks, distinct values, least, greatest and mean of numbers, negatives,
    lengths of texts. Distinct values are counted apart, in tasks that grow with the rows, the others in one aggregate."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        number, text = isinstance(f.dataType, T.NumericType), isinstance(f.dataType, T.StringType)
        none = lambda kind: F.lit(None).cast(kind)
        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.count("*").alias("n_rows"),
                F.count_if(c.isNull()).alias("n_null"),
                (100 * F.count_if(c.isNull()) / F.count("*")).alias("percent_null"),
                (F.count_if(F.trim(c) == "") if text else F.lit(0).cast("long")).alias("n_blank"),
                (F.min(c.cast("double")) if number else none("double")).alias("least"),
                (F.max(c.cast("double")) if number else none("double")).alias("greatest"),
                (F.avg(c.cast("double")) if number else none("double")).alias("mean"),
                (F.count_if(c < 0) if number else none("long")).alias("n_negative"),
                (F.min(F.length(c)) if text else none("int")).alias("shortest"),
                (F.max(F.length(c)) if text else none("int")).alias("longest"),
            )
        )
    rest = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    found = distinct_counts(df, {f.name: F.col(f"`{f.name}`") for f in df.schema}).withColumnRenamed("name", "column")
    first = ["column", "n_rows", "n_null", "percent_null", "n_blank"]
    return rest.join(found, "column", "left").select(*first, F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), *(c for c in rest.columns if c not in first))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in repeated keys, rows beyond the first of each, and repeated keys; nulls are equal to each other."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"), F.count("*").alias("n_groups"))


def top_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def top_by_column(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(column, value, n): the k most frequent values of each text column, ties by value; one pass for all.

    The k of each of 64 slices of the values come first, so no task sees all values of a column.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    sliced = counts.withColumn("_slice", F.pmod(F.xxhash64("value"), F.lit(64)))
    for keys in (["column", "_slice"], ["column"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "value"))
        sliced = sliced.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    return sliced.drop("_slice")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes, sha256) of the files below a path; a file is one row, of 2 GB at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def row_hash(columns: list[Column]) -> Column:
    """60 bits of an MD5 over all columns; a null differs from an empty text and from a shifted one."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns))), 1, 15), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """Rows and the sum of their hashes: equal for equal rows in any order."""
    columns = columns or [F.col(f"`{c}`") for c in df.columns]
    return df.agg(F.count("*").alias("n_rows"), F.sum(row_hash(columns)).cast("decimal(38,0)").alias("hash_sum"))


def compare(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of two runs' fingerprints (key, n_rows, hash_sum)."""
    a, b = (df.select(key, F.col("n_rows").alias(f"n_{s}"), F.col("hash_sum").alias(f"h_{s}")) for df, s in ((before, "before"), (after, "after")))
    state = F.when(F.col("n_before").isNull(), "added").when(F.col("n_after").isNull(), "gone").when((F.col("n_before") == F.col("n_after")) & F.col("h_before").eqNullSafe(F.col("h_after")), "equal").otherwise("differs")
    return a.join(b, key, "full").withColumn("state", state)
