"""Sources with provenance: database tables, CSV as text, irregular NDJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import looks_garbled

#: Paths of a review: column, JSON path (fixed values).
REVIEW_PATHS = {
    "review_id": "review_id",
    "order_ref": "order.ref",
    "order_channel": "order.channel",
    "sku": "product.sku",
    "submitted_at": "submitted_at",
    "rating": "rating",
    "title": "title",
    "comment": "comment",
    "verified_purchase": "verified_purchase",
    "helpful_votes": "helpful_votes",
}


def with_provenance(df: DataFrame, source: str, line: Column) -> DataFrame:
    return df.withColumns({"_source": F.lit(source), "_extracted_at": F.current_timestamp(), "_line": line.cast("long")})


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A table by ranges of its key, each range a task with its own cursor."""
    return spark.read.option("fetchsize", 50_000).options(**options).jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def parquet_table(spark: SparkSession, path: str, key: str, source: str) -> DataFrame:
    """A table kept as Parquet; its key is the provenance line, which needs no sort."""
    df = spark.read.parquet(path)
    return with_provenance(df, source, F.col(key))


def text_csv(spark: SparkSession, path: str, columns: list[str], source: str, separator: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as text, quoted line breaks inside fields, empty fields as empty text. The header must be `columns`.

    Such a file cannot be split, so its record numbers are in file order.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, sep=separator, encoding=encoding, header=True, enforceSchema=False, multiLine=True, quote='"', escape='"')
    return with_provenance(df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns)), source, F.monotonically_increasing_id() + 1)


def count_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Records of a CSV counted another way: line ends outside quotes, without the header."""
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("text"))
    outside = F.regexp_replace("text", '"[^"]*"', '""')
    return whole.agg(F.sum(F.size(F.filter(F.split(outside, r"\r?\n"), lambda x: x != "")) - 1).alias("n_records"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _line): lines with their number in their file, however the file is split.

    A split's lines are numbered by their row ids, shifted by the lines of the file's splits before; two scans, no sort.
    """
    split = ["_file", "_block"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_id", F.monotonically_increasing_id())
    sizes = lines.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.select(*split, "_first", before.alias("_before")), split).select("value", "_file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("_line"))


def sample(df: DataFrame, n: int = 200_000) -> DataFrame:
    """Some n rows, for a profile of what a table looks like."""
    return df.limit(n)


def ndjson(spark: SparkSession, path: str, source: str = "reviews", paths: dict[str, str] = REVIEW_PATHS) -> DataFrame:
    """One row a line that holds a JSON value. Each path as text, and lists of the paths that are absent, null, or text.

    Blank lines are left out, broken ones are in broken_lines().
    """
    raw = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = raw.withColumn("v", F.try_parse_json("value")).where("v IS NOT NULL")
    at = {k: f"$.{p}" for k, p in paths.items()}
    value = {k: F.try_variant_get("v", p, "string") for k, p in at.items()}
    node = {k: F.try_variant_get("v", p, "variant") for k, p in at.items()}
    collect = lambda test: F.filter(F.array(*(F.when(test(n), F.lit(k)) for k, n in node.items())), lambda x: x.isNotNull())
    df = parsed.select(
        *(F.when(~F.coalesce(F.is_variant_null(node[k]), F.lit(False)), v).alias(k) for k, v in value.items()),
        collect(lambda n: n.isNull()).alias("absent_paths"),
        collect(lambda n: F.coalesce(F.is_variant_null(n), F.lit(False))).alias("null_paths"),
        collect(lambda n: F.schema_of_variant(n) == "STRING").alias("text_paths"),
        "_line",
    )
    return with_provenance(df, source, F.col("_line"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine of ndjson(): (value, _file, _line) of lines that are neither blank nor JSON."""
    return numbered_lines(spark, path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def seed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A generated CSV with header, quotes doubled inside quotes; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="", quote='"', escape='"')


def find_columns(spark: SparkSession, pattern: str, database: str | None = None) -> DataFrame:
    """(table, column, type) of the catalog's columns whose name fits the pattern."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string").where(F.col("column").rlike(pattern))


def garbled_rows(df: DataFrame) -> DataFrame:
    """Rows a text column with signs of a wrong encoding."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(looks_garbled(F.col(c))).alias("n")) for c in texts]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
