"""Quoted CSV files read in byte ranges: a file of any size is cut anywhere, whatever line breaks its fields hold.

Spark cuts files at line breaks without regard to quotes. Whether a line starts a record depends only on whether the quotes before it
are even in number, so every range counts its quotes, and the sums of the ranges before give each range's first parity.
Records are numbered and put together by the same sums; none of this needs a file, or more than a range, in one task.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .readers import with_provenance

RANGE = ["_file", "_range"]


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(text, _file, _range, _id): lines without their "\\n"; a range's ids grow with its lines."""
    raw = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"))
    return raw.select(F.decode(F.col("value").cast("binary"), encoding).alias("text"), *RANGE, F.monotonically_increasing_id().alias("_id"))


def _marked(lines: DataFrame) -> DataFrame:
    """lines with their quotes and, counted from the range's start, whether the quotes before are odd; blank lines hold nothing if they start a record."""
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum("_quotes").over(W.partitionBy(*RANGE).orderBy("_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("_quotes", quotes).withColumns({"_odd": before % 2 == 1, "_blank": F.col("text").isin("", "\r")})


def _ranges(lines: DataFrame) -> DataFrame:
    """Of each range: _open, whether it starts inside a record; _before, the records that start in the file before it; _starts, those in it; _left, whether the file's quotes up to its end are odd."""
    sums = _marked(lines).groupBy(*RANGE).agg(F.sum("_quotes").alias("_quotes"), F.count_if(~F.col("_odd") & ~F.col("_blank")).alias("_even"), F.count_if(F.col("_odd") & ~F.col("_blank")).alias("_uneven"))
    earlier = W.partitionBy("_file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_sofar", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0))).withColumn("_open", F.col("_sofar") % 2 == 1)
    sums = sums.withColumn("_starts", F.when(F.col("_open"), F.col("_uneven")).otherwise(F.col("_even")))
    return sums.select(*RANGE, "_open", "_starts", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_before"), ((F.col("_sofar") + F.col("_quotes")) % 2 == 1).alias("_left"))


def records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(_file, _record from 0, text): the records of the files below path, line breaks in quotes kept, blank lines left out."""
    lines = _lines(spark, path, encoding)
    placed = _marked(lines).join(_ranges(lines).select(*RANGE, "_open", "_before"), RANGE)
    start = (F.col("_odd") == F.col("_open")) & ~F.col("_blank")
    empty = (F.col("_odd") == F.col("_open")) & F.col("_blank")
    upto = F.sum(F.when(start, 1).otherwise(0)).over(W.partitionBy(*RANGE).orderBy("_id").rowsBetween(W.unboundedPreceding, 0))
    numbered = placed.withColumn("_record", F.col("_before") + upto - 1).where(~empty)
    whole = numbered.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_range", "_id", "text"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["text"]), "\n")
    return whole.select("_file", "_record", F.regexp_replace(text, "\r$", "").alias("text"))


def count_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """n_records of the files below path without their headers, from the ranges' sums alone."""
    files = _ranges(_lines(spark, path, encoding)).groupBy("_file").agg(F.sum("_starts").alias("n"))
    return files.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("n_records"))


def split_csv(spark: SparkSession, path: str, columns: list[str], source: str, separator: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    r"""All columns as text, empty fields as empty text, with provenance; _line is the record's number in its file.

    The same rows as readers.text_csv, which takes a whole file in one task and writes a "\r\n" in a field as "\n"; here fields stay as they are. Files whose header is not `columns`, or whose quotes are odd in number (a quote never
    closed would make all that follows one field), are an error. Encodings in which a line break is not one byte cannot be cut.
    """
    lines = _lines(spark, path, encoding)
    torn = _ranges(lines).groupBy("_file").agg(F.max_by("_left", "_range").alias("left")).where("left").limit(3).collect()
    if torn:
        raise ValueError(f"quotes are not closed in {', '.join(r._file for r in torn)}")
    found = records(spark, path, encoding)
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = found.select("_file", "_record", F.from_csv("text", schema, {"sep": separator, "quote": '"', "escape": '"'}).alias("_row"))
    values = [F.coalesce(F.col(f"_row.c{i}"), F.lit("")) for i in range(len(columns))]
    other = parsed.where("_record = 0").where(~F.array(*values).eqNullSafe(F.array(*map(F.lit, columns)))).limit(3).collect()
    if other:
        raise ValueError(f"another header than {columns} in {', '.join(r._file for r in other)}")
    return with_provenance(parsed.where("_record > 0").select(*(v.alias(c) for v, c in zip(values, columns, strict=True)), "_record"), source, F.col("_record")).drop("_record")


def annotated_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """columns of annotated CSVs as text, empty fields null: the second and third record, kinds and roles, are left out by their number, whatever the values are."""
    found = records(spark, path, encoding)
    names = found.where("_record = 0").select("text").first()
    if names is None:
        raise ValueError(f"no header in {path}")
    heads = next(csv.reader([names.text]))
    if missing := set(columns) - set(heads):
        raise ValueError(f"columns that are not there: {', '.join(sorted(missing))}")
    schema = ", ".join(f"c{i} string" for i in range(len(heads)))
    parsed = found.where("_record > 2").select(F.from_csv("text", schema, {"quote": '"', "escape": '"'}).alias("_row"))
    return parsed.select(*(F.col(f"_row.c{heads.index(c)}").alias(c) for c in columns))
