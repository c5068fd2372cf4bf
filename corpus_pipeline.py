"""The corpus pipeline: five stages over documents, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard_join, mixing, quality_classifier, suffix_dedup
from ledgerloom.llm.common import saved, table
from ledgerloom.llm.queries import MIX_WEIGHTS, mix_levels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It is fitted on rated documents of this stage's input."""
    model = quality_classifier.fit(docs, quality_classifier.graded(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (five words, Jaccard 0.8): that with the smallest doc_id.

    Each row is judged by its own text: other texts under a repeated doc_id stay, of exact copies one does (with the
    smallest other columns). Documents without words, and rows with a null doc_id, stay.
    """
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    found = saved(jaccard_join.duplicates(docs, percent=80, width=5).where("NOT kept OR copies > 1"), "duplicates")
    key = ["doc_id", "text_hash"]
    single = docs.join(found.select(*key), key, "left_anti").select(*COLUMNS)
    copies = docs.join(found.where("kept").select(*key), key, "left_semi")
    one = copies.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("other")).select("doc_id", "text", "other.*")
    return single.unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that also start earlier.

    A character of which a byte goes goes whole, nothing else does. A document of which no word is left goes, and
    n_chars of those that lose something is counted anew.
    """
    given = docs.select(*COLUMNS).withColumn("no_text", F.col("text").isNull())
    out = suffix_dedup.remove_repeats(given, length=100, whole_characters=True, with_text=False)
    cut, text = F.size("spans") > 0, F.col("kept").cast("string")
    n_chars = F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    out = out.select("doc_id", F.when(~F.col("no_text"), text).alias("text"), "lang", "source", n_chars.alias("n_chars"), cut.alias("cut"))
    return out.where(~F.col("cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, each once at most; that in which a leaf's prefix ends is cut there, and its n_chars counted anew."""
    weights = spark.createDataFrame(MIX_WEIGHTS, "level string, name string, weight long")
    levels = {f"mix_{k}": v for k, v in mix_levels().items()}
    out = mixing.mix(docs.select(*COLUMNS), levels, weights.withColumn("level", F.concat(F.lit("mix_"), "level")), max_epochs=1)
    n_chars = F.when(F.col("take_tokens") < F.col("n_tokens"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: No SQL for the classifier and the encoder; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
