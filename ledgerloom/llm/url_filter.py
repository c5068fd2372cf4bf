"""URL filters: a blocked Bloom filter of listed URLs, then an exact join of what it passes.

Every url is cut into host and path. The candidates of a url are its host's suffixes (by label)
with its path's prefixes, of the label counts and lengths that occur in the list. Candidates that
the filter passes go to an exact join with the list, which removes the false positives; of the
rules that remain for a url the longest wins. Only DataFrame functions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, other_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is one 64-bit word: bits set in it for each key, and bits of the filter for each key.
PROBES, BITS_A_KEY = 4, 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks))


def _mask(key: Column) -> Column:
    """The key's bits in its block: six bits of a second hash name each."""
    bits = [F.shiftrightunsigned(F.xxhash64(key, F.lit(2)), 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(PROBES)]
    return reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits))


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, word) of the filter over keys.key, and its number of blocks. One row a block in use."""
    n_blocks = max(1, -(-n_keys * BITS_A_KEY // 64))
    rows = keys.select(_block(F.col("key"), n_blocks).alias("block"), _mask(F.col("key")).alias("word"))
    return rows.groupBy("block").agg(F.bit_or("word").alias("word")), n_blocks


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, action). A rule fits its host and all its subdomains, where the url's path
    starts with the rule's. Of the rules that fit, the one with the longest host + path wins; of
    equally long ones that with the longer host, then block before allow. A null url or one
    without "://" has an empty host and path. Rules with a null field, and columns of pages named
    like a result in any case, are left out; all other columns pass. Each row of pages gives one row, repeated
    ones too; no rows, or no rules, are no error.

    The list's distinct path lengths and its greatest label count come to the driver (they are
    bounded by the length of a url). The filter holds 16 bits a rule and is broadcast only up to
    BROADCAST_BYTES; beyond that it is joined by block.
    """
    rules = rules.select("host", "path", "action").dropna().distinct()
    key = lambda h, p: F.concat(h, F.lit("\n"), p)
    rules = rules.withColumn("key", key(F.col("host"), F.col("path")))
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.sum(F.length("host") + F.length("path")).alias("chars")).first()
    # the columns of pages are kept apart from those of the plan
    page = F.struct(*other_columns(pages, "host", "path", "rule", "verdict")).alias("page")
    parts = pages.select(page, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shape["n"]:
        return parts.select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    bloom, n_blocks = build_filter(rules.select("key").distinct(), shape["n"])
    small = n_blocks * 16 <= BROADCAST_BYTES
    listed_small = 12 * shape["chars"] + 200 * shape["n"] <= BROADCAST_BYTES
    # each different host and path once: a host with a third of all rows is one row a task here
    urls = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    lengths = F.filter(F.array(*map(F.lit, sorted(shape["lengths"]))), lambda n: n <= F.length("path"))
    cut = urls.select("host", "path", F.explode(suffixes).alias("suffix"), lengths.alias("lengths")).select(
        "host", "path", "suffix", F.explode("lengths").alias("n")
    )
    asked = cut.select("host", "path", key(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("n"))).alias("key"))
    # a filter that is not broadcast meets each key once: candidates such as "com/" are asked for by very many urls
    keys = asked if small else asked.select("key").distinct()
    passed = keys.withColumn("block", _block(F.col("key"), n_blocks)).join(F.broadcast(bloom) if small else bloom, "block")
    passed = passed.where(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).drop("block", "word")
    listed = rules.select(
        "key",
        F.struct(
            F.length(F.concat("host", "path")).alias("long"),
            F.length("host").alias("host"),
            (F.col("action") == "block").alias("block"),
            F.concat("host", "path").alias("rule"),
            F.col("action").alias("action"),
        ).alias("fit"),
    )
    found = passed.join(F.broadcast(listed) if listed_small else listed, "key")
    found = found if small else asked.join(found, "key")
    best = found.groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return parts.join(best, ["host", "path"], "left").select(
        "page.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", F.lit(default)).alias("verdict")
    )


#: The contract's rules (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, action string")
