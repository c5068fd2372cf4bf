"""What the operators of this subpackage share: reading, sizes, and from the library scratch tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import discard, saved, scratch_path

__all__ = ["BROADCAST_BYTES", "SPACE", "components", "dealt", "discard", "other_columns", "row_hash", "saved", "scratch_path", "table", "tasks_for", "text_bytes"]

#: White space that separates words, as a Java character class (fixed value of the contracts).
SPACE = r"[\x20\x09-\x0D]+"
#: Nothing is sent to every executor beyond this many bytes.
BROADCAST_BYTES = 8 << 20
#: Partitions of a shuffle at most; beyond that a partition holds several groups, one after the other.
MOST_PARTITIONS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: shards and buckets are counted from it, so that each fits a task."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def tasks_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Groups so that each gets about `each` bytes, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def dealt(df: DataFrame, n_groups: int, group: str) -> DataFrame:
    """df by its column group, numbers from 0 to n_groups - 1: evenly, and over a bounded number of partitions."""
    return df.repartitionById(min(n_groups, MOST_PARTITIONS), F.col(group))


def other_columns(df: DataFrame, *results: str) -> list[Column]:
    """Columns of df, but for those named like a result in any case."""
    taken = {r.lower() for r in results}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in taken]


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of df; what has no hash of its own (maps, variants) counts as JSON."""
    plain = {f.name for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))}
    named = zip(df.columns, other_columns(df), strict=True)
    return F.xxhash64(*(c if n in plain else F.to_json(F.struct(c)) for n, c in named))
