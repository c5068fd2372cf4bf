"""Joins along time: the latest earlier row (as-of), and the intervals that hold a point. Both split hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved
from .keys import running_sum

#: Points of one key and time cell that a task compares at most, and rows of a list that is sent to every executor.
HOT, SENT = 50_000, 100_000


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def asof(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], left_time: str, right_time: str, values: dict[str, str], inclusive: bool = True, since: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with values (new name: column of right) of the latest row of right with equal keys and no later a time.

    by pairs the key columns of left and right. inclusive=False takes earlier times only; since(time of left) gives the
    earliest time that still counts. Of several right rows at one time the one with the greatest values, in their order, is taken.
    Null keys and times match nothing; every row of left stays, with nulls where nothing matches.

    Both sides are dealt by ranges of (keys, time), so a hot key is spread over ranges. Inside a range the last value is carried
    along the key's rows; into a range goes the last right row of all ranges before, one row a range.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    nothing = F.lit(None)
    whole = F.struct(*(_quoted(c) for c in left.columns)).alias("_left")
    plain = [_quoted(n) for n, t in left.dtypes if "map<" not in t and "variant" not in t]
    value = F.struct(*(_quoted(c).alias(f"v{i}") for i, c in enumerate(values.values())))
    before = 0 if inclusive else 1
    lefts = left.select(*(_quoted(a).alias(k) for k, (a, _) in zip(keys, by, strict=True)), _quoted(left_time).alias("_t"), F.lit(1 - before).alias("_side"), whole, F.xxhash64(*plain).alias("_x"))
    rights = right.select(*(_quoted(b).alias(k) for k, (_, b) in zip(keys, by, strict=True)), _quoted(right_time).alias("_t"), F.lit(before).alias("_side"), value.alias("_value")).dropna(subset=[*keys, "_t"])
    complete = F.lit(True)
    for c in (*keys, "_t"):
        complete &= F.col(c).isNotNull()
    both = lefts.where(complete).withColumn("_value", nothing).unionByName(rights.withColumns({"_left": nothing, "_x": F.lit(0).cast("long")}))
    order = ["_t", "_side", "_value", "_x"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(both.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "asof")
    found = F.when(F.col("_value").isNotNull(), F.struct("_t", "_value"))
    own = F.last(found, ignorenulls=True).over(W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    lasts = ranged.groupBy("_range").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(*keys, "_t", "_value"))).alias("_last"))
    carried = lasts.select("_range", F.max("_last").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_last"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_last.{k}")
    carry = F.when(same, F.struct(F.col("_last._t"), F.col("_last._value")))
    met = ranged.withColumn("_own", own).where("_left IS NOT NULL").join(F.broadcast(carried), "_range").withColumn("_own", F.coalesce("_own", carry))
    kept = F.col("_own._t") >= since(F.col("_t")) if since else F.lit(True)
    columns = lambda hit: [*(F.col("_left")[c].alias(c) for c in left.columns), *(F.when(kept, F.col(f"_own._value.v{i}")).alias(n) if hit else nothing.cast(right.schema[c].dataType).alias(n) for i, (n, c) in enumerate(values.items()))]
    return met.select(*columns(True)).unionByName(lefts.where(~complete).select(*columns(False)))


def _count(kind: str, c: Column) -> Column:
    """Days, microseconds, or the whole number itself."""
    return F.unix_date(c).cast("long") if kind == "date" else F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, by: list[tuple[str, str]], at: str, start: str, end: str) -> DataFrame:
    """Each point with each interval of equal keys that holds it, ends included: all columns of both (their names must differ).

    Times are dates, timestamps or whole numbers. An interval lies in cells of a power of four above its length, so in two at
    most, however long it is; a point looks into one cell of each size that occurs (32 at most). Cells and keys are
    joined by equality; where one has more than HOT points these are dealt by their values over several tasks and its intervals copied to
    each. Nulls match nothing, nor do intervals that end before they start.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    kinds = dict(points.dtypes) | {f"_{n}": t for n, t in intervals.dtypes}
    lo, hi = _count(kinds[f"_{start}"], _quoted(start)), _count(kinds[f"_{end}"], _quoted(end))
    level = F.col("_bits") + F.col("_bits") % 2  # powers of four
    spans = intervals.select("*", *(_quoted(b).alias(k) for k, (_, b) in zip(keys, by, strict=True)), lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")
    spans = spans.withColumn("_bits", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.length(F.bin(F.col("_hi") - F.col("_lo"))))).withColumn("_level", level).drop("_bits")
    cells = F.array_distinct(F.array(F.expr("shiftright(_lo, _level)"), F.expr("shiftright(_hi, _level)")))
    spans = spans.withColumn("_cell", F.explode(cells))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # 32 at most
    spots = points.select("*", *(_quoted(a).alias(k) for k, (a, _) in zip(keys, by, strict=True)), _count(kinds[at], _quoted(at)).alias("_at")).where("_at IS NOT NULL")
    spots = spots.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", F.expr("shiftright(_at, _level)"))
    cell = [*keys, "_level", "_cell"]
    hot = saved(spots.groupBy(*cell).agg(F.ceil(F.count("*") / HOT).alias("_pieces")).where("_pieces > 1"), "hot")
    n_hot = hot.count()
    if n_hot:
        sent = F.broadcast(hot) if n_hot <= SENT else hot
        plain = [_quoted(n) for n, t in points.dtypes if "map<" not in t and "variant" not in t]
        salt = F.pmod(F.xxhash64(*plain), F.col("_pieces"))  # by value, so that a task that runs again deals alike
        spots = spots.join(sent, cell, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_pieces")
        spans = spans.join(sent, cell, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
        cell = [*cell, "_salt"]
    met = spots.join(spans, cell).where("_at BETWEEN _lo AND _hi")
    return met.select(*(_quoted(c) for c in points.columns), *(_quoted(c) for c in intervals.columns))


def sessions(rows: DataFrame, by: list[str], at: str, gap_micros: int, total: str) -> DataFrame:
    """by, start, end, n, total: runs of rows (at is a timestamp) of which none comes more than the gap after the one before.

    Rows with null keys or times are in no session. Rows of one moment are counted first; the moment before comes from asof(), and sessions
    are numbered by sums over ranges, so a key with any number of rows is spread over tasks.
    """
    keyed = rows.select(*by, F.col(at).cast("timestamp").alias("_at"), F.col(total).alias("_value")).dropna(subset=[*by, "_at"])
    moments = saved(keyed.groupBy(*by, "_at").agg(F.count("*").alias("_n"), F.sum("_value").alias("_total")), "moments")
    linked = asof(moments, moments.select(*by, "_at"), [(k, k) for k in by], "_at", "_at", {"_before": "_at"}, inclusive=False)
    begins = F.coalesce(F.unix_micros("_at") - F.unix_micros("_before") > gap_micros, F.lit(True))
    numbered = running_sum(linked.withColumn("_begins", begins.cast("long")), [*map(F.col, by), F.col("_at")], "_begins", "_sofar")
    out = numbered.groupBy(*by, (F.col("_sofar") + F.col("_begins")).alias("_session"))
    return out.agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.sum("_n").alias("n"), F.sum("_total").alias("total")).drop("_session")
