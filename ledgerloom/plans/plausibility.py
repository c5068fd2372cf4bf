"""Whether what one source says of another holds, and bounds of what only both together show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import diagnostics


def referred(claims: DataFrame, orders: DataFrame, lines: DataFrame, products: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """claims (ref_system, ref_id, product_id, sent, ...) with what their references hold: in_declared, in_other (an order
    of that id there), product_known, product_in_order (a line of the declared order has it), sent_after (the declared
    system's order; null if there is none).

    orders: (system, order_id, placed). Both systems' orders are one row an id, so claims meet them once; lines
    (system, order_id, product_id) and products (product_id) are made distinct before. A null reference holds nothing.
    """
    a, b = sides
    day = lambda s: F.min(F.when(F.col("system") == s, F.col("placed")))
    ids = orders.groupBy(F.col("order_id").alias("ref_id")).agg(day(a).alias("_a"), day(b).alias("_b"))
    pairs = lines.select(F.col("system").alias("ref_system"), F.col("order_id").alias("ref_id"), "product_id").distinct().withColumn("_line", F.lit(True))
    known = products.select("product_id").distinct().withColumn("_known", F.lit(True))
    met = claims.join(ids, "ref_id", "left").join(pairs, ["ref_system", "ref_id", "product_id"], "left").join(known, "product_id", "left")
    own = F.when(F.col("ref_system") == a, F.col("_a")).when(F.col("ref_system") == b, F.col("_b"))
    other = F.when(F.col("ref_system") == a, F.col("_b")).when(F.col("ref_system") == b, F.col("_a"))
    found = {"in_declared": own.isNotNull(), "in_other": other.isNotNull(), "product_known": F.col("_known").isNotNull(), "product_in_order": F.col("_line").isNotNull(), "sent_after": F.col("sent") >= own}
    return met.withColumns(found).drop("_a", "_b", "_line", "_known")


def reference_counts(met: DataFrame) -> DataFrame:
    """Counts of referred() by declared system."""
    own, other = F.col("in_declared"), F.col("in_other")
    return met.groupBy("ref_system").agg(
        F.count("*").alias("n"), F.count_if(own).alias("in_declared"), F.count_if(~own & other).alias("only_other"), F.count_if(own & other).alias("in_both"), F.count_if(~own & ~other).alias("nowhere"),
        F.count_if("product_known").alias("product_known"), F.count_if("product_in_order").alias("product_in_order"), F.count_if("sent_after").alias("sent_after"),
    )


def channel_profile(orders: DataFrame, after: Column, night: tuple[int, int] = (22, 8)) -> DataFrame:
    """By system and channel of orders (system, channel, hour, freight): hours, orders at night, freight, and the channel's
    share of its system's orders before and after a change. One aggregate; what is windowed is a row a channel."""
    begins, ends = night
    share = lambda test: F.try_divide(F.count_if(test), F.sum(F.count_if(test)).over(W.partitionBy("system")))
    freight = F.col("freight")
    return orders.groupBy("system", "channel").agg(
        F.count("*").alias("n"), F.min("hour").alias("hour_min"), F.max("hour").alias("hour_max"), F.count_if((F.col("hour") >= begins) | (F.col("hour") < ends)).alias("n_night"),
        (F.sum(freight).cast("double") / F.count(freight)).alias("freight_mean"), F.min(freight).alias("freight_min"), F.max(freight).alias("freight_max"),
        F.count_if(freight > 0).alias("freight_positive"), F.count_if(freight == 0).alias("freight_zero"), F.count_if(freight < 0).alias("freight_negative"), F.count_if(freight == -1).alias("freight_minus_one"),
        (100 * share(~after)).alias("before_percent"), (100 * share(after)).alias("after_percent"),
    )


def class_shares(products: DataFrame, label: str) -> DataFrame:
    """By system and mapping class: labels, products, and the products' percent of their system."""
    n = products.groupBy("system", "mapping").agg(F.countDistinct(label).alias("n_labels"), F.count("*").alias("n_products"))
    return n.withColumn("percent", 100 * F.col("n_products") / F.sum("n_products").over(W.partitionBy("system")))


def any_of(tests: dict[str, Column], name: str = "any of these") -> dict[str, Column]:
    """The tests with one that holds where any of them does; unknown ones do not."""
    return tests | {name: reduce(lambda x, y: x | y, (F.coalesce(t, F.lit(False)) for t in tests.values()))}


def bounds(estimate: str, df: DataFrame, surely: Column, maybe: Column) -> DataFrame:
    """(estimate, lower, upper, base): rows that surely are affected, and those with the ones that may be."""
    return diagnostics.anomalies(df, {estimate: (surely, F.coalesce(surely, F.lit(False)) | F.coalesce(maybe, F.lit(False)))}).withColumnRenamed("anomaly", "estimate")


def with_counterpart(records: DataFrame, side: str) -> tuple[DataFrame, Column, Column]:
    """Records of one side (system, tax, tax_ok, folded, region) with marks of a counterpart on the other: surely by a valid
    tax id of both; perhaps by name and region where neither has such a pair and one of them has no valid tax id. Groups
    of any size are counts."""
    valid = F.coalesce("tax_ok", F.lit(False))
    here = F.col("system") == side
    r = records.select("system", "tax", valid.alias("_ok"), "folded", F.coalesce("region", F.lit("")).alias("region"))
    shared = r.where("_ok").groupBy("tax").agg(F.count_if(here).alias("_h"), F.count_if(~here).alias("_t")).where("_h > 0 AND _t > 0").select("tax", F.lit(True).alias("_pair"))
    marked = r.join(shared, "tax", "left")
    lone = marked.where(~here & F.col("_pair").isNull()).groupBy("folded", "region").agg(F.count_if(~F.col("_ok")).alias("_unsure"), F.count("*").alias("_any"))
    out = marked.where(here).join(lone, ["folded", "region"], "left")
    surely = F.col("_pair").isNotNull()
    return out, surely, ~surely & F.when(F.col("_ok"), F.col("_unsure") > 0).otherwise(F.col("_any") > 0)


def claimed_system(tickets: DataFrame, records: DataFrame, sides: dict[str, str]) -> tuple[DataFrame, Column, Column]:
    """Tickets (declared, tax) with marks: surely of the other system if only it knows the tax id, perhaps if both or
    neither do. sides: the records' name of each declared system."""
    (a, _), (b, _) = sides.items()
    owners = records.where("tax IS NOT NULL").groupBy("tax").agg(F.max(F.col("system") == sides[a]).alias("_a"), F.max(F.col("system") == sides[b]).alias("_b"))
    met = tickets.join(owners, "tax", "left").withColumns({"_a": F.coalesce("_a", F.lit(False)), "_b": F.coalesce("_b", F.lit(False))})
    own, other = F.when(F.col("declared") == a, F.col("_a")).otherwise(F.col("_b")), F.when(F.col("declared") == a, F.col("_b")).otherwise(F.col("_a"))
    return met, ~own & other, own == other
