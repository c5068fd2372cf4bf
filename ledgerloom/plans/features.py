"""Point-in-time features, target, snapshots, leaks and the proof that there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers

#: Type, meaning, and whether it may be null, of each feature: contract, dictionary and null census come from here.
REGISTRY = {
    "recency_days": ("bigint", "days from the last effective order to the cut", True),
    "frequency": ("bigint", "effective orders", False),
    "monetary": ("decimal(18,2)", "sum of effective totals", False),
    "mean_ticket": ("decimal(18,2)", "monetary by frequency", True),
    "orders_last_90d": ("bigint", "effective orders in the 90 days before the cut", False),
    "cancel_rate": ("decimal(18,4)", "cancelled of all orders", False),
    "discount_rate": ("decimal(18,4)", "discounts by goods of effective orders", True),
    "mean_delivery_days": ("decimal(18,2)", "mean days to deliveries up to the cut", True),
    "n_categories": ("bigint", "different categories bought", False),
    "main_channel": ("string", "most frequent channel", True),
    "both_systems": ("bigint", "1 if both systems have effective orders", False),
    "tenure_days": ("bigint", "days from the first effective order to the cut", True),
    "n_tickets": ("bigint", "service tickets up to the cut", False),
    "mean_rating": ("decimal(18,2)", "mean of their ratings", True),
}
FEATURES = list(REGISTRY)


def contract(df: DataFrame, key: str = "customer_id", label: str = "y") -> DataFrame:
    """df with the registry's columns, types and order: what a sink of features writes."""
    return df.select(F.col(key).cast("long").alias(key), *(F.col(c).cast(kind).alias(c) for c, (kind, _, _) in REGISTRY.items()), F.col(label).cast("int").alias(label))


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *x) for c, x in REGISTRY.items()], "feature string, type string, meaning string, may_be_null boolean")


def null_census(df: DataFrame) -> DataFrame:
    """Nulls of each feature, and whether the registry allows them."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_null"), F.lit(o).alias("may_be_null")) for c, (_, _, o) in REGISTRY.items()))
    return df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*").withColumn("allowed", F.col("may_be_null") | (F.col("n_null") == 0))


def day(x: str) -> Column:
    return F.lit(x).cast("date")


def target(orders: DataFrame, cut: str, end: str) -> DataFrame:
    """Customers with an order of any status up to the cut; y = 1 with an effective one in (cut, end]. One scan."""
    before = F.col("order_date") <= day(cut)
    hit = (F.col("order_date") > day(cut)) & (F.col("order_date") <= day(end)) & F.col("effective")
    return orders.groupBy("customer_id").agg(F.max(before.cast("int")).alias("_in"), F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("y")).where("_in = 1").drop("_in")


def positives_by_sets(orders: DataFrame, cut: str, end: str, cancelled: Column) -> DataFrame:
    """Customers with y = 1 once more, apart from target(): those of orders in (cut, end] not cancelled, met with those up to the cut."""
    date = F.col("order_date")
    later = orders.where((date > day(cut)) & (date <= day(end)) & F.coalesce(~cancelled, F.lit(True)))
    return later.select("customer_id").intersect(orders.where(date <= day(cut)).select("customer_id"))


def with_levels(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """orders with levels, the different categories of their lines: what features() needs of items and products, so that those who make
    features of several versions of orders go through the lines once."""
    brands = items.select("system", "order_id", "product_id").join(products.select("system", "product_id", "level1"), ["system", "product_id"])
    return orders.join(brands.groupBy("system", "order_id").agg(F.collect_set("level1").alias("levels")), ["system", "order_id"], "left")


def features(orders: DataFrame, items: DataFrame, products: DataFrame, tickets: DataFrame, cut: str) -> DataFrame:
    """The fourteen features of each customer with an order up to the cut; nothing after the cut is read.

    orders: (system, order_id, customer_id, order_date, delivery_date, delivery_days, total, goods, discount, channel, effective);
    items: (system, order_id, system, product_id); products: (system, product_id, level1); tickets: (customer_id, opened, rating).
    Where orders have levels (with_levels), items and products are not read.
    """
    known = orders.where(F.col("order_date") <= day(cut))
    good = F.col("effective")
    of_good = lambda x: F.when(good, x)
    money = lambda c: F.coalesce(F.sum(of_good(F.col(c))), F.lit(0)).cast("decimal(24,4)")
    sums = known.groupBy("customer_id").agg(
        F.count("*").alias("n_all"),
        F.count_if(good).alias("frequency"),
        money("total").alias("_total"),
        money("goods").alias("_goods"),
        money("discount").alias("_discount"),
        F.max(of_good(F.col("order_date"))).alias("_last"),
        F.min(of_good(F.col("order_date"))).alias("_first"),
        F.count_if(good & (F.col("order_date") > F.date_sub(day(cut), 90))).alias("orders_last_90d"),
        F.sum(F.when(good & (F.col("delivery_date") <= day(cut)), F.col("delivery_days"))).alias("_days"),
        F.count(F.when(good & (F.col("delivery_date") <= day(cut)), F.col("delivery_days"))).alias("_delivered"),
        F.max(of_good((F.col("system") == "LEGADO").cast("int"))).alias("_legacy"),
        F.max(of_good((F.col("system") == "ECOM").cast("int"))).alias("_shop"),
    )
    effective = known.where(good)
    if "levels" in orders.columns:
        bought = effective.select("customer_id", F.explode("levels").alias("level1"))
    else:
        bought = (
            items.select("system", "order_id", "product_id").join(effective.select("system", "order_id", "customer_id"), ["system", "order_id"])
            .join(products.select("system", "product_id", "level1"), ["system", "product_id"])
        )
    categories = bought.groupBy("customer_id").agg(F.countDistinct("level1").alias("n_categories"))
    # the most frequent channel, of equally frequent ones the first by name
    channel = effective.groupBy("customer_id", "channel").agg(F.count("*").alias("n")).groupBy("customer_id").agg(F.min_by("channel", F.struct(-F.col("n"), F.col("channel"))).alias("main_channel"))
    rated = numbers.within(F.col("rating"), 1, 5)
    service = tickets.where(F.col("opened") <= day(cut)).groupBy("customer_id").agg(F.count("*").alias("n_tickets"), F.sum(rated).alias("_ratings"), F.count(rated).alias("_rated"))
    joined = reduce(lambda a, b: a.join(b, "customer_id", "left"), (categories, channel, service), sums)
    zero = F.lit(0).cast("long")
    return joined.select(
        "customer_id",
        F.datediff(day(cut), F.col("_last")).alias("recency_days"),
        "frequency",
        F.round("_total", 2).alias("monetary"),
        numbers.ratio(F.col("_total"), F.col("frequency"), 2).alias("mean_ticket"),
        "orders_last_90d",
        numbers.ratio(F.col("n_all") - F.col("frequency"), F.col("n_all"), 4).alias("cancel_rate"),
        F.when(F.col("_goods") > 0, F.round(F.col("_discount") / F.col("_goods").cast("decimal(20,4)"), 4)).alias("discount_rate"),
        numbers.ratio(F.col("_days"), F.col("_delivered"), 2).alias("mean_delivery_days"),
        F.coalesce("n_categories", zero).alias("n_categories"),
        "main_channel",
        F.coalesce(F.col("_legacy") * F.col("_shop"), F.lit(0)).alias("both_systems"),
        F.datediff(day(cut), F.col("_first")).alias("tenure_days"),
        F.coalesce("n_tickets", zero).alias("n_tickets"),
        numbers.ratio(F.col("_ratings"), F.col("_rated"), 2).alias("mean_rating"),
    )


def as_of(orders: DataFrame, items: DataFrame, tickets: DataFrame, cut: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The warehouse as it was at the cut: later orders and tickets gone, later deliveries not known yet."""
    seen = F.col("delivery_date") <= day(cut)
    then = orders.where(F.col("order_date") <= day(cut)).withColumns({"delivery_days": F.when(seen, F.col("delivery_days")), "delivery_date": F.when(seen, F.col("delivery_date"))})
    return then, items.join(then.select("system", "order_id"), ["system", "order_id"], "left_semi"), tickets.where(F.col("opened") <= day(cut))


def differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (feature, n_different) of a full outer comparison, null-safe; a missing row differs everywhere."""
    left = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(1).alias("_a"))
    right = b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("_b"))
    both = left.join(right, key, "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    cells = [F.struct(F.lit(c).alias("feature"), F.count_if(alone | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("n_different")) for c in columns]
    return both.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def leaky(orders: DataFrame, cut: str) -> DataFrame:
    """Recency and frequency as someone who forgets the cut computes them."""
    good = orders.where("effective")
    return good.groupBy("customer_id").agg(F.datediff(day(cut), F.max("order_date")).alias("recency_days_leaky"), F.count("*").alias("frequency_leaky"))


def z_scores(df: DataFrame, column: str, train: Column | None = None) -> DataFrame:
    """df with z, by mean and population deviation of all rows, or of those of train only."""
    rows = df.where(train) if train is not None else df
    stats = rows.agg(F.avg(F.col(column).cast("double")).alias("_mean"), F.stddev_pop(F.col(column).cast("double")).alias("_std"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", F.round(F.try_divide(F.col(column).cast("double") - F.col("_mean"), F.col("_std")), 6)).drop("_mean", "_std")  # stats is one row


def label_flips(orders: DataFrame, other_date: str, cut: str, end: str) -> DataFrame:
    """Customers by their label under two date columns; null: not in that population."""
    a = target(orders, cut, end).withColumnRenamed("y", "y_first")
    b = target(orders.drop("order_date").withColumnRenamed(other_date, "order_date"), cut, end).withColumnRenamed("y", "y_second")
    return a.join(b, "customer_id", "full").groupBy("y_first", "y_second").agg(F.count("*").alias("n_customers"))


def main_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group by a window over the aggregate."""
    w = W.partitionBy(group).orderBy(F.desc("n"), F.asc(value))
    return df.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
