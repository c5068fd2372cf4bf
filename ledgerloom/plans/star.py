"""Star load: dense keys, quarantine, conservation and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators.assertions import Suite
from ..operators.keys import dense_keys
from ..storage import saved

NO_ORDER = "PEDIDO_INEXISTENTE_NA_ORIGEM"


def fact_order(orders: DataFrame) -> DataFrame:
    """order_key 1..n: legacy first, then the shop, by source id."""
    return dense_keys(orders, [F.when(F.col("system") == "LEGADO", 0).otherwise(1), F.col("order_id").asc()], "order_key")


def fact_item(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Lines whose order is there, with its key: ids collide between systems, so both columns join."""
    return lines.where("order_exists").join(facts.select("system", "order_id", "order_key", "customer_id"), ["system", "order_id"])


def quarantine(lines: DataFrame) -> DataFrame:
    return lines.where("NOT order_exists").drop("order_exists").withColumn("reason", F.lit(NO_ORDER))


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not null and not among the parent's."""
    return child.dropna(subset=on).join(parent.select(*on), on, "left_anti")


def reconcile(facts: DataFrame, source_totals: DataFrame) -> DataFrame:
    """Totals by system against the source's (system, source_total), with absolute and relative differences."""
    own = facts.groupBy("system").agg(F.sum("total").alias("loaded_total"), F.count("*").alias("n_orders"))
    return own.join(source_totals, "system", "full").withColumns(
        {"difference": F.col("loaded_total") - F.col("source_total"), "relative": F.try_divide(F.abs(F.col("loaded_total") - F.col("source_total")).cast("double"), F.abs("source_total").cast("double"))}
    )


def day_key(day: Column) -> Column:
    """A day as the number yyyymmdd."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")


def star(customers: DataFrame, products: DataFrame, orders: DataFrame, lines: DataFrame, tickets: DataFrame) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """The whole star as builders for reload.publish, dimensions first.

    customers (customer_id, others), products (system, product_id, level1), conformed orders and lines, tickets (customer_id, opened, rating).
    Keys are 1..n by the source's own keys, days by date. Facts whose dimension row is missing keep a null key. Lines meet their orders once:
    fact_item and quarantine are read from what comes of it.
    """
    spark = orders.sparkSession
    held: list[DataFrame] = []

    def keyed(t: dict[str, DataFrame]) -> DataFrame:
        if not held or held[0] is not t["fact_order"]:
            own = lines.join(t["fact_order"].select("system", "order_id", "order_key"), ["system", "order_id"], "left")
            held[:] = [t["fact_order"], saved(own, "lines")]
        return held[1]

    def dates_of(_: dict) -> DataFrame:
        ends = orders.agg(F.min("order_date"), F.max("order_date")).first()
        return dates.calendar(spark, str(ends[0]), str(ends[1])).withColumn("date_key", day_key(F.col("day"))) if ends[0] else dates.calendar(spark).limit(0).withColumn("date_key", day_key(F.col("day")))

    def facts(t: dict[str, DataFrame]) -> DataFrame:
        out = fact_order(orders).join(t["dim_customer"].select("customer_id", "customer_key"), "customer_id", "left").join(t["dim_channel"], "channel", "left")
        return out.withColumn("date_key", day_key(F.col("order_date"))).drop("channel")

    def items(t: dict[str, DataFrame]) -> DataFrame:
        own = keyed(t).where("order_exists AND order_key IS NOT NULL").join(t["dim_product"].select("system", "product_id", "product_key"), ["system", "product_id"], "left")
        return own.select("order_key", "product_key", "item_id", "quantity", "unit_price", "discount", "line_value")

    def calls(t: dict[str, DataFrame]) -> DataFrame:
        return tickets.join(t["dim_customer"].select("customer_id", "customer_key"), "customer_id", "left").select("customer_key", day_key(F.col("opened")).alias("date_key"), "rating")

    return {
        "dim_customer": lambda _: dense_keys(customers, [F.col("customer_id").asc()], "customer_key"),
        "dim_product": lambda _: dense_keys(products, [F.when(F.col("system") == "LEGADO", 0).otherwise(1), F.col("product_id").asc()], "product_key"),
        "dim_channel": lambda _: dense_keys(orders.select("channel").distinct().where("channel IS NOT NULL"), [F.col("channel").asc()], "channel_key"),
        "dim_date": dates_of,
        "fact_order": facts,
        "fact_item": items,
        "fact_ticket": calls,
        "quarantine": lambda t: quarantine(keyed(t).drop("order_key")),
    }


def star_checks(t: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
    """What must hold of a star before it is published: keys are unique, every fact finds its dimensions, and of the lines (only counted, so the
    source's own will do) none is lost or multiplied."""
    suite = Suite(t["fact_order"].sparkSession, "star")
    for name, key in (("dim_customer", "customer_key"), ("dim_product", "product_key"), ("dim_channel", "channel_key"), ("dim_date", "date_key"), ("fact_order", "order_key")):
        suite.unique(t[name], f"{name}: one row a key", key)
    suite.no_nulls(t["fact_order"], "orders have a customer", "customer_key").no_nulls(t["fact_order"], "orders have a channel", "channel_key")
    suite.no_orphans(t["fact_order"], t["dim_date"].select("date_key"), "orders have a day", ["date_key"])
    suite.no_orphans(t["fact_item"], t["fact_order"].select("order_key"), "lines have an order", ["order_key"])
    one = lambda df, n: df.select(F.lit(n).alias("n"))
    balance = one(t["fact_item"], 1).unionByName(one(t["quarantine"], 1)).unionByName(one(lines, -1))
    return suite.equal(balance, "a line is loaded or set aside, once", F.coalesce(F.sum("n"), F.lit(0)), 0).results()
