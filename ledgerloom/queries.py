"""Registered queries over the driver's tables, each with the same result in SQL.

The tables stand for the retail sources: even orders come from the legacy system, odd ones from the shop, one order in
forty is missing, so that its lines are orphans, and some deliveries, discounts and freights carry the
defects that the conformance rules are for. Amounts are decimals here and integers (1/10000) in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import dates, text
from .operators import identity, keys, models, profile, quantiles
from .operators.assertions import Suite, parity
from .plans import conform, diagnostics, star
from .plans import features as feat
from .sources import generator
from .storage import saved, tasks_for_rows

CUT, END = "2000-06-30", "2000-09-28"
SYSTEM = "CASE WHEN {k} % 2 = 0 THEN 'LEGADO' ELSE 'ECOM' END"
RAW_STATUS = """CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'ENTREGUE' WHEN 'O' THEN 'EM TRANSITO' ELSE CASE WHEN o_orderkey % 6 = 0 THEN 'CANCELADO' ELSE 'SEPARACAO' END END
  ELSE CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE CASE o_orderkey % 6 WHEN 1 THEN 'canceled' WHEN 3 THEN 'payment_declined' ELSE 'processing' END END END"""
RAW_CHANNEL = """CASE WHEN o_orderkey % 2 = 0 THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'LOJA' WHEN '2' THEN 'LOJA' WHEN '3' THEN 'TELEVENDAS' ELSE 'SITE' END
  ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'web' WHEN '2' THEN 'app' ELSE 'marketplace' END END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the sources have them."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 40 <> 7")
    placed = F.to_date("o_orderdate")
    delivery = (
        F.when(F.col("o_orderstatus") != "F", None)
        .when(F.col("o_orderkey") % 97 == 0, F.lit("1900-01-01").cast("date"))
        .when(F.col("o_orderkey") % 89 == 0, F.date_sub(placed, 2))
        .otherwise(F.date_add(placed, (F.col("o_orderkey") % 40).cast("int")))
    )
    return o.select(
        F.expr(SYSTEM.format(k="o_orderkey")).alias("system"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.expr(RAW_STATUS).alias("raw_status"),
        F.expr(RAW_CHANNEL).alias("raw_channel"), placed.alias("order_date"), delivery.alias("delivery_date"), (F.col("o_orderkey") % 25 - 1).cast("decimal(18,4)").alias("freight"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("decimal(14,0)")
    quantity = F.col("l_quantity").cast("int")
    rate = F.floor(F.col("l_discount") * 100 + 0.5).cast("int")
    absent = (F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 10 == 0)
    return table(spark, sf_dir, "lineitem").select(
        F.expr(SYSTEM.format(k="l_orderkey")).alias("system"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        quantity.alias("quantity"), (cents / 100).cast("decimal(14,2)").alias("unit_price"), F.when(absent, -1).otherwise((cents * quantity * rate / 10000).cast("decimal(18,4)")).cast("decimal(18,4)").alias("discount"),
    )


def star_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Conformed orders, items, products and tickets."""
    raw = raw_orders(spark, sf_dir)
    lines = raw_items(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("level1"))
    products = part.select(F.explode(F.array(F.lit("LEGADO"), F.lit("ECOM"))).alias("system"), "product_id", "level1")
    tickets = table(spark, sf_dir, "events").select(F.col("user_id").alias("customer_id"), F.date_sub(F.to_date("ts"), 8766).alias("opened"), F.floor("value").cast("int").alias("rating"))
    return conform.orders(raw, conform.mended(lines)), conform.items(lines, raw), products, tickets


BASE_SQL = f"""
raw AS (
  SELECT {SYSTEM.format(k="o_orderkey")} AS system, o_orderkey AS order_id, o_custkey AS customer_id, {RAW_STATUS} AS raw_status, {RAW_CHANNEL} AS raw_channel, o_orderdate::DATE AS order_date,
    CASE WHEN o_orderstatus <> 'F' THEN NULL WHEN o_orderkey % 97 = 0 THEN DATE '1900-01-01' WHEN o_orderkey % 89 = 0 THEN o_orderdate::DATE - 2 ELSE o_orderdate::DATE + (o_orderkey % 40)::INT END AS raw_delivery,
    (o_orderkey % 25 - 1) * 10000 AS freight
  FROM orders WHERE o_orderkey % 40 <> 7),
items AS (
  SELECT system, l_orderkey * 10 + l_linenumber AS item_id, order_id, product_id, quantity, cents, quantity * cents * 100 AS goods, absent, CASE WHEN absent THEN 0 ELSE quantity * cents * rate END AS discount, order_id % 40 <> 7 AND order_id IN (SELECT o_orderkey FROM orders) AS order_exists
  FROM (SELECT {SYSTEM.format(k="l_orderkey")} AS system, l_orderkey, l_linenumber, l_orderkey AS order_id, l_partkey AS product_id, l_quantity::BIGINT AS quantity, floor(l_extendedprice * 100 / l_quantity)::BIGINT AS cents,
    floor(l_discount * 100 + 0.5)::BIGINT AS rate, l_linenumber = 7 AND l_orderkey % 10 = 0 AS absent FROM lineitem)),
conformed AS (
  SELECT raw.*, CASE WHEN raw_status IN ('ENTREGUE', 'delivered') THEN 'ENTREGUE' WHEN raw_status IN ('EM TRANSITO', 'shipped') THEN 'EM_TRANSITO' WHEN raw_status IN ('SEPARACAO', 'processing') THEN 'EM_PROCESSAMENTO' ELSE 'CANCELADO' END AS status,
    CASE raw_channel WHEN 'LOJA' THEN 'FISICO' WHEN 'TELEVENDAS' THEN 'TELEVENDAS' WHEN 'marketplace' THEN 'MARKETPLACE' ELSE 'ONLINE_PROPRIO' END AS channel,
    coalesce(raw_delivery = DATE '1900-01-01', false) AS delivery_undated, coalesce(raw_delivery <> DATE '1900-01-01' AND raw_delivery < order_date, false) AS delivery_too_early,
    CASE WHEN raw_delivery >= order_date THEN raw_delivery END AS delivery_date, coalesce(s.units, 0) AS units, coalesce(s.goods, 0) AS goods, coalesce(s.discount, 0) AS discount, coalesce(s.absent, false) AS discount_absent,
    coalesce(s.goods, 0) - coalesce(s.discount, 0) + freight AS total
  FROM raw LEFT JOIN (SELECT order_id, sum(quantity) AS units, sum(goods) AS goods, sum(discount) AS discount, bool_or(absent) AS absent FROM items WHERE order_exists GROUP BY 1) s USING (order_id)),
facts AS (SELECT *, status <> 'CANCELADO' AS effective, delivery_date - order_date AS delivery_days FROM conformed),
tickets AS (SELECT user_id AS customer_id, ts::DATE - 8766 AS opened, floor(value)::INT AS rating FROM events)"""


def _half_up(over: str, under: str) -> str:
    """SQL of an integer quotient rounded half away from zero."""
    return f"(CASE WHEN ({over}) < 0 THEN -1 ELSE 1 END * ((2 * abs({over}) + ({under})) // (2 * ({under}))))"


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles and integers as longs, the types of the SQL results."""
    return df.select(*(F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n).cast("long").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes))


def conformed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = star_tables(spark, sf_dir)[0]
    return _doubles(orders.select("system", "order_id", "customer_id", "status", "channel", "order_date", "delivery_date", "delivery_days", "units", "goods", "discount", "freight", "total", "discount_absent", "delivery_undated", "delivery_too_early", "freight_negative", "effective"))


CONFORMED_SQL = f"""WITH {BASE_SQL}
SELECT system, order_id, customer_id, status, channel, order_date, delivery_date, delivery_days, units::BIGINT AS units, goods / 10000.0 AS goods, discount / 10000.0 AS discount, freight / 10000.0 AS freight, total / 10000.0 AS total,
  discount_absent, delivery_undated, delivery_too_early, freight < 0 AS freight_negative, effective FROM facts"""


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: target and fourteen point-in-time features of each customer."""
    orders, items, products, tickets = star_tables(spark, sf_dir)
    return _doubles(feat.features(orders, items, products, tickets, CUT).join(feat.target(orders, CUT, END), "customer_id"))


def _features_sql(facts: str = "facts", tickets: str = "tickets", name: str = "f") -> str:
    """Features by the definitions, from each customer's list of orders: an oracle of its own, not the plan's aggregates."""
    pick = lambda field, test="true": f"list_transform(list_filter(kept, lambda o: {test}), lambda o: o.{field})"
    total = lambda field: f"coalesce(list_sum({pick(field)}), 0)::HUGEINT"
    seen = f"o.delivered <= DATE '{CUT}' AND o.days IS NOT NULL"
    return f"""
{name}_brands AS (SELECT order_id, list(p_brand) FILTER (p_size <= 45) AS brands FROM items JOIN part ON p_partkey = product_id GROUP BY order_id),
{name}_lists AS (
  SELECT customer_id, list(struct_pack(day := order_date, good := effective, money := total, goods := goods, less := discount, delivered := delivery_date, days := delivery_days, channel := channel, source := system, brands := coalesce(brands, []))) AS placed
  FROM {facts} LEFT JOIN {name}_brands USING (order_id) WHERE order_date <= DATE '{CUT}' GROUP BY customer_id),
{name}_kept AS (SELECT customer_id, len(placed) AS n, list_filter(placed, lambda o: o.good) AS kept FROM {name}_lists),
{name}_calls AS (SELECT customer_id, list(rating) AS marks FROM {tickets} WHERE opened <= DATE '{CUT}' GROUP BY customer_id),
{name}_sums AS (
  SELECT customer_id, n, kept, len(kept) AS good, {total("money")} AS money, {total("goods")} AS goods, {total("less")} AS less, {pick("days", seen)} AS waits, list_sort(list_distinct({pick("channel")})) AS channels,
    coalesce(marks, []) AS marks, list_filter(coalesce(marks, []), lambda m: m BETWEEN 1 AND 5) AS rated
  FROM {name}_kept LEFT JOIN {name}_calls USING (customer_id)),
{name} AS (
  SELECT customer_id, (DATE '{CUT}' - list_max({pick("day")}))::BIGINT AS recency_days, good AS frequency, {_half_up("money", "100")} / 100.0 AS monetary,
    CASE WHEN good > 0 THEN {_half_up("money", "100 * good")} / 100.0 END AS mean_ticket, len({pick("day", f"o.day + 90 > DATE '{CUT}'")}) AS orders_last_90d, {_half_up("10000 * (n - good)", "n")} / 10000.0 AS cancel_rate,
    CASE WHEN goods > 0 THEN {_half_up("10000 * less", "goods")} / 10000.0 END AS discount_rate, CASE WHEN len(waits) > 0 THEN {_half_up("100 * list_sum(waits)", "len(waits)")} / 100.0 END AS mean_delivery_days,
    len(list_distinct(flatten({pick("brands")}))) AS n_categories,
    channels[list_position(list_transform(channels, lambda c: len(list_filter(kept, lambda o: o.channel = c))), list_max(list_transform(channels, lambda c: len(list_filter(kept, lambda o: o.channel = c)))))] AS main_channel,
    (len(list_distinct({pick("source")})) = 2)::BIGINT AS both_systems, (DATE '{CUT}' - list_min({pick("day")}))::BIGINT AS tenure_days, len(marks) AS n_tickets,
    CASE WHEN len(rated) > 0 THEN {_half_up("100 * list_sum(rated)", "len(rated)")} / 100.0 END AS mean_rating
  FROM {name}_sums)"""


TARGET_SQL = f"""target AS (SELECT customer_id, (customer_id IN (SELECT customer_id FROM facts WHERE order_date > DATE '{CUT}' AND order_date <= DATE '{END}' AND effective))::BIGINT AS y FROM (SELECT DISTINCT customer_id FROM facts WHERE order_date <= DATE '{CUT}'))"""
FEATURES_SQL = f"WITH {BASE_SQL}, {_features_sql()}, {TARGET_SQL} SELECT * FROM f JOIN target USING (customer_id)"


def leakage_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features on the warehouse against those on its snapshot at the cut, of which none may differ; and, as a control,
    against a warehouse whose later orders are dated at the cut, where they must."""
    orders, items, products, tickets = star_tables(spark, sf_dir)
    # the lines are gone through once: orders carry the categories of their lines
    tasks = tasks_for_rows(spark, table(spark, sf_dir, "lineitem").count())
    orders = saved(feat.with_levels(orders, items, products), "orders", tasks)
    right = saved(feat.features(orders, items, products, tickets, CUT), "features")
    then = feat.as_of(orders, items, tickets, CUT)
    leaking = orders.withColumn("order_date", F.least("order_date", feat.day(CUT)))
    proof = feat.differences(right, feat.features(then[0], then[1], products, then[2], CUT), "customer_id", feat.FEATURES)
    control = feat.differences(right, feat.features(leaking, items, products, tickets, CUT), "customer_id", feat.FEATURES)
    return proof.select(F.lit("snapshot").alias("against"), "*").unionByName(control.select(F.lit("leaking copy").alias("against"), "*"))


def _differences_sql(label: str, a: str, b: str) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS against, '{c}' AS feature, count(*) FILTER ({a}.customer_id IS NULL OR {b}.customer_id IS NULL OR {a}.{c} IS DISTINCT FROM {b}.{c}) AS n_different FROM {a} FULL JOIN {b} ON {a}.customer_id = {b}.customer_id" for c in feat.FEATURES)


LEAKAGE_SQL = f"""WITH {BASE_SQL}, {_features_sql()},
then_facts AS (SELECT * REPLACE (CASE WHEN delivery_date <= DATE '{CUT}' THEN delivery_date END AS delivery_date, CASE WHEN delivery_date <= DATE '{CUT}' THEN delivery_days END AS delivery_days) FROM facts WHERE order_date <= DATE '{CUT}'),
then_tickets AS (SELECT * FROM tickets WHERE opened <= DATE '{CUT}'), {_features_sql("then_facts", "then_tickets", "g")},
leaking AS (SELECT * REPLACE (least(order_date, DATE '{CUT}') AS order_date) FROM facts), {_features_sql("leaking", "tickets", "h")}
{_differences_sql("snapshot", "f", "g")} UNION ALL {_differences_sql("leaking copy", "f", "h")}"""


def leaky_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency and frequency with and without the cut, and how far they lie apart."""
    orders, items, products, tickets = star_tables(spark, sf_dir)
    right = feat.features(orders, items, products, tickets, CUT).select("customer_id", "recency_days", "frequency")
    return _doubles(right.join(feat.leaky(orders, CUT), "customer_id", "left").withColumn("changed", ~F.col("recency_days").eqNullSafe(F.col("recency_days_leaky"))))


LEAKY_SQL = f"""WITH {BASE_SQL}, {_features_sql()},
l AS (SELECT customer_id, (DATE '{CUT}' - max(order_date))::BIGINT AS recency_days_leaky, count(*) AS frequency_leaky FROM facts WHERE effective GROUP BY 1)
SELECT customer_id, recency_days, frequency, recency_days_leaky, frequency_leaky, recency_days IS DISTINCT FROM recency_days_leaky AS changed FROM f LEFT JOIN l USING (customer_id)"""


def label_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by local days and by the days of a clock three hours ahead, as instants near midnight have them."""
    orders = star_tables(spark, sf_dir)[0]
    shifted = orders.withColumn("utc_date", F.when(F.col("order_id") % 8 == 0, F.date_add("order_date", 1)).otherwise(F.col("order_date")))
    return _doubles(feat.label_flips(shifted, "utc_date", CUT, END))


def _target_sql(day: str) -> str:
    return f"SELECT customer_id, max(({day} > DATE '{CUT}' AND {day} <= DATE '{END}' AND effective)::BIGINT) AS y FROM facts GROUP BY 1 HAVING bool_or({day} <= DATE '{CUT}')"


FLIPS_SQL = f"""WITH {BASE_SQL}, a AS ({_target_sql("order_date")}), b AS ({_target_sql("(CASE WHEN order_id % 8 = 0 THEN order_date + 1 ELSE order_date END)")})
SELECT a.y AS y_first, b.y AS y_second, count(*) AS n_customers FROM a FULL JOIN b USING (customer_id) GROUP BY 1, 2"""


def fact_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.fact_order(raw_orders(spark, sf_dir).select("system", "order_id"))


KEYS_SQL = f"WITH {BASE_SQL} SELECT system, order_id, row_number() OVER (ORDER BY CASE WHEN system = 'LEGADO' THEN 0 ELSE 1 END, order_id) AS order_key FROM raw"


def quarantined_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = star_tables(spark, sf_dir)[1]
    return star.quarantine(items).select("system", "item_id", "order_id", "product_id", F.col("quantity").cast("long").alias("quantity"), "reason")


QUARANTINE_SQL = f"WITH {BASE_SQL} SELECT system, item_id, order_id, product_id, quantity, 'PEDIDO_INEXISTENTE_NA_ORIGEM' AS reason FROM items WHERE NOT order_exists"


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded totals against totals of the raw tables by the same formula, and against the raw discounts as they stand,
    whose -1 for "none" makes a false difference."""
    raw = raw_orders(spark, sf_dir)
    lines = raw_items(spark, sf_dir).join(raw.select("system", "order_id"), ["system", "order_id"], "left_semi")
    goods = F.sum(F.col("quantity") * F.col("unit_price"))
    source = lines.groupBy("system").agg((goods - F.sum(F.greatest("discount", F.lit(0)))).alias("mended"), (goods - F.sum("discount")).alias("as_is"))
    freight = raw.groupBy("system").agg(F.sum("freight").alias("freight"))
    totals = source.join(freight, "system").select("system", (F.col("mended") + F.col("freight")).alias("source_total"), (F.col("as_is") + F.col("freight")).alias("raw_total"))
    out = star.reconcile(star_tables(spark, sf_dir)[0], totals).withColumn("false_difference", F.col("loaded_total") - F.col("raw_total"))
    return _doubles(out.drop("relative"))


RECONCILIATION_SQL = f"""WITH {BASE_SQL},
l AS (SELECT {SYSTEM.format(k="l_orderkey")} AS system, l_quantity::BIGINT * floor(l_extendedprice * 100 / l_quantity)::BIGINT AS cents, floor(l_discount * 100 + 0.5)::BIGINT AS rate, l_linenumber = 7 AND l_orderkey % 10 = 0 AS none
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 <> 7)),
s AS (SELECT system, sum(cents * 100) - sum(CASE WHEN none THEN 0 ELSE cents * rate END) AS mended, sum(cents * 100) - sum(CASE WHEN none THEN -10000 ELSE cents * rate END) AS as_is FROM l GROUP BY 1),
o AS (SELECT {SYSTEM.format(k="o_orderkey")} AS system, sum((o_orderkey % 25 - 1) * 10000) AS freight FROM orders WHERE o_orderkey % 40 <> 7 GROUP BY 1),
d AS (SELECT system, sum(total) AS loaded, count(*) AS n FROM facts GROUP BY 1)
SELECT system, loaded / 10000.0 AS loaded_total, n AS n_orders, (mended + freight) / 10000.0 AS source_total, (as_is + freight) / 10000.0 AS raw_total, (loaded - mended - freight) / 10000.0 AS difference, (loaded - as_is - freight) / 10000.0 AS false_difference
FROM d JOIN s USING (system) JOIN o USING (system)"""


def formula_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which formula gives the total: shares in total, by status, channel and year."""
    orders = star_tables(spark, sf_dir)[0].withColumn("year", F.year("order_date"))
    goods, discount, freight = F.col("goods"), F.col("discount"), F.col("freight")
    return diagnostics.formula_shares(orders, F.col("total"), {"h1_goods": goods, "h2_less_discount": goods - discount, "h3_with_freight": goods - discount + freight, "h4_freight_only": goods + freight}, ["status", "channel", "year"])


FORMULA_SQL = f"""WITH {BASE_SQL}, m AS (SELECT *, year(order_date) AS year FROM facts)
SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(channel) = 0 THEN 'channel' WHEN grouping(year) = 0 THEN 'year' ELSE 'total' END AS cut,
  CASE WHEN grouping(status) = 0 THEN status WHEN grouping(channel) = 0 THEN channel WHEN grouping(year) = 0 THEN year::VARCHAR ELSE '' END AS value, count(*) AS n,
  count(*) FILTER (abs(total - goods) <= 100) AS h1_goods, count(*) FILTER (abs(total - goods + discount) <= 100) AS h2_less_discount, count(*) FILTER (abs(total - goods + discount - freight) <= 100) AS h3_with_freight, count(*) FILTER (abs(total - goods - freight) <= 100) AS h4_freight_only
FROM m GROUP BY GROUPING SETS ((), (status), (channel), (year))"""


def anomaly_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = star_tables(spark, sf_dir)[0]
    return diagnostics.anomalies(
        orders,
        {
            "delivery_undated": F.col("delivery_undated"),
            "delivery_too_early": F.col("delivery_too_early"),
            "freight_negative": F.col("freight_negative"),
            "discount_absent": F.col("discount_absent"),
            "no_items": F.col("units") == 0,
            "slow_delivery": (F.col("delivery_days") > 35, (F.col("delivery_days") > 35) | F.col("delivery_undated")),
        },
    )


ANOMALIES_SQL = f"""WITH {BASE_SQL}
SELECT unnest(['delivery_undated', 'delivery_too_early', 'freight_negative', 'discount_absent', 'no_items', 'slow_delivery']) AS anomaly,
  unnest([count(*) FILTER (delivery_undated), count(*) FILTER (delivery_too_early), count(*) FILTER (freight < 0), count(*) FILTER (discount_absent), count(*) FILTER (units = 0), count(*) FILTER (delivery_days > 35)]) AS lower,
  unnest([count(*) FILTER (delivery_undated), count(*) FILTER (delivery_too_early), count(*) FILTER (freight < 0), count(*) FILTER (discount_absent), count(*) FILTER (units = 0), count(*) FILTER (delivery_days > 35 OR delivery_undated)]) AS upper,
  unnest([count(*), count(*), count(*), count(*), count(*), count(*)]) AS base FROM facts"""


def assertion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load's assertions: keys, domains, orphans, cardinality, conservation."""
    orders, items, products, _ = star_tables(spark, sf_dir)
    raw = raw_orders(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return (
        Suite(spark, "load")
        .unique(orders, "one row an order", "system", "order_id")
        .domain(orders, "status is known", "status", ["ENTREGUE", "EM_TRANSITO", "EM_PROCESSAMENTO", "CANCELADO"])
        .no_nulls(orders, "channel is known", "channel")
        .no_orphans(orders, customers, "customer exists", ["customer_id"])
        .no_more_rows(orders, raw, "joins do not multiply")
        .equal(items, "lines without an order", F.count_if(~F.col("order_exists")), 0)
        .at_least(orders, "orders loaded", F.count("*"), 1)
        .between(orders, "cancelled percent", F.floor(100 * F.avg((~F.col("effective")).cast("int"))), 0, 50)
        .results()
    )


ASSERTIONS_SQL = f"""WITH {BASE_SQL}, v AS (
  SELECT 'one row an order' AS name, (SELECT count(*) - count(DISTINCT (system, order_id)) FROM facts)::DOUBLE AS value, 0 AS low, 0 AS high, '= 0' AS expected
  UNION ALL SELECT 'status is known', (SELECT count(*) FROM facts WHERE NOT coalesce(list_contains(['ENTREGUE', 'EM_TRANSITO', 'EM_PROCESSAMENTO', 'CANCELADO'], status), false)), 0, 0, '= 0'
  UNION ALL SELECT 'channel is known', (SELECT count(*) - count(channel) FROM facts), 0, 0, '= 0'
  UNION ALL SELECT 'customer exists', (SELECT count(*) FROM facts WHERE customer_id NOT IN (SELECT c_custkey FROM customer)), 0, 0, '= 0'
  UNION ALL SELECT 'joins do not multiply', (SELECT greatest((SELECT count(*) FROM facts) - (SELECT count(*) FROM orders WHERE o_orderkey % 40 <> 7), 0)), 0, 0, '= 0'
  UNION ALL SELECT 'lines without an order', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 40 <> 7)), 0, 0, '= 0'
  UNION ALL SELECT 'orders loaded', (SELECT count(*) FROM facts), 1, NULL, '>= 1'
  UNION ALL SELECT 'cancelled percent', (SELECT floor(100 * avg((NOT effective)::INT)) FROM facts), 0, 50, '0..50')
SELECT 'load' AS stage, name, value >= low AND value <= coalesce(high, value) AS passed, value, expected FROM v"""


def column_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-column counts and sums of raw and conformed lines: all are equal but the discounts, whose -1 became 0."""
    columns = ["item_id", "order_id", "quantity", "discount", "system"]
    return _doubles(parity(raw_items(spark, sf_dir).select(*columns), star_tables(spark, sf_dir)[1].select(*columns)))


PARITY_SQL = f"""WITH {BASE_SQL},
a AS (SELECT count(*) AS n, sum(l_orderkey * 10 + l_linenumber)::DOUBLE AS i, sum(l_orderkey)::DOUBLE AS o, sum(l_quantity)::DOUBLE AS q, sum(CASE WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN -10000 ELSE l_quantity::BIGINT * floor(l_extendedprice * 100 / l_quantity)::BIGINT * floor(l_discount * 100 + 0.5)::BIGINT END) / 10000.0 AS d FROM lineitem),
b AS (SELECT count(*) AS n, sum(item_id)::DOUBLE AS i, sum(order_id)::DOUBLE AS o, sum(quantity)::DOUBLE AS q, sum(discount) / 10000.0 AS d FROM items),
u AS (SELECT unnest(['item_id', 'order_id', 'quantity', 'discount', 'system']) AS "column", a.n AS n_left, unnest([a.i, a.o, a.q, a.d, NULL]) AS total_left, b.n AS n_right, unnest([b.i, b.o, b.q, b.d, NULL]) AS total_right FROM a, b)
SELECT *, n_left = n_right AND total_left IS NOT DISTINCT FROM total_right AS equal FROM u"""


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.profile(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    return _doubles(out.withColumn("mean", F.round("mean", 4)))


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, 100.0 * (count(*) - count({c})) / count(*) AS percent_null, {f'count(*) FILTER (trim({c}) = $$$$)' if t else '0'} AS n_blank, count(DISTINCT {c}) AS n_distinct, "
    + ("NULL::DOUBLE AS least, NULL::DOUBLE AS greatest, NULL::DOUBLE AS mean, NULL::BIGINT AS n_negative, " + f"min(length({c})) AS shortest, max(length({c})) AS longest" if t else f"min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, round(avg({c}::DOUBLE), 4) AS mean, count(*) FILTER ({c} < 0) AS n_negative, NULL::BIGINT AS shortest, NULL::BIGINT AS longest")
    + " FROM customer"
    for c, t in (("c_custkey", False), ("c_name", True), ("c_acctbal", False), ("c_mktsegment", True))
)


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return profile.fingerprint(rows).select("n_rows", F.col("hash_sum").cast("string").alias("hash_sum"))


FINGERPRINT_SQL = """SELECT count(*) AS n_rows, sum(('0x' || substr(md5('v' || n_nationkey || chr(31) || 'v' || n_name || chr(31) || 'v' || n_regionkey), 1, 15))::BIGINT)::VARCHAR AS hash_sum FROM nation"""


def people_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of two systems, four to a person: tax ids are missing, invalid or another person's, names are
    spelled in two ways, e-mails and phones differ in some, and rows differ in completeness."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    k, person = F.col("k"), F.floor(F.col("k") / 4).cast("long")
    owner = F.when(person % 13 == 0, person + 1).otherwise(person)
    eleven = generator.with_check_digits(F.lpad((owner * 7919 + 10000).cast("string"), 9, "0"), person % 5 != 0)
    return c.select(
        k.alias("node"),
        F.when(k % 4 < 2, "L").otherwise("E").alias("system"),
        (k * 7 % 1000003).alias("source_id"),
        F.concat(F.when(k % 2 == 0, " José  da ").otherwise("JOSE DA "), F.lit("Silva "), person.cast("string"), F.when(k % 4 == 3, " ").otherwise("")).alias("name"),
        F.when(k % 7 != 0, eleven).alias("tax_id"),
        F.when(k % 9 != 0, F.concat(F.when(k % 2 == 0, " P").otherwise("p"), person.cast("string"), F.when(k % 8 == 5, "b").otherwise(""), F.lit("@Example.com"))).alias("email"),
        F.when(k % 12 != 4, F.concat(F.lit("(81) 9"), person.cast("string"))).alias("phone"),
        F.when(k % 5 == 0, "N/A").when(k % 5 != 1, F.concat(F.lit("C"), (k % 3).cast("string"))).alias("city"),
        F.when(k % 11 != 0, F.col("c_nationkey").cast("string")).alias("region"),
        F.date_add(F.lit("2023-01-01").cast("date"), (k % 100).cast("int")).alias("signed_up"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of two systems' records: dense key, golden values, tax id or conflict, and the rules that joined them."""
    gold, _ = identity.persons(people_records(spark, sf_dir))
    return _doubles(gold.select("person_key", "person", "n_legacy", "n_shop", "legacy_id", "shop_id", "origin", "rules", "tax", "tax_valid", "name", "city", "region", "first_signed_up", "tax_conflict"))


def people_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's person and role."""
    return _doubles(identity.resolve(people_records(spark, sf_dir))[1].select("node", "person_key", "role", "system_role"))


def people_tax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable tax ids of each person."""
    return identity.resolve(people_records(spark, sf_dir))[2]


def _digits_sql(x: str, n: int) -> str:
    return "((" + " + ".join(f"substr({x}, {i + 1}, 1)::INT * {n + 1 - i}" for i in range(n)) + ") * 10 % 11 % 10)"


PEOPLE_BASE_SQL = f"""RECURSIVE b AS (
  SELECT c_custkey AS k, c_custkey // 4 AS p0, c_custkey // 4 + (c_custkey // 4 % 13 = 0)::INT AS owner, c_nationkey FROM customer),
nine AS (SELECT *, lpad((owner * 7919 + 10000)::VARCHAR, 9, '0') AS nine FROM b),
ten AS (SELECT *, nine || {_digits_sql("nine", 9)} AS ten FROM nine),
k AS (
  SELECT k AS node, CASE WHEN k % 4 < 2 THEN 'L' ELSE 'E' END AS system, k * 7 % 1000003 AS source_id, p0 % 5 <> 0 AND k % 7 <> 0 AS ok,
    CASE WHEN k % 7 <> 0 THEN ten || ({_digits_sql("ten", 10)} + (p0 % 5 = 0)::INT) % 10 END AS tax, 'JOSE DA SILVA ' || p0 AS folded,
    CASE WHEN k % 2 = 0 THEN ' José  da ' ELSE 'JOSE DA ' END || 'Silva ' || p0 || CASE WHEN k % 4 = 3 THEN ' ' ELSE '' END AS name,
    CASE WHEN k % 9 <> 0 THEN 'p' || p0 || CASE WHEN k % 8 = 5 THEN 'b' ELSE '' END || '@example.com' END AS email, CASE WHEN k % 12 <> 4 THEN '819' || p0 END AS phone,
    CASE WHEN k % 5 > 1 THEN 'C' || (k % 3) END AS city, CASE WHEN k % 11 <> 0 THEN c_nationkey::VARCHAR END AS region, DATE '2023-01-01' + (k % 100)::INT AS signed_up
  FROM ten),
e AS (
  SELECT min(node) OVER (PARTITION BY tax, folded) AS a, node AS b, 'CPF_VALIDO_NOME' AS rule FROM k WHERE ok
  UNION ALL SELECT min(node) OVER (PARTITION BY tax, folded, region), node, 'CPF_INVALIDO_NOME_UF' FROM k WHERE NOT ok AND tax IS NOT NULL
  UNION ALL SELECT min(node) OVER (PARTITION BY folded, email, phone), node, 'DUPLICATA_LEGADO' FROM k WHERE system = 'L' AND email IS NOT NULL),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT node AS a, node AS c FROM k UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a),
p AS (SELECT a AS node, min(c) AS person FROM r GROUP BY 1),
ru AS (SELECT person, array_to_string(list_sort(list_distinct(list(rule))), '+') AS rules FROM e JOIN p ON p.node = e.b WHERE a <> b GROUP BY 1),
m AS (
  SELECT *, row_number() OVER (PARTITION BY person ORDER BY ok DESC, (tax IS NOT NULL)::INT + (city IS NOT NULL)::INT + (region IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (email IS NOT NULL)::INT DESC, source_id, node) AS place
  FROM (SELECT k.* REPLACE (coalesce(ok, false) AS ok), person FROM k JOIN p USING (node))),
gd AS (
  SELECT person, count(*) FILTER (system = 'L') AS n_legacy, count(*) FILTER (system = 'E') AS n_shop, arg_min(source_id, place) FILTER (system = 'L') AS legacy_id, min(source_id) FILTER (system = 'L') AS least_legacy, min(source_id) FILTER (system = 'E') AS shop_id,
    arg_min(name, (system = 'L', place)) AS name, arg_min(city, (system = 'L', place)) FILTER (city IS NOT NULL) AS city, arg_min(region, (system = 'L', place)) FILTER (region IS NOT NULL) AS region, min(signed_up) AS first_signed_up
  FROM m GROUP BY 1),
vt AS (SELECT person, arg_min(tax, (NOT good, -n, tax)) AS tax, arg_min(good, (NOT good, -n, tax)) AS good FROM (SELECT person, tax, bool_or(ok) AS good, count(*) AS n FROM m WHERE tax IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
cl AS (
  SELECT *, coalesce(good, false) AND count(*) FILTER (good) OVER (PARTITION BY tax) > 1 AS conflict, rank() OVER (PARTITION BY tax, good ORDER BY n_legacy + n_shop DESC) AS best, count(*) OVER (PARTITION BY tax, good, n_legacy + n_shop) AS peers
  FROM gd LEFT JOIN vt USING (person)),
gk AS (SELECT *, row_number() OVER (ORDER BY least_legacy IS NULL, coalesce(least_legacy, shop_id), person) AS person_key, conflict AND NOT (best = 1 AND peers = 1) AS lost FROM cl)"""


PEOPLE_SQL = f"""WITH {PEOPLE_BASE_SQL}
SELECT person_key, person, n_legacy, n_shop, legacy_id, shop_id, CASE WHEN n_legacy > 0 AND n_shop > 0 THEN 'AMBOS' WHEN n_shop > 0 THEN 'ECOM' ELSE 'LEGADO' END AS origin, rules,
  CASE WHEN NOT lost THEN tax END AS tax, CASE WHEN NOT lost THEN good END AS tax_valid, name, city, region, first_signed_up, conflict AS tax_conflict FROM gk LEFT JOIN ru USING (person)"""
BRIDGE_SQL = f"""WITH {PEOPLE_BASE_SQL}
SELECT node, person_key, CASE WHEN place = 1 THEN 'SOBREVIVENTE' ELSE 'ABSORVIDO' END AS role, CASE WHEN source_id = CASE WHEN system = 'E' THEN shop_id ELSE legacy_id END THEN 'SOBREVIVENTE' ELSE 'ABSORVIDO' END AS system_role FROM m JOIN gk USING (person)"""
TAX_IDS_SQL = f"WITH {PEOPLE_BASE_SQL} SELECT DISTINCT person_key, m.tax, ok AS tax_valid FROM m JOIN gk USING (person) WHERE m.tax IS NOT NULL"


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Univariate AUC of numeric features against the target, on the training rows of an exact stratified split."""
    names = ["recency_days", "frequency", "orders_last_90d", "tenure_days", "n_categories"]
    # saved once: ranges sample their input before they deal it, and only keys and labels are ranged
    tasks = tasks_for_rows(spark, table(spark, sf_dir, "lineitem").count())
    base = saved(customer_features(spark, sf_dir).select("customer_id", "y", *names), "base", tasks)
    split = models.stratified_split(base.select("customer_id", "y"), "customer_id", "y").where("train")
    return models.univariate_auc(base.join(split.select("customer_id"), "customer_id", "left_semi"), names, "y")


MODEL_SQL = f"""WITH {BASE_SQL}, {_features_sql()}, {TARGET_SQL},
b AS (SELECT * FROM f JOIN target USING (customer_id)),
sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('0|' || customer_id), 1, 15))::BIGINT, customer_id) <= ceil(count(*) OVER (PARTITION BY y) * 0.7) AS train FROM b),
l AS (SELECT y, unnest(['recency_days', 'frequency', 'orders_last_90d', 'tenure_days', 'n_categories']) AS feature, unnest([recency_days, frequency, orders_last_90d, tenure_days, n_categories])::DOUBLE AS v FROM sp WHERE train),
r AS (SELECT feature, y, 2 * rank() OVER w + count(*) OVER (PARTITION BY feature, v) - 1 AS twice FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY v)),
a AS (SELECT feature, (sum(twice) FILTER (y = 1) - sum(y) * (sum(y) + 1))::DOUBLE / (2 * sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM r GROUP BY 1)
SELECT feature, greatest(auc, 1 - auc) AS auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM a"""


def naive_bayes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of the binned naive Bayes on the rows left out of training."""
    whole = saved(customer_features(spark, sf_dir), "base")
    split = models.stratified_split(whole.select("customer_id", "y"), "customer_id", "y")
    base = saved(whole.join(split.select("customer_id", "train"), "customer_id"), "abt")
    names = ["recency_days", "frequency", "orders_last_90d", "tenure_days"]
    columns = {c: models.binned(c, models.cuts(base.where("train"), c)) for c in names} | {"main_channel": F.col("main_channel")}
    model = models.naive_bayes(base.where("train"), columns, "y")
    test = base.where("NOT train")
    scored = models.bayes_scores(test, model, columns, "customer_id").join(test.select("customer_id", "y"), "customer_id")
    return models.confusion(scored, "score", "y")


def _bayes_sql() -> str:
    """Cuts, weights and scores of the binned naive Bayes, by value counts."""
    names = ["recency_days", "frequency", "orders_last_90d", "tenure_days"]
    long = "unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS feature, unnest([" + ", ".join(f"{n}::DOUBLE" for n in names) + "]) AS v"
    return f"""
b AS (SELECT * FROM f JOIN target USING (customer_id)),
sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('0|' || customer_id), 1, 15))::BIGINT, customer_id) <= ceil(count(*) OVER (PARTITION BY y) * 0.7) AS train FROM b),
lo AS (SELECT customer_id, y, train, {long} FROM sp),
vc AS (SELECT feature, v, sum(count(*)) OVER w AS upto, sum(count(*)) OVER (PARTITION BY feature) AS n, lead(v) OVER w AS after FROM lo WHERE train AND v IS NOT NULL GROUP BY feature, v WINDOW w AS (PARTITION BY feature ORDER BY v)),
ct AS (SELECT DISTINCT feature, (arg_min(v, v) + arg_min(after, v)) / 2 AS cut FROM (SELECT feature, v, after, k FROM vc, range(1, 4) t(k) WHERE upto * 4 >= n * k) GROUP BY feature, k HAVING arg_min(after, v) IS NOT NULL),
dv AS (
  SELECT customer_id, y, train, lo.feature, (SELECT count(*) FROM ct WHERE ct.feature = lo.feature AND lo.v > cut)::VARCHAR AS value FROM lo WHERE v IS NOT NULL
  UNION ALL SELECT customer_id, y, train, 'main_channel', main_channel FROM sp WHERE main_channel IS NOT NULL),
pr AS (SELECT ln((sum(y) + 1) / (count(*) - sum(y) + 1)) AS prior FROM sp WHERE train),
wt AS (SELECT feature, value, ln((sum(y) + 1) / (count(*) - sum(y) + 1)) - (SELECT prior FROM pr) AS weight FROM dv WHERE train GROUP BY 1, 2),
sc AS (SELECT sp.customer_id, y, coalesce(s, 0) + prior > 0 AS said FROM sp LEFT JOIN (SELECT customer_id, sum(weight) AS s FROM dv JOIN wt USING (feature, value) GROUP BY 1) USING (customer_id), pr WHERE NOT train),
cf AS (SELECT count(*) FILTER (NOT said AND y = 0) AS tn, count(*) FILTER (said AND y = 0) AS fp, count(*) FILTER (NOT said AND y = 1) AS fn, count(*) FILTER (said AND y = 1) AS tp FROM sc)"""


BAYES_SQL = f"""WITH {BASE_SQL}, {_features_sql()}, {TARGET_SQL}, {_bayes_sql()}
SELECT tn, fp, fn, tp, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy FROM cf"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions over part and customer names."""
    p = table(spark, sf_dir, "part").withColumn("n", F.concat(F.lit("  Ção "), F.col("p_name"), F.lit("  é ")))
    return p.select(
        "p_partkey", text.fold_name(F.col("n")).alias("folded"), text.ascii_label(F.col("n")).alias("label"), text.shape_mask(F.col("p_brand")).alias("shape"), text.digits(F.col("p_brand")).alias("digits"), text.part(F.col("p_name"), " ", 2).alias("second"),
        text.tax_id_valid(F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("tax_ok"),
    )


TEXT_SQL = f"""SELECT p_partkey, 'CAO ' || upper(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) || ' E' AS folded, 'cao ' || lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) || ' e' AS label, regexp_replace(regexp_replace(p_brand, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape,
  regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, string_split(p_name, ' ')[2] AS second, x <> '00000000000' AND {_digits_sql("x", 9)} = substr(x, 10, 1)::INT AND {_digits_sql("x", 10)} = substr(x, 11, 1)::INT AS tax_ok
FROM (SELECT *, lpad(p_partkey::VARCHAR, 11, '0') AS x FROM part)"""


def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    local = dates.local_clock(F.col("ts"))
    instant, missing = dates.iso_instant(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select(
        "event_id", local.cast("date").alias("local_day"), (F.weekday(local) + 1).cast("long").alias("iso_weekday"), F.hour(local).cast("long").alias("local_hour"), F.date_format(local, "yyyy-MM").alias("month"),
        dates.day_month_year(F.date_format("ts", "dd/MM/yyyy")).alias("day"), missing.alias("missing"), F.unix_timestamp(instant).alias("instant"), dates.side_of(local.cast("date"), "2024-01-10", "2024-01-20").cast("long").alias("side"),
    )


DATES_SQL = """WITH x AS (SELECT event_id, ts, ts::TIMESTAMP - INTERVAL 3 HOUR AS l FROM events)
SELECT event_id, l::DATE AS local_day, isodow(l) AS iso_weekday, hour(l) AS local_hour, strftime(l, '%Y-%m') AS month, ts::DATE AS day, true AS missing, epoch(date_trunc('second', ts))::BIGINT + 10800 AS instant, CASE WHEN l::DATE <= DATE '2024-01-10' THEN 0 WHEN l::DATE <= DATE '2024-01-20' THEN 1 ELSE 2 END::BIGINT AS side FROM x"""


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of the calendar with the events of that day; days without any have none."""
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"))
    return _doubles(dates.calendar(spark).join(counts, "day", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0))))


CALENDAR_SQL = f"""SELECT d::DATE AS day, year(d) AS year, quarter(d) AS quarter, month(d) AS month, ({dates.MONTHS!r})[month(d)] AS month_name, day(d) AS day_of_month, isodow(d) AS iso_weekday, isodow(d) >= 6 AS weekend, coalesce(n, 0) AS n_events
FROM generate_series(DATE '2022-12-01', DATE '2026-03-31', INTERVAL 1 DAY) t(d) LEFT JOIN (SELECT ts::DATE AS e, count(*) AS n FROM events GROUP BY 1) ON e = d::DATE"""


def json_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, and types of values, of the events' properties."""
    v = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"), F.schema_of_variant(F.try_variant_get(F.parse_json("props"), "$.k", "variant")).alias("kind"), F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
    return v.groupBy("event_type", "key", "kind").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


JSON_SQL = """SELECT event_type, 'k' AS key, 'BIGINT' AS kind, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1"""


def unambiguous_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key is attached only where one candidate has it; several give null and a flag."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("-", F.col("c_nationkey"), F.col("c_mktsegment")).alias("k"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("-", F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")).alias("k"))
    owners = c.groupBy("k").agg(F.min("c_custkey").alias("least"), F.max("c_custkey").alias("greatest"))
    one, several = F.col("least") == F.col("greatest"), F.col("least") < F.col("greatest")
    return s.join(owners, "k", "left").select("s_suppkey", F.when(one, F.col("least")).alias("c_custkey"), F.coalesce(several, F.lit(False)).alias("ambiguous"))


OWNER_SQL = """WITH c AS (SELECT c_nationkey || '-' || c_mktsegment AS k, min(c_custkey) AS one, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)
SELECT s_suppkey, CASE WHEN n = 1 THEN one END AS c_custkey, coalesce(n > 1, false) AS ambiguous FROM supplier LEFT JOIN c ON k = s_nationkey || '-' || CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END"""


def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.key_overlap(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k")


OVERLAP_SQL = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events), i AS (SELECT count(*) AS n FROM a JOIN b USING (k)), x AS (SELECT count(*) AS n FROM a), y AS (SELECT count(*) AS n FROM b)
SELECT x.n AS n_left, y.n AS n_right, i.n AS n_both, x.n + y.n - 2 * i.n AS n_difference FROM i, x, y"""


def repeated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.repeats_in_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


REPEATED_SQL = "SELECT l_suppkey, count(*) AS n_items, sum(n - 1)::BIGINT AS n_surplus FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"


def price_to_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose price is over the median of their type by a fiftieth or more."""
    p = table(spark, sf_dir, "part")
    medians = quantiles.group_quantiles(p, ["p_type"], "p_retailprice", {"median": 0.5})
    return p.join(medians, "p_type").where("p_retailprice >= 1.02 * median").select("p_partkey", "p_type", "p_retailprice", "median")


MEDIAN_SQL = "SELECT p_partkey, p_type, p_retailprice, median FROM part JOIN (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY 1) USING (p_type) WHERE p_retailprice >= 1.02 * median"


def first_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, and whether more follow."""
    first = F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(first, (F.count("*") > 1).alias("repeated"))


FIRST_SQL = "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) > 1 AS repeated FROM events GROUP BY 1, 2"


def channel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by channel, before and after the middle of 1998, with each channel's share of its side."""
    orders = star_tables(spark, sf_dir)[0].withColumn("side", F.when(F.col("order_date") < "1998-07-01", "before").otherwise("after"))
    wide = orders.groupBy("channel").pivot("side", ["before", "after"]).agg(F.count(F.lit(1)))
    return wide.select("channel", "before", "after", (F.col("before") / F.sum("before").over(W.partitionBy())).alias("share_before"))


PIVOT_SQL = f"""WITH {BASE_SQL}, w AS (SELECT channel, count(*) FILTER (order_date < DATE '1998-07-01') AS before, count(*) FILTER (order_date >= DATE '1998-07-01') AS after FROM facts GROUP BY 1)
SELECT channel, before, after, before / sum(before) OVER () AS share_before FROM w"""


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's windowed counts, run on the whole table as a batch."""
    from .streaming.events import windowed

    return windowed(table(spark, sf_dir, "events")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


WINDOWS_SQL = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def in_order_or_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join with an OR residual: parts sold by the supplier of the same key, or in bulk."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return part.join(line, (part.p_partkey == line.l_partkey) & ((line.l_suppkey == part.p_size) | (line.l_quantity >= 49)), "left_semi").select("p_partkey", "p_size")


SEMI_SQL = "SELECT p_partkey, p_size FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND (l_suppkey = p_size OR l_quantity >= 49))"


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by mean and population deviation; reported to four places."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return feat.z_scores(c, "c_acctbal").select("c_custkey", F.round("z", 4).alias("z"))


def fold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping that ignores case and accents by collation."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("s"), "c_acctbal")
    return c.groupBy(F.collate("s", "UNICODE_CI_AI").alias("s")).agg(F.count("*").alias("n")).select(F.upper(F.collate("s", "UTF8_BINARY")).alias("segment"), "n")


FOLD_SQL = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"


def category_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts as a left join to an aggregate: nations and customers of each region."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    counts = n.join(c.groupBy("c_nationkey").agg(F.count("*").alias("k")), n.n_nationkey == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.count("*").alias("n_nations"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_customers"))
    return r.join(counts, r.r_regionkey == counts.n_regionkey, "left").select("r_name", F.coalesce("n_nations", F.lit(0)).alias("n_nations"), F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


CHILDREN_SQL = "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_nations, (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = r_regionkey) AS n_customers FROM region"


def top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "part"), "p_brand", 3)


TOP_SQL = "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 3"


def dense_customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return keys.dense_keys(c, [F.desc("c_acctbal"), F.col("c_custkey").asc()], "place").select("c_custkey", "place")


DENSE_SQL = "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer"

#: Query, its SQL or None.
ALL = {
    conformed_orders: CONFORMED_SQL, customer_features: FEATURES_SQL, leakage_proof: LEAKAGE_SQL, leaky_features: LEAKY_SQL, label_flips: FLIPS_SQL, fact_order_keys: KEYS_SQL, quarantined_items: QUARANTINE_SQL, reconciliation: RECONCILIATION_SQL,
    formula_hypotheses: FORMULA_SQL, anomaly_catalogue: ANOMALIES_SQL, assertion_log: ASSERTIONS_SQL, column_parity: PARITY_SQL, column_profile: PROFILE_SQL, table_fingerprint: FINGERPRINT_SQL, people: PEOPLE_SQL, people_bridge: BRIDGE_SQL, people_tax_ids: TAX_IDS_SQL, model_report: MODEL_SQL,
    naive_bayes_report: BAYES_SQL, text_rules: TEXT_SQL, date_rules: DATES_SQL, calendar_days: CALENDAR_SQL, json_census: JSON_SQL, unambiguous_owner: OWNER_SQL, key_overlap: OVERLAP_SQL, repeated_products: REPEATED_SQL, price_to_median: MEDIAN_SQL,
    first_of_repeats: FIRST_SQL, channel_pivot: PIVOT_SQL, daily_windows: WINDOWS_SQL, in_order_or_other: SEMI_SQL, z_scores: "SELECT c_custkey, round(round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6), 4) AS z FROM customer",
    fold_groups: FOLD_SQL, category_children: CHILDREN_SQL, top_brands: TOP_SQL, dense_customer_keys: DENSE_SQL,
}
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {f.__name__: sql for f, sql in ALL.items() if sql}
