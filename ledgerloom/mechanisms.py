"""Queries of the joins along time, of exact quantiles and of the other operators with a mechanism of their own, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hash_tree, identity, identity_updates, models, quantiles, sketches, temporal, tree
from .plans import metrics, reload, star
from .plans.metrics import Metric, rows_that
from .queries import BASE_SQL, CUT, END, PEOPLE_BASE_SQL, _doubles, customer_features, people_records, raw_items, raw_orders, star_tables, table
from .storage import saved, scratch_path

#: Events stand for tickets of the retail years; an order is near a ticket for so many days.
SHIFT, NEAR = 8766, 365


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ticket_id"), F.col("user_id").alias("customer_id"), F.date_sub(F.to_date("ts"), SHIFT).alias("opened"))


def ticket_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticket with its customer's last order up to that day, if it is at most a year old."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("buyer"), F.to_date("o_orderdate").alias("placed"), F.col("o_orderkey").alias("order_id"))
    out = temporal.asof(tickets(spark, sf_dir), orders, [("customer_id", "buyer")], "opened", "placed", {"last_order": "order_id", "placed": "placed"}, since=lambda t: F.date_sub(t, NEAR))
    return out.withColumn("days_since", F.datediff("opened", "placed").cast("long"))


LAST_ORDER_SQL = f"""WITH t AS (SELECT event_id AS ticket_id, user_id AS customer_id, ts::DATE - {SHIFT} AS opened FROM events),
m AS (SELECT ticket_id, max((o_orderdate, o_orderkey)) AS o FROM t JOIN orders ON o_custkey = customer_id AND o_orderdate::DATE <= opened GROUP BY 1)
SELECT t.*, CASE WHEN o[1]::DATE >= opened - {NEAR} THEN o[2] END AS last_order, CASE WHEN o[1]::DATE >= opened - {NEAR} THEN o[1]::DATE END AS placed, CASE WHEN o[1]::DATE >= opened - {NEAR} THEN opened - o[1]::DATE END AS days_since
FROM t LEFT JOIN m USING (ticket_id)"""


def part_shipping_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the same part that was shipped last before each line (not on its day), and the days between them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey"), F.to_date("l_shipdate").alias("shipped"), "l_quantity")
    out = temporal.asof(lines.select("l_orderkey", "l_linenumber", "l_partkey", "shipped"), lines, [("l_partkey", "l_partkey")], "shipped", "shipped", {"before": "shipped", "quantity_before": "l_quantity"}, inclusive=False)
    gap = F.datediff("shipped", "before").cast("long")
    return out.groupBy("l_partkey").agg(F.count("*").alias("n_lines"), F.count("before").alias("n_after_another"), F.sum(gap).alias("days_between"), F.sum("quantity_before").alias("quantity_before"))


LINES_SQL = """WITH l AS (SELECT l_partkey, l_shipdate::DATE AS shipped, l_quantity FROM lineitem),
d AS (SELECT l_partkey, shipped, max(l_quantity) AS quantity, count(*) AS n, lag(shipped) OVER w AS before, lag(max(l_quantity)) OVER w AS quantity_before FROM l GROUP BY 1, 2 WINDOW w AS (PARTITION BY l_partkey ORDER BY shipped))
SELECT l_partkey, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (before IS NOT NULL), 0)::BIGINT AS n_after_another, sum(n * (shipped - before))::BIGINT AS days_between, sum(n * quantity_before) AS quantity_before FROM d GROUP BY 1"""


def tickets_during_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets opened between an order of the same customer and its delivery, days included."""
    orders = star_tables(spark, sf_dir)[0].where("delivery_date IS NOT NULL").select("order_id", F.col("customer_id").alias("buyer"), "order_date", "delivery_date")
    return temporal.interval_join(tickets(spark, sf_dir), orders, [("customer_id", "buyer")], "opened", "order_date", "delivery_date").drop("buyer")


DURING_SQL = f"""WITH {BASE_SQL}, t AS (SELECT event_id AS ticket_id, user_id AS customer_id, ts::DATE - {SHIFT} AS opened FROM events)
SELECT ticket_id, t.customer_id, opened, order_id, order_date, delivery_date FROM t JOIN facts f ON f.customer_id = t.customer_id AND opened BETWEEN order_date AND delivery_date"""


def price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles and the ninth decile of line prices by return flag, groups of a third of all rows."""
    return quantiles.group_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75, "d9": 0.9})


QUARTILES_SQL = "SELECT l_returnflag, " + ", ".join(f"quantile_cont(l_extendedprice, {p}) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("d9", 0.9))) + " FROM lineitem GROUP BY 1"


#: Events of a user no further apart than this are a session.
GAP_HOURS = 6


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions; the stream of streaming.sessions closes the same ones."""
    out = temporal.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", GAP_HOURS * 3_600_000_000, "value")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n", F.round("total", 4).alias("total"))


SESSIONS_SQL = f"""WITH b AS (SELECT user_id, ts::TIMESTAMP AS t, value, coalesce(ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w > INTERVAL {GAP_HOURS} HOUR, true) AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY t) AS k FROM b)
SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""


def star_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole star published and read back from its manifest: rows, a sum over its keys and a total of each table."""
    orders, items, products, calls = star_tables(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name")
    root = scratch_path(spark, "star")
    source = raw_items(spark, sf_dir)
    reload.publish(spark, root, star.star(customers, products, saved(orders, "orders"), items, calls), lambda t: star.star_checks(t, source))
    t = reload.open_tables(spark, root)
    mix = lambda a, b: F.sum(F.col(a) * F.col(b) % 1000003)
    none = F.lit(None).cast("double")
    sums = {
        "dim_customer": (mix("customer_key", "customer_id"), none), "dim_product": (mix("product_key", "product_id"), F.count("level1")), "dim_channel": (F.sum(F.col("channel_key") * F.length("channel")), none), "dim_date": (F.sum("date_key"), F.count_if("weekend")),
        "fact_order": (mix("order_key", "customer_key"), F.sum("total")), "fact_item": (mix("order_key", "product_key"), F.sum("line_value")), "fact_ticket": (mix("customer_key", "date_key"), F.sum("rating")), "quarantine": (F.sum(F.col("item_id") % 1000003), F.sum("quantity")),
    }
    rows = [t[n].agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"), key.cast("long").alias("key_sum"), total.cast("double").alias("total")) for n, (key, total) in sums.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


STAR_SQL = f"""WITH {BASE_SQL},
dc AS (SELECT c_custkey AS customer_id, row_number() OVER (ORDER BY c_custkey) AS customer_key FROM customer),
dp AS (SELECT system, p_partkey AS product_id, p_size <= 45 AS known, row_number() OVER (ORDER BY system <> 'LEGADO', p_partkey) AS product_key FROM part, (VALUES ('LEGADO'), ('ECOM')) v(system)),
dn AS (SELECT channel, row_number() OVER (ORDER BY channel) AS channel_key FROM (SELECT DISTINCT channel FROM facts)),
dd AS (SELECT strftime(d, '%Y%m%d')::BIGINT AS date_key, isodow(d) >= 6 AS weekend FROM (SELECT unnest(generate_series((SELECT min(order_date) FROM facts)::TIMESTAMP, (SELECT max(order_date) FROM facts)::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
fo AS (SELECT system, order_id, customer_id, total, row_number() OVER (ORDER BY system <> 'LEGADO', order_id) AS order_key FROM facts)
SELECT 'dim_customer' AS name, count(*) AS n_rows, sum(customer_key * customer_id % 1000003)::BIGINT AS key_sum, NULL::DOUBLE AS total FROM dc
UNION ALL SELECT 'dim_product', count(*), sum(product_key * product_id % 1000003), count(*) FILTER (known) FROM dp
UNION ALL SELECT 'dim_channel', count(*), sum(channel_key * length(channel)), NULL FROM dn
UNION ALL SELECT 'dim_date', count(*), sum(date_key), count(*) FILTER (weekend) FROM dd
UNION ALL SELECT 'fact_order', count(*), sum(order_key * customer_key % 1000003), sum(total) / 10000.0 FROM fo LEFT JOIN dc USING (customer_id)
UNION ALL SELECT 'fact_item', count(*), sum(order_key * product_key % 1000003), sum(i.goods) / 10000.0 FROM items i JOIN fo ON fo.system = i.system AND fo.order_id = i.order_id LEFT JOIN dp ON dp.system = i.system AND dp.product_id = i.product_id WHERE order_exists
UNION ALL SELECT 'fact_ticket', count(*), sum(customer_key * strftime(opened, '%Y%m%d')::BIGINT % 1000003), sum(rating) FROM tickets LEFT JOIN dc USING (customer_id)
UNION ALL SELECT 'quarantine', count(*), sum(item_id % 1000003), sum(quantity) FROM items WHERE NOT order_exists"""


def later_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a later run might have them: some totals changed, some orders gone, some new."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    changed = o.where(k % 1009 != 7).withColumn("o_totalprice", F.when(k % 997 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return changed.unionByName(o.where(k % 1013 == 9).withColumn("o_orderkey", k + 100_000_000))


def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that differ between two runs, by their trees of hash sums."""
    return hash_tree.differences(table(spark, sf_dir, "orders"), later_run(spark, sf_dir), "o_orderkey").select("o_orderkey", "state")


DIFFERENCES_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 7 THEN 'gone' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 1009 = 7 OR o_orderkey % 997 = 5
UNION ALL SELECT o_orderkey + 100000000, 'added' FROM orders WHERE o_orderkey % 1013 = 9"""


def _affected() -> list[Metric]:
    """The affected-record metrics over conformed orders, lines, customers' records, persons, tickets and products."""
    c, n = F.col, F.count("*")
    of = lambda t, base: lambda key, test, by=None: Metric(key, t, rows_that(test), base, by)
    o, i, r, p, t, q = of("orders", "base.orders"), of("lines", "base.lines"), of("records", "base.records"), of("persons", "base.persons"), of("tickets", "base.tickets"), of("products", "base.products")
    cancelled, legacy, shop = ~c("effective"), c("system") == "LEGADO", c("system") == "ECOM"
    in_target = (c("order_date") > F.lit(CUT).cast("date")) & (c("order_date") <= F.lit(END).cast("date"))
    sums = lambda key, table_, value: Metric(key, table_, F.sum(value))
    true = F.lit(True)
    return [
        *(Metric(f"base.{name}", name, n) for name in ("orders", "lines", "records", "persons", "tickets", "products")),
        o("base.orders_of", true, "system"), i("base.lines_of", true, "system"), r("base.records_of", true, "system"),
        # identities
        p("02.persons_of", true, "origin"), p("02.persons_by_rule", true, "rules"), p("02.valid_tax_id", c("tax_valid")), p("02.invalid_tax_id", ~c("tax_valid")), p("02.no_tax_id", c("tax").isNull()), p("02.tax_id_of_several", c("tax_conflict")),
        p("02.several_records", c("n_legacy") + c("n_shop") > 1), sums("02.records_absorbed", "persons", c("n_legacy") + c("n_shop") - 1), p("03.legacy_repeated", c("n_legacy") > 1), sums("03.legacy_absorbed", "persons", F.greatest(c("n_legacy") - 1, F.lit(0))),
        # status
        o("04.status", true, "status"), o("04.source_status", true, "raw_status"), o("04.channel", true, "channel"), o("04.cancelled", cancelled), o("04.cancelled_legacy", cancelled & legacy), o("04.cancelled_shop", cancelled & shop), o("04.declined", c("raw_status") == "payment_declined"),
        o("04.purchases", c("effective")), o("04.in_target", in_target), o("04.cancelled_in_target", in_target & cancelled), Metric("04.customers", "orders", c("customer_id"), distinct=True), Metric("04.buyers", "orders", F.when(c("effective"), c("customer_id")), "04.customers", distinct=True),
        # totals
        sums("05.total", "orders", "total"), sums("05.total_legacy", "orders", F.when(legacy, c("total"))), sums("05.total_shop", "orders", F.when(shop, c("total"))), sums("05.freight", "orders", "freight"), sums("05.freight_shop", "orders", F.when(shop, c("freight"))),
        o("05.with_freight", c("freight") != 0), o("05.no_lines", c("units") == 0), sums("05.goods", "orders", "goods"), sums("05.discounts", "orders", "discount"),
        # sentinels and signs
        i("06.lines_discount_sentinel", c("discount_absent")), o("06.orders_discount_sentinel", c("discount_absent")), o("06.freight_negative", c("freight_negative")), o("06.freight_negative_of", c("freight_negative"), "system"), sums("06.sum_freight_negative", "orders", F.when(c("freight_negative"), c("freight"))),
        o("06.freight_negative_cancelled", c("freight_negative") & cancelled), o("06.total_negative", c("total") < 0), Metric("06.largest_quantity", "lines", F.max("quantity")), i("06.quantity_over_40", c("quantity") > 40), Metric("06.dearest", "lines", F.max("unit_price")),
        # products
        q("07.products_of", true, "system"), q("07.no_category", c("level1").isNull()), Metric("07.categories", "products", c("level1"), distinct=True), i("07.lines_without_order", ~c("order_exists")), sums("07.value_without_order", "lines", F.when(~c("order_exists"), c("line_value"))),
        # dates and tickets
        o("08.not_delivered", c("delivery_date").isNull() & ~c("delivery_undated") & ~c("delivery_too_early")), o("08.undated", c("delivery_undated")), o("08.undated_delivered", c("delivery_undated") & (c("status") == "ENTREGUE")), o("08.too_early", c("delivery_too_early")), o("08.too_early_of", c("delivery_too_early"), "system"),
        o("08.slow", c("delivery_days") > 35), r("08.no_tax_id", c("tax_id").isNull()), r("08.no_tax_id_of", c("tax_id").isNull(), "system"), r("08.no_email", c("email").isNull()), r("08.no_phone", c("phone").isNull()), r("08.city_sentinel", c("city") == "N/A"),
        t("08.rating_zero", c("rating") == 0), t("08.rating_off_scale", ~c("rating").between(1, 5)), Metric("08.mean_rating", "tickets", F.avg(F.when(c("rating").between(1, 5), c("rating")))),
    ]


def affected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of records that each rule affects, with their shares, by one scan of each table."""
    from .operators import identity

    orders, items, products, calls = star_tables(spark, sf_dir)
    records = people_records(spark, sf_dir)
    tables = {"orders": orders, "lines": items, "products": products, "tickets": calls, "records": records, "persons": identity.persons(records)[0]}
    out = metrics.measure(tables, _affected())
    return out.select("key", F.round("value", 4).alias("value"), F.round("percent", 6).alias("percent"))


def _affected_sql() -> str:
    base = {t: f"base.{t}" for t in ("orders", "lines", "records", "persons", "tickets", "products")}
    sources = {"orders": "facts", "lines": "items", "records": "rec", "persons": "per", "tickets": "tickets", "products": "pro"}
    target = f"order_date > DATE '{CUT}' AND order_date <= DATE '{END}'"
    count = lambda t, tests: [(t, k, f"count(*) FILTER ({x})", base[t]) for k, x in tests.items()]
    value = lambda t, cells: [(t, k, x, None) for k, x in cells.items()]
    plain = [
        *((t, f"base.{t}", "count(*)", None) for t in base),
        *count("persons", {"02.valid_tax_id": "tax_valid", "02.invalid_tax_id": "NOT tax_valid", "02.no_tax_id": "tax IS NULL", "02.tax_id_of_several": "conflict", "02.several_records": "size > 1", "03.legacy_repeated": "n_legacy > 1"}),
        *value("persons", {"02.records_absorbed": "sum(size - 1)", "03.legacy_absorbed": "sum(CASE WHEN n_legacy > 1 THEN n_legacy - 1 ELSE 0 END)"}),
        *count("orders", {
            "04.cancelled": "NOT effective", "04.cancelled_legacy": "NOT effective AND order_id % 2 = 0", "04.cancelled_shop": "NOT effective AND order_id % 2 = 1", "04.declined": "raw_status = 'payment_declined'", "04.purchases": "effective",
            "04.in_target": target, "04.cancelled_in_target": f"{target} AND NOT effective", "05.with_freight": "freight <> 0", "05.no_lines": "order_id NOT IN (SELECT l_orderkey FROM lineitem)", "06.orders_discount_sentinel": "discount_absent", "06.freight_negative": "freight < 0",
            "06.freight_negative_cancelled": "freight < 0 AND NOT effective", "06.total_negative": "total < 0", "08.not_delivered": "raw_delivery IS NULL", "08.undated": "raw_delivery = DATE '1900-01-01'", "08.undated_delivered": "raw_delivery = DATE '1900-01-01' AND status = 'ENTREGUE'",
            "08.too_early": "raw_delivery > DATE '1900-01-01' AND raw_delivery < order_date", "08.slow": "delivery_days > 35",
        }),
        *value("orders", {
            "04.customers": "count(DISTINCT customer_id)", "05.total": "sum(total) / 10000.0", "05.total_legacy": "sum(total) FILTER (system = 'LEGADO') / 10000.0", "05.total_shop": "sum(total) FILTER (system = 'ECOM') / 10000.0", "05.freight": "sum(freight) / 10000.0",
            "05.freight_shop": "sum(freight) FILTER (system = 'ECOM') / 10000.0", "05.goods": "sum(goods) / 10000.0", "05.discounts": "sum(discount) / 10000.0", "06.sum_freight_negative": "sum(freight) FILTER (freight < 0) / 10000.0",
        }),
        ("orders", "04.buyers", "count(DISTINCT customer_id) FILTER (effective)", "04.customers"),
        *count("lines", {"06.lines_discount_sentinel": "absent", "06.quantity_over_40": "quantity > 40", "07.lines_without_order": "NOT order_exists"}),
        *value("lines", {"06.largest_quantity": "max(quantity)", "06.dearest": "max(cents) / 100.0", "07.value_without_order": "sum(goods) FILTER (NOT order_exists) / 10000.0"}),
        *count("products", {"07.no_category": "level1 IS NULL"}), *value("products", {"07.categories": "count(DISTINCT level1)"}),
        *count("records", {"08.no_tax_id": "node % 7 = 0", "08.no_email": "node % 9 = 0", "08.no_phone": "node % 12 = 4", "08.city_sentinel": "node % 5 = 0"}),
        *count("tickets", {"08.rating_zero": "rating = 0", "08.rating_off_scale": "rating < 1 OR rating > 5"}), *value("tickets", {"08.mean_rating": "avg(rating) FILTER (rating BETWEEN 1 AND 5)"}),
    ]
    cells = [
        ("orders", "base.orders_of", "true", "system"), ("lines", "base.lines_of", "true", "system"), ("records", "base.records_of", "true", "system"), ("persons", "02.persons_of", "true", "origin"), ("persons", "02.persons_by_rule", "true", "rules"),
        ("orders", "04.status", "true", "status"), ("orders", "04.source_status", "true", "raw_status"), ("orders", "04.channel", "true", "channel"), ("orders", "06.freight_negative_of", "freight < 0", "system"), ("products", "07.products_of", "true", "system"),
        ("orders", "08.too_early_of", "raw_delivery > DATE '1900-01-01' AND raw_delivery < order_date", "system"), ("records", "08.no_tax_id_of", "node % 7 = 0", "system"),
    ]
    rows = [f"SELECT '{k}' AS key, ({x})::DOUBLE AS value, {f"'{b}'" if b else 'NULL'} AS base FROM {sources[t]}" for t, k, x, b in plain]
    rows += [f"SELECT '{k}.' || coalesce({by}, 'none'), count(*) FILTER ({x})::DOUBLE, '{base[t]}' FROM {sources[t]} GROUP BY {by}" for t, k, x, by in cells]
    people = PEOPLE_BASE_SQL.strip()
    return f"""WITH {people}, {BASE_SQL.strip()}, rec AS (SELECT * FROM k),
per AS (SELECT CASE WHEN NOT lost THEN tax END AS tax, CASE WHEN NOT lost THEN good END AS tax_valid, conflict, n_legacy, n_legacy + n_shop AS size, rules, CASE WHEN n_legacy > 0 AND n_shop > 0 THEN 'AMBOS' WHEN n_shop > 0 THEN 'ECOM' ELSE 'LEGADO' END AS origin FROM gk LEFT JOIN ru USING (person)),
pro AS (SELECT system, CASE WHEN p_size <= 45 THEN p_brand END AS level1 FROM part, (VALUES ('LEGADO'), ('ECOM')) v(system)),
rw AS ({' UNION ALL '.join(rows)})
SELECT a.key, round(a.value, 4) AS value, CASE WHEN a.base IS NOT NULL AND b.value <> 0 THEN round(100 * a.value / b.value, 6) END AS percent FROM rw a LEFT JOIN rw b ON b.key = a.base"""


def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the lines profiled by year of shipping and merged: exact counts and ends, and whether the distinct values and the median
    that the sketches give are near the exact ones (within 4 % of their number, and within two of a hundred ranks)."""
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_partkey", "l_quantity", "l_extendedprice"]
    found = sketches.merge(sketches.profile_parts(lines, F.year("l_shipdate"), columns), {"median": 0.5})
    cells = [F.struct(F.lit(c).alias("column"), F.countDistinct(c).alias("exact")) for c in columns]
    exact = lines.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    medians = {r["column"]: r["median"] for r in found.select("column", "median").collect()}  # a number a column
    ranks = lines.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.avg((F.col(c) < medians[c]).cast("int")).alias("below"), F.avg((F.col(c) <= medians[c]).cast("int")).alias("upto")) for c in columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.04 * F.col("exact")
    return found.join(exact, "column").join(ranks, "column").select("column", "n_rows", "n_null", "least", "greatest", near.alias("distinct_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))


MERGED_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest, true AS distinct_near, true AS median_near FROM lineitem" for c in ("l_partkey", "l_quantity", "l_extendedprice"))

#: The first sign-up day of the records that arrive later: a tenth of all.
ARRIVAL = "2023-04-01"


def people_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons after a run over the earlier sign-ups to which the later ones were added: those of a whole run, with the
    keys that the first run gave, and how many of its persons each was."""
    records = people_records(spark, sf_dir)
    late = F.col("signed_up") >= F.lit(ARRIVAL).cast("date")
    first = identity_updates.start(records.where(~late))
    state = identity_updates.add(first, records.where(late))
    gold, bridge, _ = identity.finished(state.members, state.persons)
    was = bridge.join(first.members.select("node", F.col("person").alias("was")), "node").groupBy("person").agg(F.countDistinct("was").alias("n_before"))
    gold = gold.join(was, "person", "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)).cast("long"))
    return _doubles(gold.select("person_key", "person", "n_before", "n_legacy", "n_shop", "legacy_id", "shop_id", "origin", "rules", "tax", "tax_valid", "name", "city", "region", "first_signed_up", "tax_conflict"))


ADDED_SQL = f"""WITH {PEOPLE_BASE_SQL},
old AS (SELECT * FROM (WITH {PEOPLE_BASE_SQL.replace("FROM customer)", f"FROM customer WHERE DATE '2023-01-01' + (c_custkey % 100)::INT < DATE '{ARRIVAL}')")} SELECT node, person_key AS old_key FROM m JOIN gk USING (person))),
kept AS (SELECT person, min(old_key) AS old_key, count(DISTINCT old_key) AS n_before FROM p LEFT JOIN old USING (node) GROUP BY 1)
SELECT coalesce(old_key, (SELECT max(old_key) FROM old) + row_number() OVER (PARTITION BY old_key IS NULL ORDER BY least_legacy IS NULL, coalesce(least_legacy, shop_id), person)) AS person_key, person, n_before, n_legacy, n_shop, legacy_id, shop_id,
  CASE WHEN n_legacy > 0 AND n_shop > 0 THEN 'AMBOS' WHEN n_shop > 0 THEN 'ECOM' ELSE 'LEGADO' END AS origin, rules, CASE WHEN NOT lost THEN tax END AS tax, CASE WHEN NOT lost THEN good END AS tax_valid, name, city, region, first_signed_up, conflict AS tax_conflict
FROM gk JOIN kept USING (person) LEFT JOIN ru USING (person)"""

#: What the tree sees.
TREE_FEATURES = ["recency_days", "frequency", "orders_last_90d", "tenure_days", "n_categories"]


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an entropy tree of any depth, grown on 70 % of the customers, with its counts and AUC on the others."""
    base = saved(customer_features(spark, sf_dir).select("customer_id", "y", *TREE_FEATURES), "base")
    split = saved(models.stratified_split(base.select("customer_id", "y"), "customer_id", "y").select("customer_id", "train"), "split")
    grown = saved(tree.grow(base.join(split.where("train"), "customer_id", "left_semi"), "y", TREE_FEATURES), "tree")
    test = base.join(split.where("NOT train"), "customer_id", "left_semi")
    scored = saved(tree.scores(grown, test, "customer_id", TREE_FEATURES).join(test.select("customer_id", "y"), "customer_id"), "scores")
    shape = grown.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("feature").isNull()).alias("n_leaves"), F.max("depth").cast("long").alias("depth"))
    return shape.crossJoin(models.confusion(scored, "score", "y")).crossJoin(models.auc(scored, "score", "y").select("auc"))  # three single rows


ALL = {ticket_last_order: LAST_ORDER_SQL, part_shipping_gaps: LINES_SQL, tickets_during_delivery: DURING_SQL, price_quartiles: QUARTILES_SQL, user_sessions: SESSIONS_SQL, star_reload: STAR_SQL, run_differences: DIFFERENCES_SQL, affected_records: _affected_sql(), merged_profile: MERGED_SQL, people_added: ADDED_SQL, tree_report: None}
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {f.__name__: sql for f, sql in ALL.items() if sql}
