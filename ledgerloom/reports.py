"""Registered reports by source system: formula hypotheses, anomalies with their base, volumes, periods and label views, each with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text
from .operators import profile
from .plans import conform, diagnostics
from .plans import features as feat
from .queries import BASE_SQL, CUT, END, PEOPLE_BASE_SQL, _doubles, _target_sql, people_records, raw_items, raw_orders, star_tables, table

#: The day that parts the periods.
CHANGE = "1998-07-01"


def hypotheses_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight formulas of the total on raw lines (discounts a line or a unit, the sentinel as it is or as zero), by system,
    in total and by period, channel and status; and what only the reading of the sentinel explains."""
    sentinel = F.col("discount") == -1
    lines = raw_items(spark, sf_dir).groupBy("system", "order_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("quantity") * F.col("unit_price")).alias("gross"), F.sum("discount").alias("a_line"), F.sum(F.when(sentinel, 0).otherwise(F.col("discount"))).alias("known"),
        F.sum(F.col("quantity") * F.col("discount")).alias("a_unit"), F.count_if(sentinel).alias("n_sentinel"),
    )
    orders = star_tables(spark, sf_dir)[0].select("system", "order_id", "raw_status", "raw_channel", "order_date", "total", "freight")
    both = orders.join(lines, ["system", "order_id"], "left").withColumn("period", F.when(F.col("order_date") < CHANGE, "before").otherwise("after"))
    gross, a_line, known, a_unit, freight = map(F.col, ("gross", "a_line", "known", "a_unit", "freight"))
    formulas = {
        "h1": gross, "h2": gross - a_line, "h3": gross - a_line + freight, "h4": gross + freight, "h5": gross - a_unit, "h6": gross - a_unit + freight, "h2s": gross - known, "h3s": gross - known + freight,
    }
    fits = {k: F.coalesce(F.abs(F.col("total") - f) <= 0.01, F.lit(False)) for k, f in formulas.items()}
    marked = both.withColumns({f"_{k}": f for k, f in fits.items()})
    measures = {"n": F.count("*"), "no_lines": F.count_if(F.col("n_lines").isNull()), "with_sentinel": F.count_if(F.col("n_sentinel") > 0), "freight_negative": F.count_if(F.col("freight") < 0)}
    measures |= {k: F.count_if(F.col(f"_{k}")) for k in fits}
    measures["by_sentinel"] = F.count_if(F.col("_h3s") & ~F.col("_h3"))
    cut = lambda s: diagnostics.by_cuts(marked.where(F.col("system") == s), ["period", "raw_channel", "raw_status"], measures).select(F.lit(s).alias("system"), "*")
    return cut("LEGADO").unionByName(cut("ECOM"))


_FITS = {"h1": "gross", "h2": "gross - a_line", "h3": "gross - a_line + freight", "h4": "gross + freight", "h5": "gross - a_unit", "h6": "gross - a_unit + freight", "h2s": "gross - discounts", "h3s": "gross - discounts + freight"}
HYPOTHESES_SQL = f"""WITH {BASE_SQL},
l AS (SELECT order_id, sum(goods) AS gross, sum(CASE WHEN absent THEN -10000 ELSE discount END) AS a_line, sum(discount) AS discounts, sum(quantity * CASE WHEN absent THEN -10000 ELSE discount END) AS a_unit, bool_or(absent) AS absent FROM items GROUP BY 1),
j AS (SELECT f.system, f.raw_channel, f.raw_status, CASE WHEN order_date < DATE '{CHANGE}' THEN 'before' ELSE 'after' END AS period, freight, total, l.* FROM facts f LEFT JOIN l USING (order_id)),
x AS (SELECT system, unnest([{{'c': 'total', 'v': ''}}, {{'c': 'period', 'v': period}}, {{'c': 'raw_channel', 'v': raw_channel}}, {{'c': 'raw_status', 'v': raw_status}}]) AS cell, j.* EXCLUDE (system) FROM j)
SELECT system, cell.c AS cut, cell.v AS value, count(*) AS n, count(*) FILTER (gross IS NULL) AS no_lines, count(*) FILTER (absent) AS with_sentinel, count(*) FILTER (freight < 0) AS freight_negative,
  {", ".join(f"count(*) FILTER (abs(total - ({f})) <= 100) AS {k}" for k, f in _FITS.items())}, count(*) FILTER (abs(total - ({_FITS["h3s"]})) <= 100 AND NOT abs(total - ({_FITS["h3"]})) <= 100) AS by_sentinel
FROM x GROUP BY 1, 2, 3"""


def _named(source: str, df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return diagnostics.anomalies(df, tests).select(F.lit(source).alias("source"), "anomaly", F.col("lower").alias("n"), "base")


def _repeats(source: str, anomaly: str, df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Rows in repeated keys (n_rows) or beyond the first (n_surplus), of all rows of df; rows without one of the keys repeat nothing."""
    n = profile.duplicates(df.dropna(subset=keys) if what == "n_rows" else df, keys).select(F.col(what).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count("*").alias("base")))).select(F.lit(source).alias("source"), F.lit(anomaly).alias("anomaly"), "n", "base")  # one row each


def _orphans(source: str, anomaly: str, df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    found = df.join(parents.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    return found.agg(F.count_if(F.col("_there").isNull()).alias("n"), F.count("*").alias("base")).select(F.lit(source).alias("source"), F.lit(anomaly).alias("anomaly"), "n", "base")


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service tickets as text, some of them repeated, with line breaks, ratings out of the scale and hours below zero."""
    k = F.when(F.col("event_id") % 30 == 1, F.col("event_id") - 1).otherwise(F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        F.floor(k / 3 * 2).cast("string").alias("protocol"), F.when(k % 2 == 0, "web").otherwise("FONE").alias("channel"), F.when(k % 5 == 3, "late\nagain").otherwise("late").alias("reason"),
        F.when(k % 4 != 0, (k % 7).cast("string")).otherwise("").alias("rating"), F.concat((k % 50 - 3).cast("string"), F.lit(",5")).alias("hours"),
    )


def anomalies_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, anomaly, n, base, percent): repeated customers, ticket texts, sentinel dates and places, references without
    a row, prices, freights and discounts. Each table is met in one scan for its row tests, and in one join a reference."""
    records = people_records(spark, sf_dir).withColumns({"tax": F.when(text.tax_id_valid(F.col("tax_id")), F.col("tax_id")), "mail": text.blank_to_null(F.lower(F.trim("email"))), "folded": text.fold_name(F.col("name")), "signed_up": F.trunc("signed_up", "month")})
    orders, items, tickets = raw_orders(spark, sf_dir), raw_items(spark, sf_dir), _tickets(spark, sf_dir)
    customers, part = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_retailprice")
    hours = F.regexp_replace("hours", ",", ".").try_cast("double")
    out = [
        _repeats("LEGADO", "tax id repeated", records.where("system = 'L'"), ["tax"], "n_rows"), _repeats("LEGADO", "e-mail repeated", records.where("system = 'L'"), ["mail"], "n_rows"),
        _repeats("LEGADO", "name and date repeated", records.where("system = 'L'"), ["folded", "signed_up"], "n_rows"), _repeats("ECOM", "tax id repeated", records.where("system = 'E'"), ["tax"], "n_rows"),
        _named("LEGADO", records.where("system = 'L'"), {"city is a sentinel": F.col("city").isin("N/A", "NA", "-", "")}),
        _repeats("SAC", "lines equal to an earlier one", tickets, ["protocol", "channel", "reason", "rating", "hours"], "n_surplus"), _repeats("SAC", "protocol repeated", tickets, ["protocol"], "n_rows"),
        _named("SAC", tickets, {
            "line break in a field": text.has_line_break(F.concat_ws("", "protocol", "channel", "reason", "rating", "hours")), "rating off the scale": ~F.col("rating").isin("", "1", "2", "3", "4", "5"), "rating blank": F.col("rating") == "",
            "hours below zero": hours < 0, "channel not in capitals": F.col("channel") != F.upper("channel"),
        }),
        _named("PRODUCTS", part, {"list price of zero or less": F.coalesce(F.col("p_retailprice") <= 0, F.lit(True))}),
    ]
    for s in ("LEGADO", "ECOM"):
        o, i = orders.where(F.col("system") == s), items.where(F.col("system") == s)
        out += [
            _named(s, o, {"delivery on the sentinel date": dates.not_sentinel(F.col("delivery_date")).isNull() & F.col("delivery_date").isNotNull(), "delivery before the order": dates.not_sentinel(F.col("delivery_date")) < F.col("order_date"), "freight below zero": F.col("freight") < 0}),
            _named(s, i, {"discount is a sentinel": F.col("discount") == -1, "unit price of zero or less": F.col("unit_price") <= 0, "quantity of zero or less": F.col("quantity") <= 0}),
            _orphans(s, "lines without an order", i, o, "order_id"), _orphans(s, "orders without lines", o, i, "order_id"),
            _orphans(s, "orders without a customer", o, customers, "customer_id"), _orphans(s, "lines without a product", i, part, "product_id"),
        ]
    return reduce(DataFrame.unionByName, out).withColumn("percent", F.try_divide(100.0 * F.col("n"), F.col("base")))


def _anomalies_sql() -> str:
    rows = lambda s, table_sql, tests: [f"SELECT '{s}' AS source, '{k}' AS anomaly, count(*) FILTER ({t}) AS n, count(*) AS base FROM {table_sql}" for k, t in tests.items()]
    again = lambda keys, where: f"node IN (SELECT unnest(ids) FROM (SELECT list(node) AS ids FROM k WHERE {where} GROUP BY {keys} HAVING count(*) > 1))"
    out = rows("LEGADO", "k WHERE system = 'L'", {"tax id repeated": again("tax", "ok AND system = 'L'"), "e-mail repeated": again("email", "email IS NOT NULL AND system = 'L'"), "name and date repeated": again("folded, date_trunc('month', signed_up)", "system = 'L'"), "city is a sentinel": "node % 5 = 0"})
    out += rows("ECOM", "k WHERE system = 'E'", {"tax id repeated": again("tax", "ok AND system = 'E'")})
    out += rows("SAC", "t", {"lines equal to an earlier one": "nth > 1", "protocol repeated": "n > 1", "line break in a field": "event_id % 5 = 3", "rating off the scale": "event_id % 4 <> 0 AND event_id % 7 IN (0, 6)", "rating blank": "event_id % 4 = 0", "hours below zero": "event_id % 50 < 3", "channel not in capitals": "event_id % 2 = 0"})
    out += rows("PRODUCTS", "part", {"list price of zero or less": "p_retailprice <= 0"})
    for s in ("LEGADO", "ECOM"):
        out += rows(s, f"raw WHERE system = '{s}'", {
            "delivery on the sentinel date": "raw_delivery = DATE '1900-01-01'", "delivery before the order": "raw_delivery > DATE '1900-01-01' AND raw_delivery < order_date", "freight below zero": "freight < 0",
            "orders without lines": "order_id NOT IN (SELECT l_orderkey FROM lineitem)", "orders without a customer": "customer_id NOT IN (SELECT c_custkey FROM customer)",
        })
        out += rows(s, f"items WHERE system = '{s}'", {"discount is a sentinel": "absent", "unit price of zero or less": "cents <= 0", "quantity of zero or less": "quantity <= 0", "lines without an order": "NOT order_exists", "lines without a product": "product_id NOT IN (SELECT p_partkey FROM part)"})
    tickets = """t AS (SELECT *, count(*) OVER (PARTITION BY p) AS n, row_number() OVER (PARTITION BY p, event_id % 2, event_id % 5 = 3, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 7 END, event_id % 50 ORDER BY event_id) AS nth FROM (SELECT *, floor(event_id / 3 * 2)::BIGINT AS p FROM (SELECT event_id - (event_id % 30 = 1)::INT AS event_id FROM events)))"""
    return f"WITH {PEOPLE_BASE_SQL}, {BASE_SQL.strip()}, {tickets}, a AS ({' UNION ALL '.join(out)}) SELECT *, 100.0 * n / nullif(base, 0)::DOUBLE AS percent FROM a".replace("tickets AS (SELECT user_id", "calls AS (SELECT user_id")


def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each system before and after the change: how many, in how many months, a month, the mean total, and the share of
    each channel and of cancelled ones. One aggregate."""
    o = star_tables(spark, sf_dir)[0].withColumn("side", F.when(F.col("order_date") < CHANGE, "before").otherwise("after"))
    share = lambda test: F.count_if(test) / F.count("*")
    got = o.groupBy("system", "side").agg(
        F.count("*").alias("n"), F.countDistinct(F.trunc("order_date", "month")).alias("n_months"), (F.sum("total").cast("double") / F.count("*")).alias("mean_total"),
        *(share(F.col("channel") == c).alias(c.lower()) for c in CHANNELS), share(~F.col("effective")).alias("cancelled"),
    )
    return got.withColumn("a_month", F.col("n") / F.col("n_months"))


CHANNELS = ["FISICO", "TELEVENDAS", "ONLINE_PROPRIO", "MARKETPLACE"]
SIDES_SQL = f"""WITH {BASE_SQL}, m AS (SELECT system, CASE WHEN order_date < DATE '{CHANGE}' THEN 'before' ELSE 'after' END AS side, year(order_date) * 12 + month(order_date) AS month, total, channel, effective FROM facts)
SELECT system, side, count(*) AS n, count(DISTINCT month) AS n_months, sum(total)::DOUBLE / 10000 / count(*) AS mean_total, {", ".join(f"avg((channel = '{c}')::INT) AS {c.lower()}" for c in CHANNELS)}, avg((NOT effective)::INT) AS cancelled, count(*) / count(DISTINCT month) AS a_month FROM m GROUP BY 1, 2"""


#: What the sources declare: rows for each customer.
DECLARED = {"customer": 1, "orders": 10, "lineitem": 40, "part": 1.5, "supplier": 0.05}


def volume_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table as read, as staged and by different keys, against the declared volume: deviation in percent, and whether
    staging kept every row. Orders and lines are staged by conformance, the others as they are."""
    orders, items, *_ = star_tables(spark, sf_dir)
    staged = {"orders": (orders, "order_id"), "lineitem": (items, "item_id")}
    count = lambda df, k: df.agg(F.count("*").alias("n_staged"), F.countDistinct(k).alias("n_keys"))
    keys = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
    base = table(spark, sf_dir, "customer").agg(F.count("*").alias("base"))
    out = []
    for name, times in DECLARED.items():
        df, key = staged.get(name) or (table(spark, sf_dir, name), keys[name])
        read = table(spark, sf_dir, name).agg(F.count("*").alias("n_read"))
        one = read.crossJoin(F.broadcast(count(df, key))).crossJoin(F.broadcast(base))  # a row each
        out.append(one.select(F.lit(name).alias("name"), "n_read", "n_staged", "n_keys", (100 * (F.col("n_read") / (F.col("base") * times) - 1)).alias("deviation"), (F.col("n_read") == F.col("n_staged")).alias("whole")))
    return reduce(DataFrame.unionByName, out)


_STAGED = {"customer": ("customer", "c_custkey"), "orders": ("facts", "order_id"), "lineitem": ("items", "item_id"), "part": ("part", "p_partkey"), "supplier": ("supplier", "s_suppkey")}
VOLUME_SQL = f"WITH {BASE_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_read, (SELECT count(*) FROM {s}) AS n_staged, (SELECT count(DISTINCT {k}) FROM {s}) AS n_keys, {DECLARED[n]}::DOUBLE AS times" for n, (s, k) in _STAGED.items()) + ") SELECT name, n_read, n_staged, n_keys, 100 * (n_read / ((SELECT count(*) FROM customer) * times) - 1) AS deviation, n_read = n_staged AS whole FROM v"


def label_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose label changes under another view: days of a clock ahead, delivered orders only, and persons instead of
    records (two records each). (view, y_first, y_second, n_customers); null: not in that population."""
    o = star_tables(spark, sf_dir)[0].select("customer_id", "order_id", "order_date", "status", "effective")
    first = feat.target(o, CUT, END).withColumnRenamed("y", "y_first")
    ahead = o.withColumn("order_date", F.when(F.col("order_id") % 8 == 0, F.date_add("order_date", 1)).otherwise(F.col("order_date")))
    delivered = o.withColumn("effective", F.col("status") == "ENTREGUE")
    person = F.floor(F.col("customer_id") / 2).cast("long")
    persons = feat.target(o.withColumn("customer_id", person), CUT, END).withColumnRenamed("customer_id", "person")
    by_person = o.select("customer_id", person.alias("person")).distinct().join(persons, "person").select("customer_id", "y")
    views = {"clock": feat.target(ahead, CUT, END), "status": feat.target(delivered, CUT, END), "identity": by_person}
    out = [first.join(y.withColumnRenamed("y", "y_second"), "customer_id", "full").groupBy("y_first", "y_second").agg(F.count("*").alias("n_customers")).select(F.lit(v).alias("view"), "*") for v, y in views.items()]
    return _doubles(reduce(DataFrame.unionByName, out))


_AHEAD = "(CASE WHEN order_id % 8 = 0 THEN order_date + 1 ELSE order_date END)"
VIEWS_SQL = f"""WITH {BASE_SQL}, a AS ({_target_sql("order_date")}), b AS ({_target_sql(_AHEAD)}),
c AS (SELECT customer_id, (customer_id IN (SELECT customer_id FROM facts WHERE status = 'ENTREGUE' AND order_date > DATE '{CUT}' AND order_date <= DATE '{END}'))::BIGINT AS y FROM a),
d AS (SELECT customer_id, y FROM (SELECT DISTINCT customer_id FROM facts) f JOIN (SELECT customer_id // 2 AS person, max((order_date > DATE '{CUT}' AND order_date <= DATE '{END}' AND effective)::BIGINT) AS y FROM facts GROUP BY 1 HAVING min(order_date) <= DATE '{CUT}') ON person = customer_id // 2)
""" + " UNION ALL ".join(f"SELECT '{v}' AS view, a.y AS y_first, {t}.y AS y_second, count(*) AS n_customers FROM a FULL JOIN {t} USING (customer_id) GROUP BY 2, 3" for v, t in (("clock", "b"), ("status", "c"), ("identity", "d")))  # noqa: S608


def conformed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with their product by reference, the declared order, the local day of an instant with or without offset, and
    ratings that are numbers, texts, off the scale or not there."""
    k = F.col("event_id")
    stamp, offset = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "-03:00").otherwise("")
    paths = lambda test: F.when(test, F.array(F.lit("rating"))).otherwise(F.array().cast("array<string>"))
    raw = table(spark, sf_dir, "events").select(
        k.alias("review_id"), F.concat(F.when(k % 2 == 0, "LEG-").otherwise(""), (k % 150).cast("string")).alias("sku"), F.concat(F.when(k % 7 == 0, "FOO-").when(k % 2 == 0, "LEG-").otherwise("ECOM-"), k.cast("string")).alias("order_ref"),
        F.concat(stamp, offset).alias("submitted_at"), F.when(k % 11 != 0, (k % 7).cast("string")).alias("rating"), paths(k % 5 == 0).alias("text_paths"), paths(k % 11 == 0).alias("absent_paths"),
    )
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, "ECOM").otherwise("LEGADO").alias("system"), F.col("p_partkey").cast("string").alias("reference"), F.col("p_partkey").alias("product_key"))
    return _doubles(conform.reviews(raw, p))


REVIEWS_SQL = """WITH e AS (SELECT event_id AS k, date_trunc('second', ts::TIMESTAMP) AS s, event_id % 150 AS sku FROM events),
l AS (SELECT *, CASE WHEN k % 3 = 0 THEN s - INTERVAL 3 HOUR ELSE s END AS here FROM e)
SELECT CASE WHEN k % 2 = 0 THEN 'LEGADO' ELSE 'ECOM' END AS system, sku::VARCHAR AS reference, k AS review_id, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'LEG' ELSE 'ECOM' END END AS ref_system, CASE WHEN k % 7 <> 0 THEN k END AS ref_id,
  here AS local_time, here::DATE AS local_day, k % 3 = 2 AS offset_missing, CASE WHEN k % 11 <> 0 AND k % 7 BETWEEN 1 AND 5 THEN k % 7 END AS rating, k % 5 = 0 AS rating_was_text, k % 11 = 0 AS rating_absent, p_partkey AS product_key
FROM l LEFT JOIN part ON p_partkey = sku AND (p_partkey % 3 = 0) = (k % 2 = 1)"""


ALL = {hypotheses_by_source: HYPOTHESES_SQL, anomalies_by_source: _anomalies_sql(), before_and_after: SIDES_SQL, volume_parity: VOLUME_SQL, label_views: VIEWS_SQL, conformed_reviews: REVIEWS_SQL}
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {f.__name__: sql for f, sql in ALL.items()}
