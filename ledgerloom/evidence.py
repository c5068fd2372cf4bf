"""Registered reports of what the sources say of each other: references of reviews, channels, mapping classes, review
anomalies and estimates with bounds, each with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audits import PRODUCTS_SQL, conformed_products
from .operators import identity, profile
from .plans import diagnostics, plausibility, verification
from .queries import BASE_SQL, CUT, END, PEOPLE_BASE_SQL, _doubles, people_records, raw_items, raw_orders, table
from .reports import CHANGE

OTHER = "CASE system WHEN 'LEGADO' THEN 'ECOM' ELSE 'LEGADO' END"
#: Reviews of lines: some name the other system, an order that is nowhere, or the next product.
REVIEW = {
    "review_id": "CASE WHEN item_id % 400 = 1 THEN item_id + 1 ELSE item_id END", "ref_system": f"CASE WHEN item_id % 11 = 0 THEN {OTHER} ELSE system END", "ref_id": "CASE WHEN item_id % 13 <> 5 THEN order_id ELSE order_id + 1000000000 END",
    "product_id": "CASE WHEN item_id % 7 = 3 THEN product_id + 1 ELSE product_id END", "item_id": "item_id",
}


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_items(spark, sf_dir).select(*(F.expr(x).alias(n) for n, x in REVIEW.items()), F.date_add(F.lit("1996-01-01").cast("date"), F.expr("int(item_id % 1200)")).alias("sent"))


def _orders_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their hour; ids divisible by 30 are in both systems."""
    o = raw_orders(spark, sf_dir).select("system", "order_id", F.col("order_date").alias("placed"))
    return o.unionByName(o.where("order_id % 30 = 0").select(F.expr(OTHER).alias("system"), "order_id", F.date_add("placed", 1).alias("placed")))


def _referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plausibility.referred(_reviews(spark, sf_dir), _orders_of_both(spark, sf_dir), raw_items(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id")), ("LEGADO", "ECOM"))


def review_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by declared system: whether their order is there, in the other system or nowhere, whether its lines have the
    product, and whether they were sent after it."""
    return plausibility.reference_counts(_referred(spark, sf_dir))


REVIEWS_SQL = f"""{BASE_SQL},
o2 AS (SELECT system, order_id, order_date AS placed FROM raw UNION ALL SELECT {OTHER}, order_id, order_date + 1 FROM raw WHERE order_id % 30 = 0),
rv AS (SELECT {", ".join(f"{x} AS {n}" for n, x in REVIEW.items())}, DATE '1996-01-01' + (item_id % 1200)::INT AS sent FROM items),
rf AS (
  SELECT rv.*, o.placed IS NOT NULL AS own, EXISTS (SELECT 1 FROM o2 x WHERE x.order_id = ref_id AND x.system <> ref_system) AS other, product_id IN (SELECT p_partkey FROM part) AS known,
    (ref_system, ref_id, product_id) IN (SELECT (system, order_id, product_id) FROM items) AS has, sent >= o.placed AS late
  FROM rv LEFT JOIN o2 o ON o.order_id = ref_id AND o.system = ref_system)"""
REFERENCES_SQL = f"""WITH {REVIEWS_SQL}
SELECT ref_system, count(*) AS n, count(*) FILTER (own) AS in_declared, count(*) FILTER (NOT own AND other) AS only_other, count(*) FILTER (own AND other) AS in_both, count(*) FILTER (NOT own AND NOT other) AS nowhere,
  count(*) FILTER (known) AS product_known, count(*) FILTER (has) AS product_in_order, count(*) FILTER (late) AS sent_after FROM rf GROUP BY 1"""

HOUR = "order_id * 37 % 24"


def channel_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system's channels: hours of their orders, those at night, freight, and shares before and after the change."""
    o = raw_orders(spark, sf_dir).select("system", F.col("raw_channel").alias("channel"), F.expr(HOUR).alias("hour"), "freight", "order_date")
    return _doubles(plausibility.channel_profile(o, F.col("order_date") >= F.lit(CHANGE).cast("date")))


_SHARE = "100 * count(*) FILTER ({0}) / nullif(sum(count(*) FILTER ({0})) OVER (PARTITION BY system), 0)"
CHANNEL_SQL = f"""WITH {BASE_SQL}, h AS (SELECT *, {HOUR} AS hour, order_date >= DATE '{CHANGE}' AS late FROM raw)
SELECT system, raw_channel AS channel, count(*) AS n, min(hour) AS hour_min, max(hour) AS hour_max, count(*) FILTER (hour >= 22 OR hour < 8) AS n_night, avg(freight) / 10000 AS freight_mean, (min(freight) / 10000)::DOUBLE AS freight_min, (max(freight) / 10000)::DOUBLE AS freight_max,
  count(*) FILTER (freight > 0) AS freight_positive, count(*) FILTER (freight = 0) AS freight_zero, count(*) FILTER (freight < 0) AS freight_negative, count(*) FILTER (freight = -10000) AS freight_minus_one,
  {_SHARE.format("NOT late")} AS before_percent, {_SHARE.format("late")} AS after_percent FROM h GROUP BY 1, 2"""


def mapping_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and products of each class of the mapping, and their share of the system's products."""
    p = conformed_products(spark, sf_dir).withColumn("category", F.concat_ws(" > ", "level1", "level2"))
    return plausibility.class_shares(p, "category").select("system", "mapping", "n_labels", "n_products", "percent")


CLASSES_SQL = f"""SELECT system, mapping, count(DISTINCT concat_ws(' > ', level1, level2)) AS n_labels, count(*) AS n_products, 100 * count(*) / sum(count(*)) OVER (PARTITION BY system) AS percent FROM ({PRODUCTS_SQL}) GROUP BY 1, 2"""

#: Review files' raw ratings and clocks, and the days between which customers can have signed up.
RATING = "CASE WHEN item_id % 9 = 0 THEN NULL ELSE item_id % 7 END"
SIGN_UPS = ("2023-01-10", "2023-04-05")


def source_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, anomaly, n, base, percent) of the review file, of sign-ups out of range, and of records and reviews that any
    of their criteria holds for."""
    k = F.col("item_id")
    reviews = _reviews(spark, sf_dir).withColumn("rating", F.expr(RATING))
    tests = {"rating absent": F.col("rating").isNull(), "rating as text": k % 5 == 0, "rating off the scale": ~F.col("rating").between(1, 5), "verified absent": k % 8 == 0, "no offset": k % 6 == 1}
    day = F.col("signed_up")
    people = people_records(spark, sf_dir)
    first, last = (F.lit(d).cast("date") for d in SIGN_UPS)
    signs = {"signed up too early": day < first, "signed up too late": day > last, "no tax id": F.col("tax_id").isNull(), "no e-mail": F.col("email").isNull(), "place is a sentinel": F.col("city") == "N/A"}
    named = lambda source, df, t: diagnostics.anomalies(df, plausibility.any_of(t)).select(F.lit(source).alias("source"), "anomaly", F.col("lower").alias("n"), "base")
    again = profile.duplicates(reviews, ["review_id"]).select(F.col("n_rows").alias("n")).crossJoin(reviews.agg(F.count("*").alias("base")))  # one row each
    out = [named("REVIEWS", reviews, tests), again.select(F.lit("REVIEWS").alias("source"), F.lit("review id repeated").alias("anomaly"), "n", "base")]
    out += [named(s, people.where(F.col("system") == s[0]), signs) for s in ("LEGADO", "ECOM")]
    return reduce(DataFrame.unionByName, out).withColumn("percent", F.try_divide(100.0 * F.col("n"), F.col("base")))


def _source_sql() -> str:
    tests = {"rating absent": "rating IS NULL", "rating as text": "item_id % 5 = 0", "rating off the scale": "rating NOT BETWEEN 1 AND 5", "verified absent": "item_id % 8 = 0", "no offset": "item_id % 6 = 1"}
    signs = {"signed up too early": f"signed_up < DATE '{SIGN_UPS[0]}'", "signed up too late": f"signed_up > DATE '{SIGN_UPS[1]}'", "no tax id": "tax IS NULL", "no e-mail": "email IS NULL", "place is a sentinel": "node % 5 = 0"}
    either = lambda t: t | {"any of these": " OR ".join(f"coalesce({x}, false)" for x in t.values())}
    rows = lambda s, t, tests: [f"SELECT '{s}' AS source, '{n}' AS anomaly, count(*) FILTER ({x}) AS n, count(*) AS base FROM {t}" for n, x in tests.items()]
    out = rows("REVIEWS", f"(SELECT *, {RATING} AS rating FROM rv)", either(tests) | {"review id repeated": "review_id IN (SELECT review_id FROM rv GROUP BY 1 HAVING count(*) > 1)"})
    out += [x for s in ("LEGADO", "ECOM") for x in rows(s, f"(SELECT * FROM k WHERE system = '{s[0]}')", either(signs))]
    return f"WITH {PEOPLE_BASE_SQL}, {REVIEWS_SQL}, a AS ({' UNION ALL '.join(out)}) SELECT *, 100.0 * n / nullif(base, 0)::DOUBLE AS percent FROM a"


#: Of three persons, one is in the old register only, one in the shop's only.
REGISTER = "CASE floor(node / 4) % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'E' ELSE system END"


def bounded_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only the sources together show, as bounds: customers of both systems, tickets and reviews that name the wrong
    system or order, and orders whose day at the edges of the target depends on the clock."""
    records = identity.nodes(people_records(spark, sf_dir))
    known = records.select(F.col("node").alias("user_id"), "tax")
    k = F.col("event_id")
    tickets = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(k % 3 == 0, "ECOM").otherwise("LEGADO").alias("declared")).join(known, "user_id", "left").withColumn("tax", F.when(k % 10 != 0, F.col("tax")))
    registers = records.withColumn("system", F.expr(REGISTER))
    product_elsewhere = ~F.col("product_in_order")
    day, hour = F.col("order_date"), F.expr(HOUR)
    edge = lambda d: ((day == d) & (hour >= 21), ((day == d) & (hour >= 20)) | ((day == F.date_add(d, 1)) & (hour < 4)))
    orders = raw_orders(spark, sf_dir)
    edges = {name: edge(F.lit(d).cast("date")) for name, d in (("day at the cut by the clock", CUT), ("day at the end by the clock", END))}
    out = [
        plausibility.bounds("customers of both systems", *plausibility.with_counterpart(records, "L")),
        plausibility.bounds("tickets of the other system", *plausibility.claimed_system(tickets, registers, {"LEGADO": "L", "ECOM": "E"})),
        plausibility.bounds("reviews of a product not in the order", _referred(spark, sf_dir), product_elsewhere, product_elsewhere),
        diagnostics.anomalies(orders, edges).withColumnRenamed("anomaly", "estimate"),
    ]
    percent = lambda c: F.try_divide(100.0 * F.col(c), F.col("base")).alias(f"{c}_percent")
    return reduce(DataFrame.unionByName, out).select("*", percent("lower"), percent("upper"))


def _bounds_sql() -> str:
    edge = lambda name, d: f"SELECT '{name}' AS estimate, count(*) FILTER (order_date = DATE '{d}' AND hour >= 21) AS lower, count(*) FILTER ((order_date = DATE '{d}' AND hour >= 20) OR (order_date = DATE '{d}' + 1 AND hour < 4)) AS upper, count(*) AS base FROM (SELECT *, {HOUR} AS hour FROM raw)"
    return f"""WITH {PEOPLE_BASE_SQL}, {REVIEWS_SQL},
kr AS (SELECT *, coalesce(region, '') AS place, coalesce(ok AND tax IN (SELECT tax FROM k WHERE ok AND system = 'L' INTERSECT SELECT tax FROM k WHERE ok AND system = 'E'), false) AS pair FROM k),
el AS (SELECT folded, place, ok FROM kr WHERE system = 'E' AND NOT pair),
bo AS (SELECT pair, NOT pair AND EXISTS (SELECT 1 FROM el WHERE el.folded = kr.folded AND el.place = kr.place AND NOT (kr.ok AND el.ok)) AS maybe FROM kr WHERE system = 'L'),
tk AS (SELECT event_id % 3 = 0 AS shop, CASE WHEN event_id % 10 <> 0 THEN tax END AS tax FROM events LEFT JOIN k ON node = user_id),
ts AS (SELECT shop, coalesce(tax IN (SELECT tax FROM k WHERE tax IS NOT NULL AND {REGISTER} = 'L'), false) AS l, coalesce(tax IN (SELECT tax FROM k WHERE tax IS NOT NULL AND {REGISTER} = 'E'), false) AS e FROM tk),
a AS (
  SELECT 'customers of both systems' AS estimate, count(*) FILTER (pair) AS lower, count(*) FILTER (pair OR maybe) AS upper, count(*) AS base FROM bo
  UNION ALL SELECT 'tickets of the other system', count(*) FILTER (CASE WHEN shop THEN l AND NOT e ELSE e AND NOT l END), count(*) FILTER (l = e OR CASE WHEN shop THEN l AND NOT e ELSE e AND NOT l END), count(*) FROM ts
  UNION ALL SELECT 'reviews of a product not in the order', count(*) FILTER (NOT has), count(*) FILTER (NOT has), count(*) FROM rf
  UNION ALL {edge("day at the cut by the clock", CUT)} UNION ALL {edge("day at the end by the clock", END)})
SELECT *, 100.0 * lower / nullif(base, 0)::DOUBLE AS lower_percent, 100.0 * upper / nullif(base, 0)::DOUBLE AS upper_percent FROM a"""


CONSTANTS = {90.0: "days of the target", 0.5: "threshold"}


def number_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of report on each nation's customers, with numbers that were measured, constants and some that are wrong, and
    what the report's own table says of each."""
    table_ = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("balance"), (F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("debtors"))
    brazil = lambda c: F.translate(c, ".,", ",.")
    wrong = F.when(F.col("nation") % 5 == 0, F.col("balance") + 0.07).otherwise(F.col("balance"))
    line = F.concat(
        F.lit("# Report 99\nOn 2024-05-06, RDT-12: "), brazil(F.format_number("n", 0)), F.lit(" customers with "), brazil(F.format_number(wrong, 2)), F.lit(" in all, "), brazil(F.format_number(F.col("debtors") * 100, 1)), F.lit(" % of them below `0,3`, in 90 days;\n1. at 0,5 and 77777 "), F.col("nation").cast("string"), F.lit("x."),
    )
    numbers = verification.numbers_of(table_.select(F.col("nation").alias("doc"), line.alias("text")))
    out = verification.verified(numbers, verification.measured(table_.drop("nation"), "nations", F.lit("")), CONSTANTS)
    return out.select(F.col("doc").cast("long").alias("doc"), F.col("line").cast("long").alias("line"), F.col("number").cast("double").alias("number"), F.col("places").cast("long").alias("places"), "verdict")


NUMBERS_SQL = """WITH t AS (SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal::DECIMAL(18, 2))::DOUBLE, 2) AS balance, count(*) FILTER (c_acctbal < 0) / count(*) AS debtors FROM customer GROUP BY 1),
v AS (SELECT unnest([n::DOUBLE, balance, debtors]) AS v FROM t UNION ALL SELECT count(*)::DOUBLE FROM t),
c AS (SELECT abs(v) AS c FROM v UNION SELECT 100 * v FROM v),
x AS (
  SELECT nation, 2 AS line, n::DOUBLE AS number, 0 AS places FROM t UNION ALL SELECT nation, 2, round(balance + CASE WHEN nation % 5 = 0 THEN 0.07 ELSE 0 END, 2), 2 FROM t UNION ALL SELECT nation, 2, round(debtors * 100, 1), 1 FROM t
  UNION ALL SELECT nation, 2, 90, 0 FROM t UNION ALL SELECT nation, 3, 0.5, 1 FROM t UNION ALL SELECT nation, 3, 77777, 0 FROM t)
SELECT nation::BIGINT AS doc, line::BIGINT AS line, number, places::BIGINT AS places, CASE WHEN places < 2 AND abs(number) IN (90, 0.5) THEN 'constant'
  WHEN EXISTS (SELECT 1 FROM c WHERE CASE WHEN places = 0 THEN abs(c - abs(number)) <= 1e-9 ELSE abs(c - abs(number)) <= 0.5 / 10 ** places + 1e-9 END) THEN 'found' ELSE 'missing' END AS verdict FROM x"""


ALL = {review_references: REFERENCES_SQL, channel_hours: CHANNEL_SQL, mapping_classes: CLASSES_SQL, source_anomalies: _source_sql(), bounded_estimates: _bounds_sql(), number_verification: NUMBERS_SQL}
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {f.__name__: sql for f, sql in ALL.items()}
