"""Registered audits of the retail tables: keys, sets, coverage, semantics, conservation and leaks, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import dates, numbers, text
from .operators import models, profile
from .plans import conform, diagnostics, star
from .plans import features as feat
from .queries import BASE_SQL, CUT, END, TARGET_SQL, _doubles, _features_sql, customer_features, people_records, raw_items, raw_orders, star_tables, table
from .storage import saved, tasks_for_rows

#: Labels that stand for the legacy system's free text (fixed values).
LABELS = ["TV e Som", " Eletro-Domésticos ", "CELULARES", "Móveis", "diversos", "Informática e Games", "esporte", "something else"]
REASONS = ["Troca", "ELOGIO", "Produto não recebido", "atraso na entrega\nobs: cliente reiterou o contato", "nothing known"]


def conformed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of both systems: legacy labels by the map, the shop's categories by a two-level tree (self join)."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    legacy = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("description"), F.when(F.col("p_partkey") % 9 < 8, label).alias("label"))
    shop = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("product_id"), F.col("s_name").alias("description"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey") % 5).otherwise(F.col("s_nationkey") + 100).alias("category_id"))
    child = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("category_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    root = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    return conform.products(legacy, shop, child.unionByName(root))


_LABELS_SQL = ", ".join("({!r}, {}, {}, {!r})".format(k, *(repr(x) if x else "NULL" for x in v[:2]), v[2]) for k, v in conform.CATEGORY_MAP.items())
PRODUCTS_SQL = f"""WITH map(label, level1, level2, mapping) AS (VALUES {_LABELS_SQL}),
l AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 9 < 8 THEN ({LABELS!r})[1 + p_partkey % 9] ELSE '' END AS label FROM part),
c AS (SELECT n_nationkey + 100 AS id, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region)
SELECT 'LEGADO' AS system, p_partkey AS product_id, p_name AS description, level1, level2, coalesce(mapping, 'sem_mapeamento') AS mapping FROM l LEFT JOIN map ON map.label = lower(trim(strip_accents(l.label)))
UNION ALL SELECT 'ECOM', s_suppkey, s_name, coalesce(p.name, c.name), CASE WHEN p.name IS NOT NULL THEN c.name END, 'taxonomia_origem'
FROM supplier LEFT JOIN c ON c.id = CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey % 5 ELSE s_nationkey + 100 END LEFT JOIN c p ON p.id = c.parent"""


def conformed_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service tickets from text columns: first line of a protocol, customer by an unambiguous tax id, recoded reasons."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    day = F.date_format("ts", "dd/MM/yyyy")
    raw = e.select(
        F.floor(k / 3 * 2).cast("string").alias("protocol"), F.format_string("%03d.%03d", F.col("user_id") % 1000, k % 2).alias("tax_id"), F.when(k % 10 == 0, "31/02/2024").otherwise(day).alias("opened"), F.when(k % 3 == 0, "").otherwise(day).alias("closed"),
        F.when(k % 2 == 0, " web ").otherwise("Fone").alias("channel"), F.element_at(F.array(*map(F.lit, REASONS)), (k % 5 + 1).cast("int")).alias("reason"), F.when(k % 4 != 0, (k % 7).cast("string")).alias("rating"),
        F.concat((k % 50 - 3).cast("string"), F.lit(",5")).alias("hours"), k.alias("line"),
    )
    c = table(spark, sf_dir, "customer").select(F.format_string("%03d%03d", F.col("c_custkey") % 1000, F.lit(0)).alias("tax_id"), F.col("c_custkey").alias("customer_key"))
    return _doubles(conform.tickets(raw, c))


TICKETS_SQL = f"""WITH e AS (SELECT *, floor(event_id / 3 * 2)::BIGINT::VARCHAR AS protocol FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY protocol ORDER BY event_id) = 1),
o AS (SELECT lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '000' AS tax, min(c_custkey) AS least, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1)
SELECT protocol, CASE WHEN n = 1 THEN least END AS customer_key, coalesce(n > 1, false) AS tax_id_ambiguous, CASE WHEN event_id % 10 <> 0 THEN ts::DATE END AS opened, CASE WHEN event_id % 3 <> 0 THEN ts::DATE END AS closed,
  CASE WHEN event_id % 2 = 0 THEN 'WEB' ELSE 'FONE' END AS channel, (['TROCA', 'ELOGIO', 'PRODUTO_NAO_RECEBIDO', 'ATRASO_ENTREGA', NULL])[1 + event_id % 5] AS reason, event_id % 5 = 3 AS reiterated,
  CASE WHEN event_id % 4 <> 0 AND event_id % 7 BETWEEN 1 AND 5 THEN event_id % 7 END AS rating, event_id % 4 <> 0 AND event_id % 7 = 0 AS rating_zero,
  CASE WHEN event_id % 50 >= 3 THEN event_id % 50 - 3 + 0.5 END::DOUBLE AS hours, event_id % 50 < 3 AS hours_negative
FROM f LEFT JOIN o ON o.tax = lpad((user_id % 1000)::VARCHAR, 3, '0') || '00' || (event_id % 2)"""


def coalesce_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on the first key that is there, of two that exclude each other, and on a name in either case."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("old_id"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")).alias("new_id"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_lines"))
    return p.join(lines, F.coalesce("old_id", "new_id") == F.col("l_partkey")).select("p_partkey", "n_lines")


COALESCE_SQL = "SELECT l_partkey AS p_partkey, count(*) AS n_lines FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1"


def side_predicate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose condition also limits one side: only the shop's rows find their order, the others stay alone."""
    f = raw_orders(spark, sf_dir).select("system", "order_id", "raw_status")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return f.join(o, (F.col("system") == "ECOM") & (F.col("order_id") == F.col("o_orderkey")), "left").groupBy("system", "o_orderpriority").agg(F.count("*").alias("n"))


SIDE_SQL = f"WITH {BASE_SQL} SELECT system, o_orderpriority, count(*) AS n FROM raw LEFT JOIN orders ON system = 'ECOM' AND order_id = o_orderkey GROUP BY 1, 2"


def list_price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose unit price is many times the list price: an equi join with a theta residual."""
    lines = raw_items(spark, sf_dir).select("item_id", "product_id", "unit_price")
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.floor(F.col("p_retailprice") * 10).cast("decimal(14,2)").alias("list_price"))
    return _doubles(diagnostics.price_outliers(lines, prices, "product_id", 2).groupBy("product_id").agg(F.count("*").alias("n"), F.max("unit_price").alias("greatest")))


OUTLIERS_SQL = f"""WITH {BASE_SQL} SELECT product_id, count(*) AS n, (max(cents) / 100.0)::DOUBLE AS greatest FROM items JOIN part ON p_partkey = product_id WHERE cents >= 200 * floor(p_retailprice * 10)::BIGINT GROUP BY 1"""


def declared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets by what their declared order is: in their own system, in the other only, in both, or nowhere; whether it is
    the ticket's customer's, and whether it was placed before. The date comes from the system that has the order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("placed"))
    own, other = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
    t = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3000).alias("ref"), F.date_sub(F.to_date("ts"), 9500).alias("opened"))
    a, b = (x.select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias(f"customer_{s}"), F.col("placed").alias(f"placed_{s}")) for x, s in ((own, "own"), (other, "other")))
    both = t.join(a, "ref", "left").join(b, "ref", "left")
    place = F.when(F.col("placed_own").isNotNull() & F.col("placed_other").isNotNull(), "both").when(F.col("placed_own").isNotNull(), "own").when(F.col("placed_other").isNotNull(), "other").otherwise("nowhere")
    placed, owner = F.coalesce("placed_own", "placed_other"), F.coalesce("customer_own", "customer_other")
    return both.groupBy(place.alias("found")).agg(F.count("*").alias("n"), F.count_if(owner == F.col("user_id")).alias("n_same_customer"), F.count_if(F.col("opened") >= placed).alias("n_after"))


DECLARED_SQL = """WITH t AS (SELECT user_id, event_id % 3000 AS ref, ts::DATE - 9500 AS opened FROM events),
j AS (SELECT t.*, o_custkey, o_orderdate::DATE AS placed, o_orderkey % 2 = 0 AS own, o_orderkey % 3 = 0 AS other FROM t LEFT JOIN orders ON o_orderkey = ref AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0))
SELECT CASE WHEN placed IS NULL THEN 'nowhere' WHEN own AND other THEN 'both' WHEN own THEN 'own' ELSE 'other' END AS found, count(*) AS n, count(*) FILTER (o_custkey = user_id) AS n_same_customer, count(*) FILTER (opened >= placed) AS n_after FROM j GROUP BY 1"""


def delivery_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by days to delivery, -1 where there is none, and how many of a duration in hours fit those days."""
    o = star_tables(spark, sf_dir)[0]
    hours = F.col("order_id") % 900
    fits = dates.hours_fit_days(hours, F.col("delivery_days"))
    return o.groupBy(F.coalesce("delivery_days", F.lit(-1)).cast("long").alias("days")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(fits, F.lit(False))).alias("n_fit"))


HISTOGRAM_SQL = f"WITH {BASE_SQL} SELECT coalesce(delivery_days, -1)::BIGINT AS days, count(*) AS n, count(*) FILTER (abs(order_id % 900 - 24 * delivery_days) < 24) AS n_fit FROM facts GROUP BY 1"


def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formula without freight leaves unexplained of each total."""
    o = star_tables(spark, sf_dir)[0]
    return _doubles(diagnostics.residuals(o, F.round(F.col("total") - F.col("goods") + F.col("discount"), 2)))


RESIDUAL_SQL = f"WITH {BASE_SQL} SELECT (freight / 10000.0)::DOUBLE AS residual, count(*) AS n FROM facts GROUP BY 1"


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in repeated keys, surplus rows and repeated keys of the lines, by order and line number."""
    return profile.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATES_SQL = "SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, coalesce(sum(n - 1), 0)::BIGINT AS n_surplus, count(*) AS n_groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"


def monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each month in both systems, months that one of them lacks included."""
    o = raw_orders(spark, sf_dir).groupBy("system", F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    a, b = (o.where(F.col("system") == s).select("month", *(F.col(c).alias(f"{c}_{s.lower()}") for c in ("n", "first", "last"))) for s in ("LEGADO", "ECOM"))
    return a.join(b, "month", "full")


COVERAGE_SQL = f"""WITH {BASE_SQL}, m AS (SELECT system, strftime(order_date, '%Y-%m') AS month, order_date AS d FROM raw)
SELECT month, nullif(count(*) FILTER (system = 'LEGADO'), 0) AS n_legado, min(d) FILTER (system = 'LEGADO') AS first_legado, max(d) FILTER (system = 'LEGADO') AS last_legado,
  nullif(count(*) FILTER (system = 'ECOM'), 0) AS n_ecom, min(d) FILTER (system = 'ECOM') AS first_ecom, max(d) FILTER (system = 'ECOM') AS last_ecom FROM m GROUP BY 1"""


def beyond_other_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name an order beyond the greatest of the table: a scalar subquery as a threshold."""
    o, lines = raw_orders(spark, sf_dir).where("order_id % 4 = 0"), table(spark, sf_dir, "lineitem")
    return lines.where(F.col("l_orderkey") > o.agg(F.max("order_id")).scalar()).groupBy("l_orderkey").agg(F.count("*").alias("n"))


BEYOND_SQL = f"WITH {BASE_SQL} SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey > (SELECT max(order_id) FROM raw WHERE order_id % 4 = 0) GROUP BY 1"


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders and users of events as sets: shared, either, one only, and not in both."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("k"))
    parts = {"intersect": a.intersect(b), "union": a.union(b).distinct(), "except": a.exceptAll(b).distinct().subtract(b), "symmetric": a.subtract(b).union(b.subtract(a))}
    out = [df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("operation"), "*") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


SETS_SQL = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id * 3 AS k FROM events), j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ina, b.k IS NOT NULL AS inb FROM a FULL JOIN b ON a.k = b.k),
u AS (SELECT *, unnest([{'o': 'intersect', 't': ina AND inb}, {'o': 'union', 't': true}, {'o': 'except', 't': ina AND NOT inb}, {'o': 'symmetric', 't': ina <> inb}]) AS x FROM j)
SELECT x.o AS operation, count(*) AS n, sum(k)::BIGINT AS total FROM u WHERE x.t GROUP BY 1"""


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of each foreign key, null keys left out, against parents of which some rows are missing; the delivery's day is a nullable key of the calendar."""
    o, items, _, _ = star_tables(spark, sf_dir)
    facts = star.fact_item(items, star.fact_order(o.select("system", "order_id", "customer_id")))
    customers = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("customer_id"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("product_id"))
    calendar = dates.calendar(spark, "1990-01-01", "2000-12-31").select("day")
    checks = {
        "order to customer": star.orphans(o, customers, ["customer_id"]), "line to product": star.orphans(facts, parts, ["product_id"]), "line to order": star.orphans(facts, o.where("order_id % 9 <> 4").select("system", "order_id"), ["system", "order_id"]),
        "order to day": star.orphans(o.select(F.col("order_date").alias("day")), calendar, ["day"]), "delivery to day": star.orphans(o.select(F.col("delivery_date").alias("day")), calendar, ["day"]),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("key"), "n") for k, df in checks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])


FOREIGN_SQL = f"""WITH {BASE_SQL}
SELECT 'order to customer' AS key, count(*) AS n FROM facts WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
UNION ALL SELECT 'line to product', count(*) FROM items WHERE order_exists AND product_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)
UNION ALL SELECT 'line to order', count(*) FROM items WHERE order_exists AND order_id NOT IN (SELECT order_id FROM facts WHERE order_id % 9 <> 4)
UNION ALL SELECT 'order to day', count(*) FROM facts WHERE order_date NOT BETWEEN DATE '1990-01-01' AND DATE '2000-12-31'
UNION ALL SELECT 'delivery to day', count(*) FROM facts WHERE delivery_date NOT BETWEEN DATE '1990-01-01' AND DATE '2000-12-31'"""


def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines staged, loaded and in quarantine by system: none is lost, and those with an order are those loaded."""
    o, items, _, _ = star_tables(spark, sf_dir)
    items = saved(items, "items")
    loaded = star.fact_item(items, star.fact_order(o.select("system", "order_id", "customer_id"))).groupBy("system").agg(F.count("*").alias("n_loaded"))
    aside = star.quarantine(items).groupBy("system").agg(F.count("*").alias("n_quarantine"))
    staged = raw_items(spark, sf_dir).groupBy("system").agg(F.count("*").alias("n_staged"))
    with_order = raw_items(spark, sf_dir).join(raw_orders(spark, sf_dir).select("system", "order_id"), ["system", "order_id"], "left_semi").groupBy("system").agg(F.count("*").alias("n_with_order"))
    out = staged.join(loaded, "system", "left").join(aside, "system", "left").join(with_order, "system", "left")
    return out.withColumns({"conserved": F.col("n_staged") == F.col("n_loaded") + F.col("n_quarantine"), "loaded_right": F.col("n_loaded") == F.col("n_with_order")})


CONSERVATION_SQL = """WITH l AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'LEGADO' ELSE 'ECOM' END AS system, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 40 <> 7) AS there FROM lineitem),
c AS (SELECT system, count(*) AS n_staged, count(*) FILTER (there) AS n_loaded, nullif(count(*) FILTER (NOT there), 0) AS n_quarantine, count(*) FILTER (there) AS n_with_order FROM l GROUP BY 1)
SELECT *, n_staged = n_loaded + n_quarantine AS conserved, n_loaded = n_with_order AS loaded_right FROM c"""


def target_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target twice, by aggregates and by sets: sizes, and customers on whom they differ."""
    o = star_tables(spark, sf_dir)[0]
    a = feat.target(o, CUT, END).where("y = 1").select("customer_id", F.lit(1).alias("a"))
    b = feat.positives_by_sets(o, CUT, END, F.col("status") == "CANCELADO").select("customer_id", F.lit(1).alias("b"))
    return a.join(b, "customer_id", "full").agg(F.count("a").alias("n_first"), F.count("b").alias("n_second"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_different"))


TARGET_SETS_SQL = f"""WITH {BASE_SQL}, {TARGET_SQL}, s AS (SELECT customer_id FROM facts WHERE order_date > DATE '{CUT}' AND order_date <= DATE '{END}' AND status <> 'CANCELADO' INTERSECT SELECT customer_id FROM facts WHERE order_date <= DATE '{CUT}')
SELECT (SELECT count(*) FROM target WHERE y = 1) AS n_first, (SELECT count(*) FROM s) AS n_second, (SELECT count(*) FROM (SELECT customer_id FROM target WHERE y = 1) t FULL JOIN s USING (customer_id) WHERE t.customer_id IS NULL OR s.customer_id IS NULL) AS n_different"""


def leak_confinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a leaking feature table may change and what it may not: same population and target, leak visible, counts never
    smaller, z scores of mean 0 and deviation 1 that give the value back, and every other column as it was. As a control the
    checks run on a table that breaks all of them as well."""
    others = [c for c in feat.FEATURES if c not in ("recency_days", "frequency")]
    o, items, products, tickets = star_tables(spark, sf_dir)
    tasks = tasks_for_rows(spark, table(spark, sf_dir, "lineitem").count())
    o = saved(feat.with_levels(o, items, products), "orders", tasks)
    right = saved(feat.features(o, items, products, tickets, CUT).join(feat.target(o, CUT, END), "customer_id"), "right")
    # the leaking table comes from a run of its own: features as of the cut, the target by sets, recency and frequency of all orders
    then = feat.as_of(o, items, tickets, CUT)
    positive = feat.positives_by_sets(o, CUT, END, F.col("status") == "CANCELADO").withColumn("leaky_y", F.lit(1))
    own = feat.features(then[0], then[1], products, then[2], CUT).join(positive, "customer_id", "left").join(feat.leaky(o, CUT), "customer_id", "left")
    leak = saved(feat.z_scores(own.withColumn("leaky_y", F.coalesce("leaky_y", F.lit(0))), "monetary"), "leak")
    k = F.col("customer_id")
    broken = leak.where(k % 50 != 3).withColumns(
        {"leaky_y": F.when(k % 7 == 0, 1 - F.col("leaky_y")).otherwise(F.col("leaky_y")), "main_channel": F.when(k % 11 == 0, "X").otherwise(F.col("main_channel")), "recency_days_leaky": F.abs("recency_days_leaky"), "frequency_leaky": F.lit(-1).cast("long"), "z": 2 * F.col("z") + 1}
    )
    checked = lambda name, table_: diagnostics.confinement(right, table_, "customer_id", "monetary", others).select(F.lit(name).alias("run"), "*")
    return checked("leak", leak).unionByName(checked("broken", broken))


_CHECKS = ["population differs", "target differs", "other columns differ", "recency below zero", "fewer orders than without", "z mean off", "z deviation off", "z not invertible"]
CONFINEMENT_SQL = f"""WITH {BASE_SQL}, {_features_sql()}, {TARGET_SQL}, r AS (SELECT * FROM f JOIN target USING (customer_id)),
l AS (SELECT customer_id, min(DATE '{CUT}' - order_date) AS recency, count(*) AS orders FROM facts WHERE effective GROUP BY 1),
z AS (SELECT customer_id, monetary, round((monetary - avg(monetary) OVER ()) / stddev_pop(monetary) OVER (), 6) AS z, avg(monetary) OVER () AS m, stddev_pop(monetary) OVER () AS s FROM r),
b AS (SELECT *, 2 * z + 1 AS w FROM z WHERE customer_id % 50 <> 3),
c AS (SELECT * FROM r WHERE customer_id % 50 <> 3),
x AS (
  SELECT 'leak' AS run, unnest({_CHECKS!r}) AS "check",
    unnest([(SELECT count(*) FROM f FULL JOIN (SELECT DISTINCT customer_id FROM facts WHERE order_date <= DATE '{CUT}') d USING (customer_id) WHERE f.customer_id IS NULL OR d.customer_id IS NULL),
      (SELECT count(*) FROM target t JOIN (SELECT customer_id, max((order_date > DATE '{CUT}' AND order_date <= DATE '{END}' AND effective)::INT) AS y FROM facts GROUP BY 1) o USING (customer_id) WHERE t.y <> o.y),
      0, (SELECT count(*) FROM r JOIN l USING (customer_id) WHERE recency < 0), (SELECT count(*) FROM r JOIN l USING (customer_id) WHERE orders < frequency), (SELECT (abs(avg(z)) > 1e-6)::INT FROM z), (SELECT (abs(stddev_pop(z) - 1) > 1e-5)::INT FROM z),
      (SELECT count(*) FROM z WHERE abs(z * s + m - monetary) > 1e-6 * s)])::BIGINT AS n
  UNION ALL SELECT 'broken', unnest({_CHECKS!r}),
    unnest([(SELECT count(*) FROM r) - (SELECT count(*) FROM c), (SELECT count(*) FROM c WHERE customer_id % 7 = 0), (SELECT count(*) FROM c WHERE customer_id % 11 = 0), 0, (SELECT count(*) FROM c),
      (SELECT (abs(avg(w)) > 1e-6)::INT FROM b), (SELECT (abs(stddev_pop(w) - 1) > 1e-5)::INT FROM b), (SELECT count(*) FROM b WHERE abs(w * s + m - monetary) > 1e-6 * s)])::BIGINT)
SELECT * FROM x"""


def period_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the side of the cut and target on which their day lies, in local time and in UTC, and those near midnight."""
    local = dates.local_clock(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(*(dates.side_of(c.cast("date"), "2024-01-10", "2024-01-20").cast("long").alias(n) for c, n in ((local, "side_local"), (F.col("ts"), "side_utc"))), dates.near_midnight(local).alias("near"))
    return e.groupBy("side_local", "side_utc").agg(F.count("*").alias("n"), F.count_if("near").alias("n_near_midnight"))


_SIDE = "CASE WHEN {0}::DATE <= DATE '2024-01-10' THEN 0 WHEN {0}::DATE <= DATE '2024-01-20' THEN 1 ELSE 2 END::BIGINT"
PERIODS_SQL = f"""WITH x AS (SELECT ts::TIMESTAMP AS u, ts::TIMESTAMP - INTERVAL 3 HOUR AS l FROM events)
SELECT {_SIDE.format("l")} AS side_local, {_SIDE.format("u")} AS side_utc, count(*) AS n, count(*) FILTER (hour(l) >= 20 OR hour(l) < 4) AS n_near_midnight FROM x GROUP BY 1, 2"""


def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate keys of the two systems' records: present, valid, distinct, repeated, shared, coverage each way, and
    agreement of name, e-mail and phone in pairs that share the key."""
    r = people_records(spark, sf_dir).select("system", text.fold_name(F.col("name")).alias("name"), text.digits(F.col("tax_id")).alias("tax_id"), text.tax_id_valid(F.col("tax_id")).alias("ok"), F.lower(F.trim("email")).alias("email"), text.phone_digits(F.col("phone")).alias("phone"))
    keys = {"tax_id": F.col("ok"), "email": F.col("email").rlike(r"^[^@]*[0-9]@[^@]+$"), "phone": F.length("phone").between(5, 11)}
    return _doubles(diagnostics.audit_keys(r, keys, "system", ("L", "E"), ["name", "email", "phone"]))


def _audit_sql(key: str, sql: str, valid: str) -> str:
    agree = ", ".join(f"(SELECT count(*) FROM k a JOIN k b ON a.{sql} = b.{sql} WHERE a.system = 'L' AND b.system = 'E' AND a.{c} = b.{c}) AS n_agree_{n}" for c, n in (("folded", "name"), ("email", "email"), ("phone", "phone")))
    return f"""SELECT '{key}' AS key, (SELECT count({sql}) FROM k) AS n_present, (SELECT count(*) FILTER ({valid}) FROM k) AS n_valid, (SELECT count(DISTINCT {sql}) FROM k) AS n_distinct, (SELECT count(*) FROM (SELECT {sql} FROM k WHERE {sql} IS NOT NULL GROUP BY system, {sql} HAVING count(*) > 1)) AS n_repeated,
  (SELECT count(*) FROM (SELECT {sql} FROM k WHERE {sql} IS NOT NULL GROUP BY {sql} HAVING count(DISTINCT system) = 2)) AS n_shared,
  (SELECT count(*) FILTER ({sql} IN (SELECT {sql} FROM k WHERE system = 'E')) FROM k WHERE system = 'L') AS n_left_covered, (SELECT count(*) FILTER ({sql} IN (SELECT {sql} FROM k WHERE system = 'L')) FROM k WHERE system = 'E') AS n_right_covered,
  (SELECT count(*) FROM k a JOIN k b ON a.{sql} = b.{sql} WHERE a.system = 'L' AND b.system = 'E') AS n_pairs, {agree}"""


def audit_sql() -> str:
    from .queries import PEOPLE_BASE_SQL

    return f"WITH {PEOPLE_BASE_SQL} " + " UNION ALL ".join(_audit_sql(*x) for x in (("tax_id", "tax", "ok"), ("email", "email", "email NOT LIKE '%b@%'"), ("phone", "phone", "length(phone) >= 5")))


def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that both systems use, for orders and for products."""
    o, p, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    out = [diagnostics.key_overlap(a, b, "k").select(F.lit(n).alias("entity"), "*") for n, a, b in (("customers", o.select(F.col("o_custkey").alias("k")), p.select(F.col("p_partkey").alias("k"))), ("products", p.select(F.col("p_partkey").alias("k")), s.select(F.col("s_suppkey").alias("k"))))]
    return out[0].unionByName(out[1])


_COLLISION = "SELECT '{0}' AS entity, (SELECT count(DISTINCT {1}) FROM {2}) AS n_left, (SELECT count(DISTINCT {3}) FROM {4}) AS n_right, (SELECT count(*) FROM (SELECT {1} FROM {2} INTERSECT SELECT {3} FROM {4})) AS n_both, (SELECT count(*) FROM ((SELECT {1} FROM {2} EXCEPT SELECT {3} FROM {4}) UNION ALL (SELECT {3} FROM {4} EXCEPT SELECT {1} FROM {2}))) AS n_difference"
COLLISIONS_SQL = _COLLISION.format("customers", "o_custkey", "orders", "p_partkey", "part") + " UNION ALL " + _COLLISION.format("products", "p_partkey", "part", "s_suppkey", "supplier")


def status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, with delivery dates and lines, their share of the channel, and freight."""
    o = star_tables(spark, sf_dir)[0]
    rows = o.groupBy("channel", "status").agg(F.count("*").alias("n"), F.count("delivery_date").alias("n_delivered"), F.count_if(F.col("units") > 0).alias("n_with_lines"), F.sum("freight").alias("freight"))
    return _doubles(rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("channel")), 6)))


STATUS_SQL = f"""WITH {BASE_SQL}, g AS (SELECT channel, status, count(*) AS n, count(delivery_date) AS n_delivered, count(*) FILTER (units > 0) AS n_with_lines, sum(freight) / 10000.0 AS freight FROM facts GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY channel), 6) AS share FROM g"""


def category_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of each folded label, and into how many categories each first word of a name goes."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.initcap("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("label"))
    return c.groupBy(text.fold_label(F.col("label")).alias("folded")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), "+").alias("variants"))


VARIANTS_SQL = """WITH c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) ELSE c_mktsegment END AS label FROM customer)
SELECT lower(label) AS folded, count(*) AS n, array_to_string(list_sort(list_distinct(list(label))), '+') AS variants FROM c GROUP BY 1"""


def noun_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of part names by the brands and types they are in."""
    return table(spark, sf_dir, "part").groupBy(text.part(F.col("p_name"), " ", 1).alias("noun")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("n_brands"), F.countDistinct("p_type").alias("n_types"))


NOUN_SQL = "SELECT string_split(p_name, ' ')[1] AS noun, count(*) AS n, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1"


def rating_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a rating that comes as text, number or not at all, inside its domain or not."""
    k = F.col("event_id")
    raw = F.when(k % 9 == 0, None).when(k % 5 == 0, F.concat((k % 8).cast("string"), F.lit(",0"))).otherwise((k % 8).cast("string"))
    e = table(spark, sf_dir, "events").select(raw.alias("raw"), numbers.comma_number(raw).alias("value"))
    kind = F.when(F.col("raw").isNull(), "absent").when(F.col("raw").contains(","), "text").otherwise("number")
    return e.groupBy(kind.alias("kind"), numbers.within(F.col("value"), 1, 5).cast("long").alias("rating")).agg(F.count("*").alias("n"))


RATING_SQL = """SELECT CASE WHEN event_id % 9 = 0 THEN 'absent' WHEN event_id % 5 = 0 THEN 'text' ELSE 'number' END AS kind, CASE WHEN event_id % 9 <> 0 AND event_id % 8 BETWEEN 1 AND 5 THEN event_id % 8 END AS rating, count(*) AS n FROM events GROUP BY 1, 2"""


def discount_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether discounts are a line's or a unit's: by quantity, discounts beyond the unit price, and their mean share of both."""
    lines = raw_items(spark, sf_dir).where("discount > 0").withColumn("line", F.col("quantity") * F.col("unit_price"))
    share = lambda under: F.round(F.avg(F.col("discount").cast("double") / F.col(under).cast("double")), 4)
    return lines.groupBy(F.col("quantity").cast("long").alias("quantity")).agg(F.count("*").alias("n"), F.count_if(F.col("discount") > F.col("unit_price")).alias("n_beyond_unit"), share("line").alias("of_line"), share("unit_price").alias("of_unit"))


DISCOUNT_SQL = f"""WITH {BASE_SQL} SELECT quantity, count(*) AS n, count(*) FILTER (discount > cents * 100) AS n_beyond_unit, round(avg(discount / goods), 4) AS of_line, round(avg(discount / (cents * 100)), 4) AS of_unit FROM items WHERE discount > 0 GROUP BY 1"""


def tax_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of tax ids by the year in which their records were made."""
    r = people_records(spark, sf_dir)
    shape = text.shape_mask(F.when(F.col("node") % 2 == 0, F.regexp_replace("tax_id", r"^(...)(...)(...)(..)$", "$1.$2.$3-$4")).otherwise(F.col("tax_id")))
    return r.groupBy(F.quarter("signed_up").cast("long").alias("quarter"), shape.alias("shape")).agg(F.count("*").alias("n"))


TAX_FORMATS_SQL = """SELECT quarter(DATE '2023-01-01' + (c_custkey % 100)::INT) AS quarter, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN '999.999.999-99' ELSE '99999999999' END AS shape, count(*) AS n FROM customer GROUP BY 1, 2"""


def top_values_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_by_column(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])


TOP3_SQL = " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 3)" for c in ("p_brand", "p_type", "p_name"))


def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified split against its base, and against a base with a customer more and a label that is turned."""
    base = saved(customer_features(spark, sf_dir).select("customer_id", "y"), "base")
    split = saved(models.stratified_split(base, "customer_id", "y"), "split")
    other = base.withColumn("y", F.when(F.col("customer_id") % 50 == 0, 1 - F.col("y")).otherwise(F.col("y"))).unionByName(spark.createDataFrame([(-1, 0)], "customer_id long, y long"))
    return models.partition_checks(split, base, "customer_id", "y").select(F.lit("base").alias("against"), "*").unionByName(models.partition_checks(split, other, "customer_id", "y").select(F.lit("changed base").alias("against"), "*"))


SPLIT_SQL = f"""WITH {BASE_SQL}, {TARGET_SQL}
SELECT unnest(['base', 'base', 'base', 'changed base', 'changed base', 'changed base']) AS against, unnest(['in both parts', 'in neither part', 'label differs', 'in both parts', 'in neither part', 'label differs']) AS "check",
  unnest([0, 0, 0, 0, 1, (SELECT count(*) FROM target WHERE customer_id % 50 = 0)])::BIGINT AS n"""


def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of each feature against what the registry of features allows."""
    return feat.null_census(customer_features(spark, sf_dir))


def null_census_sql() -> str:
    cells = ", ".join(f"{{'f': '{c}', 'n': count(*) - count({c}), 'o': {str(o).lower()}}}" for c, (_, _, o) in feat.REGISTRY.items())
    return f"WITH {BASE_SQL}, {_features_sql()}, u AS (SELECT unnest([{cells}]) AS x FROM f) SELECT x.f AS feature, x.n AS n_null, x.o AS may_be_null, x.o OR x.n = 0 AS allowed FROM u"


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share a name and region, or a city too, and how many of them share a valid tax id: what
    matching by name alone would have claimed."""
    r = people_records(spark, sf_dir).select("node", "system", text.fold_name(F.col("name")).alias("name"), "region", text.blank_to_null(text.sentinel_to_null(F.col("city"))).alias("city"), F.when(text.tax_id_valid(F.col("tax_id")), F.col("tax_id")).alias("tax"))
    return diagnostics.candidate_precision(r, {"name and region": ["name", "region"], "name, region and city": ["name", "region", "city"]}, "system", ("L", "E"), "tax")


def pairs_sql() -> str:
    from .queries import PEOPLE_BASE_SQL

    one = lambda label, on: f"SELECT '{label}' AS rule, count(*) AS n_pairs, count(*) FILTER (a.ok AND b.ok AND a.tax = b.tax) AS n_right, count(*) FILTER (a.ok AND b.ok AND a.tax <> b.tax) AS n_wrong FROM k a JOIN k b ON {on} WHERE a.system = 'L' AND b.system = 'E'"
    return f"WITH {PEOPLE_BASE_SQL} {one('name and region', 'a.folded = b.folded AND a.region = b.region')} UNION ALL {one('name, region and city', 'a.folded = b.folded AND a.region = b.region AND a.city = b.city')}"


ALL = {
    conformed_products: PRODUCTS_SQL, conformed_tickets: TICKETS_SQL, coalesce_key_join: COALESCE_SQL, side_predicate_join: SIDE_SQL, list_price_outliers: OUTLIERS_SQL, declared_orders: DECLARED_SQL, delivery_histogram: HISTOGRAM_SQL,
    residual_histogram: RESIDUAL_SQL, duplicate_lines: DUPLICATES_SQL, monthly_coverage: COVERAGE_SQL, beyond_other_system: BEYOND_SQL, key_sets: SETS_SQL, foreign_keys: FOREIGN_SQL, conservation: CONSERVATION_SQL, target_by_sets: TARGET_SETS_SQL,
    leak_confinement: CONFINEMENT_SQL, period_sides: PERIODS_SQL, key_audit: audit_sql(), id_collisions: COLLISIONS_SQL, status_matrix: STATUS_SQL, category_variants: VARIANTS_SQL, noun_dispersion: NOUN_SQL, rating_census: RATING_SQL,
    discount_semantics: DISCOUNT_SQL, tax_formats: TAX_FORMATS_SQL, top_values_by_column: TOP3_SQL, split_checks: SPLIT_SQL, null_census: null_census_sql(), candidate_pairs: pairs_sql(),
}
QUERIES = {f.__name__: f for f in ALL}
ORACLES = {f.__name__: sql for f, sql in ALL.items()}
