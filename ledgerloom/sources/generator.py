"""Deterministic retail sources with planted defects, made by hashes of row numbers: any row can be made anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import check_digit

SEED = 20262


def unit(name: str, key: Column | str = "id") -> Column:
    """A number in [0, 1) for each key and name, the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit(name), key), F.lit(1 << 40)) / float(1 << 40)


def pick(name: str, values: list, key: Column | str = "id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(unit(name, key) * len(values)) + 1).cast("int"))


def tax_id(person: Column, valid: Column) -> Column:
    """Eleven digits of a person, masked; the last one is wrong where valid is false."""
    nine = F.lpad(F.pmod(person * 7919 + 123456, F.lit(10**9)).cast("string"), 9, "0")
    eleven = with_check_digits(nine, valid)
    return F.regexp_replace(eleven, r"^(...)(...)(...)(..)$", "$1.$2.$3-$4")


def with_check_digits(nine: Column, valid: Column) -> Column:
    """Nine digits with their two check digits, the last one wrong where valid is false. Each step is bound once."""
    once = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)
    ten = once(nine, lambda d: F.concat(d, check_digit(d, 9)))
    wrong = F.when(valid, 0).otherwise(1)
    return once(ten, lambda d: F.concat(d, F.pmod(check_digit(d, 10).cast("int") + wrong, F.lit(10)).cast("string")))


def customers(spark: SparkSession, n: int) -> DataFrame:
    """Records of two systems: a third of the legacy persons are shop customers too, 9 % of tax ids are invalid (the same
    in both), 8 % of legacy ones are missing, 2 % of cities say N/A, 3 % are near copies with accents and without a tax id, 2 % exact copies."""
    base = spark.range(n)
    legacy = unit("system") < 0.4
    person = F.when(legacy & (unit("shared") < 0.33), F.floor(F.col("id") * 7 / 10)).otherwise(F.col("id")).cast("long")
    rows = base.select("id", F.when(legacy, "L").otherwise("E").alias("system"), person.alias("person"))
    name = F.concat(pick("first", ["Jose", "Ana", "Joao", "Luisa"], "person"), F.lit(" da Silva "), F.col("person").cast("string"))
    rows = rows.select(
        F.col("id").alias("node"), "system", F.col("id").alias("source_id"), name.alias("name"),
        F.when((F.col("system") == "E") | (unit("no_tax") >= 0.08), tax_id(F.col("person"), unit("valid", "person") >= 0.09)).alias("tax_id"),
        F.concat(F.lit("p"), F.col("person").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+55 81 9"), F.lpad(F.col("person").cast("string"), 8, "0")).alias("phone"),
        F.when(unit("city") < 0.02, "N/A").otherwise(pick("town", ["Recife", "Olinda", "Natal"], "person")).alias("city"),
        pick("region", ["PE", "RN", "SP"], "person").alias("region"), F.date_add(F.lit("2022-12-01").cast("date"), F.floor(unit("day") * 900).cast("int")).alias("signed_up"),
    )
    near = rows.where("system = 'L'").where(unit("near", "node") < 0.03).withColumns({"node": F.col("node") + n, "source_id": F.col("source_id") + n, "name": F.concat(F.lit(" "), F.replace("name", F.lit("Jose"), F.lit("José"))), "tax_id": F.lit(None).cast("string")})
    copies = rows.where("system = 'L'").where(unit("copy", "node") < 0.02).withColumns({"node": F.col("node") + 2 * n, "source_id": F.col("source_id") + 2 * n})
    return rows.unionByName(near).unionByName(copies)


def orders(spark: SparkSession, n: int, n_customers: int) -> DataFrame:
    """Raw orders: 0.8 % delivered before they were placed, 1 % of deliveries on 1900-01-01, 0.3 % with negative freight."""
    system = F.when(unit("system") < 0.35, "LEGADO").otherwise("ECOM")
    rows = spark.range(n).select("id", system.alias("system"))
    old = F.col("system") == "LEGADO"
    placed = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(unit("day") * 1000).cast("int"))
    done = unit("status") < 0.7
    status = F.when(done, F.when(old, "ENTREGUE").otherwise("delivered")).when(old, pick("s", ["EM TRANSITO", "SEPARACAO", "CANCELADO"])).otherwise(pick("s", ["shipped", "processing", "canceled", "payment_declined"]))
    delivery = F.when(unit("late") < 0.008, F.date_sub(placed, 2)).when(unit("late") < 0.018, F.lit("1900-01-01").cast("date")).otherwise(F.date_add(placed, F.floor(unit("days") * 20).cast("int") + 1))
    freight = F.when(unit("negative") < 0.003, -5.0).otherwise(F.round(unit("freight") * 40, 2)).cast("decimal(18,4)")
    return rows.select(
        "system", F.col("id").alias("order_id"), F.floor(unit("customer") * n_customers).cast("long").alias("customer_id"), status.alias("raw_status"),
        F.when(old, pick("c", ["LOJA", "TELEVENDAS", "SITE"])).otherwise(pick("c", ["web", "app", "marketplace"])).alias("raw_channel"), placed.alias("order_date"), F.when(done, delivery).alias("delivery_date"), freight.alias("freight"),
    )


def items(orders: DataFrame) -> DataFrame:
    """One to four lines an order; 1 % of legacy discounts are -1, and 1.5 % of lines name an order that is not there."""
    lines = orders.select("system", "order_id", F.explode(F.sequence(F.lit(1), (F.floor(unit("lines", "order_id") * 4) + 1).cast("int"))).alias("line"))
    key = F.col("order_id") * 10 + F.col("line")
    price = F.round(5 + unit("price", key) * 400, 2).cast("decimal(14,2)")
    discount = F.when((F.col("system") == "LEGADO") & (unit("absent", key) < 0.01), -1).otherwise(F.when(unit("cut", key) < 0.3, F.round(price * 0.1, 2)).otherwise(0)).cast("decimal(18,4)")
    return lines.select("system", key.alias("item_id"), F.when(unit("orphan", key) < 0.015, F.col("order_id") + 10**9).otherwise(F.col("order_id")).alias("order_id"), F.floor(unit("product", key) * 500).cast("long").alias("product_id"), (F.floor(unit("qty", key) * 3) + 1).cast("int").alias("quantity"), price.alias("unit_price"), discount.alias("discount"))


def products(spark: SparkSession, n: int) -> DataFrame:
    """Products with skewed prices, of which 0.15 % are ten times too high, and categories as free text."""
    shape = -F.log(1 - unit("p1")) - F.log(1 - unit("p2"))  # a gamma variable: two exponential ones
    price = F.round(20 + 60 * shape, 2)
    label = pick("label", ["TV e Som", "Eletro", "celulares", "MÓVEIS", "Esporte", "Diversos", "informatica", " games "])
    return spark.range(n).select(
        F.col("id").alias("product_id"), F.concat(F.lit("Item "), F.col("id").cast("string")).alias("description"), label.alias("label"),
        F.when(unit("outlier") < 0.0015, price * 10).otherwise(price).cast("decimal(14,2)").alias("list_price"),
    )


def tickets(spark: SparkSession, n: int, n_customers: int) -> DataFrame:
    """Service tickets as text: 6 % without a closing day, 0.4 % negative hours, 9 % of ratings blank and 3 % zero, 1.5 %
    with a line break in the reason, 1.2 % of lines twice."""
    opened = F.date_add(F.lit("2023-01-01").cast("date"), F.floor(unit("opened") * 1000).cast("int"))
    days = F.floor(unit("days") * 6).cast("int")
    brazil = lambda d: F.date_format(d, "dd/MM/yyyy")
    hours = F.when(unit("negative") < 0.004, -5.5).otherwise(F.round(24 * days + unit("hours") * 10, 1))
    reason = pick("reason", ["Troca", "Devolução", "Elogio", "Atraso na entrega", "Cobrança indevida"])
    rows = spark.range(n).select(
        F.format_string("P%08d", F.col("id")).alias("protocol"), tax_id(F.floor(unit("customer") * n_customers).cast("long"), F.lit(True)).alias("tax_id"), brazil(opened).alias("opened"),
        F.when(unit("open") < 0.06, "").otherwise(brazil(F.date_add(opened, days))).alias("closed"), pick("way", [" fone ", "Web", "E-MAIL"]).alias("channel"),
        F.when(unit("break") < 0.015, F.concat(reason, F.lit("\nobs: cliente reiterou o contato"))).otherwise(reason).alias("reason"),
        F.when(unit("blank") < 0.09, "").when(unit("blank") < 0.12, "0").otherwise((F.floor(unit("rating") * 5) + 1).cast("string")).alias("rating"), F.replace(hours.cast("string"), F.lit("."), F.lit(",")).alias("hours"),
    )
    return rows.unionByName(rows.where(F.pmod(F.xxhash64("protocol"), F.lit(1000)) < 12))


def reviews(spark: SparkSession, n: int, n_orders: int) -> DataFrame:
    """Reviews as lines of JSON (value): 10 % of ratings are text and 3 % missing, 20 % of times have no offset, some keys are optional."""
    legacy = unit("system") < 0.35
    number = F.floor(unit("order") * n_orders).cast("long").cast("string")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    rating = (F.floor(unit("rating") * 5) + 1).cast("string")
    fields = [
        F.concat(F.lit('"review_id":'), quoted(F.concat(F.lit("R"), F.col("id").cast("string")))),
        F.when(unit("ref") >= 0.1, F.concat(F.lit('"order":{"ref":'), quoted(F.concat(F.when(legacy, "LEG-").otherwise("ECOM-"), number)), F.lit("}"))),
        F.concat(F.lit('"product":{"sku":'), quoted(F.concat(F.when(legacy, "LEG-").otherwise("SKU-"), number)), F.lit("}")),
        F.concat(F.lit('"submitted_at":'), quoted(F.concat(F.date_format(F.timestamp_seconds(F.lit(1672531200) + F.floor(unit("time") * 86_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss"), F.when(unit("offset") < 0.2, "").otherwise("-03:00")))),
        F.when(unit("rated") >= 0.03, F.concat(F.lit('"rating":'), F.when(unit("text") < 0.1, quoted(rating)).otherwise(rating))),
        F.when(unit("votes") < 0.5, F.concat(F.lit('"helpful_votes":'), F.floor(unit("v") * 20).cast("string"))),
    ]
    return spark.range(n).select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("value"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): the rows of each table of a run."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in tables.items()))
