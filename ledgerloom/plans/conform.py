"""Conformance of orders, items, products, tickets and reviews of the two systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates, numbers, text

CANCELLED = "CANCELADO"
#: (system, raw status, conformed status, reason of the cancellation) (fixed values).
STATUS_MAP = [
    ("LEGADO", "ENTREGUE", "ENTREGUE", None),
    ("LEGADO", "EM TRANSITO", "EM_TRANSITO", None),
    ("LEGADO", "SEPARACAO", "EM_PROCESSAMENTO", None),
    ("LEGADO", "CANCELADO", "CANCELADO", None),
    ("ECOM", "delivered", "ENTREGUE", None),
    ("ECOM", "shipped", "EM_TRANSITO", None),
    ("ECOM", "processing", "EM_PROCESSAMENTO", None),
    ("ECOM", "canceled", "CANCELADO", "CANCELAMENTO"),
    ("ECOM", "payment_declined", "CANCELADO", "PAGAMENTO_RECUSADO"),
]
#: (system, raw channel, conformed channel) (fixed values).
CHANNEL_MAP = [
    ("LEGADO", "LOJA", "FISICO"),
    ("LEGADO", "TELEVENDAS", "TELEVENDAS"),
    ("LEGADO", "SITE", "ONLINE_PROPRIO"),
    ("ECOM", "web", "ONLINE_PROPRIO"),
    ("ECOM", "app", "ONLINE_PROPRIO"),
    ("ECOM", "marketplace", "MARKETPLACE"),
]
#: Folded category label: level 1, level 2, class (fixed values).
CATEGORY_MAP = {
    "televisores": ("Áudio e TV", "Televisores", "direto"),
    "moveis": ("Casa e Decoração", "Móveis", "direto"),
    "celulares": ("Telefonia", "Smartphones", "direto"),
    "celular/smartphone": ("Telefonia", "Smartphones", "direto"),
    "esporte": ("Esporte e Lazer", None, "direto"),
    "esportes e lazer": ("Esporte e Lazer", None, "direto"),
    "ferramentas": ("Ferramentas", None, "direto"),
    "ferramentas e construcao": ("Ferramentas", None, "direto"),
    "audio/video": ("Áudio e TV", None, "nivel"),
    "tv e som": ("Áudio e TV", None, "nivel"),
    "casa": ("Casa e Decoração", None, "nivel"),
    "casa e decoracao": ("Casa e Decoração", None, "nivel"),
    "telefonia": ("Telefonia", None, "nivel"),
    "eletrodomesticos": ("Eletrodomésticos", None, "nivel"),
    "eletro-domesticos": ("Eletrodomésticos", None, "nivel"),
    "games": ("Games", None, "nivel"),
    "games e consoles": ("Games", None, "nivel"),
    "info": ("Informática", None, "nivel"),
    "informatica": ("Informática", None, "nivel"),
    "eletro": (None, None, "ambiguo"),
    "informatica e games": (None, None, "ambiguo"),
    "diversos": (None, None, "sem_mapeamento"),
    "outros": (None, None, "sem_mapeamento"),
    "": (None, None, "sem_mapeamento"),
}
#: Folded ticket reason: class (fixed values).
REASON_MAP = {
    "atraso na entrega": "ATRASO_ENTREGA",
    "atraso entrega": "ATRASO_ENTREGA",
    "produto avariado": "PRODUTO_AVARIADO_OU_DEFEITUOSO",
    "produto com defeito": "PRODUTO_AVARIADO_OU_DEFEITUOSO",
    "produto nao recebido": "PRODUTO_NAO_RECEBIDO",
    "devolucao": "DEVOLUCAO",
    "troca": "TROCA",
    "troca de produto": "TROCA",
    "estorno nao realizado": "ESTORNO_NAO_REALIZADO",
    "cancelamento a pedido do cliente": "CANCELAMENTO_CLIENTE",
    "cancelamento cliente": "CANCELAMENTO_CLIENTE",
    "cobranca indevida": "COBRANCA_INDEVIDA",
    "endereco incorreto": "ENDERECO_INCORRETO",
    "duvida sobre pagamento": "DUVIDA_PAGAMENTO",
    "elogio": "ELOGIO",
}


def status_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS_MAP, "system string, raw_status string, status string, cancel_reason string")


def channel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNEL_MAP, "system string, raw_channel string, channel string")


def recode(x: Column, table: dict[str, str]) -> Column:
    """Value of a literal map; null where the key is unknown."""
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x)


def unmapped(raw: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    """Values that the map does not know, with their counts."""
    return raw.join(F.broadcast(mapping), on, "left_anti").groupBy(*on).agg(F.count("*").alias("n"))


def mended(raw: DataFrame) -> DataFrame:
    """raw (system, item_id, order_id, product_id, quantity, unit_price, discount) with discount -1 as 0 and a flag, and line value."""
    sentinel = F.col("discount") == -1
    return raw.withColumns(
        {"discount_absent": sentinel, "discount": F.when(sentinel, 0).otherwise(F.col("discount")).cast("decimal(18,4)"), "line_value": (F.col("quantity") * F.col("unit_price")).cast("decimal(18,4)")}
    )


def items(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """mended() lines, and whether the order exists. Lines are mended behind the join, so that what follows from other columns is not shuffled."""
    own = orders.select("system", "order_id").distinct().withColumn("_there", F.lit(True))
    there = raw.join(own, ["system", "order_id"], "left").withColumn("order_exists", F.col("_there").isNotNull()).drop("_there")
    return mended(there).select("system", "order_id", *(c for c in raw.columns if c not in ("system", "order_id")), "discount_absent", "line_value", "order_exists")


def orders(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """raw (system, order_id, customer_id, raw_status, raw_channel, order_date, delivery_date, freight) at order grain.

    lines are items(), or mended() lines that know no orders: these are summed where they are read, before any shuffle, and
    sums of orders that are not in raw meet none. Lines are summed before the join, so no order multiplies. A delivery on 1900-01-01 or before the order is null
    with a flag. total = goods - discount + freight, negative freight included and flagged.
    """
    spark = raw.sparkSession
    known_lines = lines.where("order_exists") if "order_exists" in lines.columns else lines
    sums = known_lines.groupBy("system", "order_id").agg(
        F.sum("quantity").cast("long").alias("units"), F.sum("line_value").alias("goods"), F.sum("discount").alias("discount"), F.max(F.col("discount_absent").cast("int")).cast("boolean").alias("discount_absent")
    )
    known = dates.not_sentinel(F.col("delivery_date"))
    real = dates.not_before(known, F.col("order_date"))
    zero = F.lit(0).cast("decimal(18,4)")
    return (
        raw.join(sums, ["system", "order_id"], "left")
        .join(F.broadcast(status_table(spark)), ["system", "raw_status"], "left")
        .join(F.broadcast(channel_table(spark)), ["system", "raw_channel"], "left")
        .withColumns(
            {
                "delivery_undated": F.coalesce(F.col("delivery_date").isNotNull() & known.isNull(), F.lit(False)),
                "delivery_too_early": F.coalesce(known < F.col("order_date"), F.lit(False)),
                "freight_negative": F.coalesce(F.col("freight") < 0, F.lit(False)),
                "units": F.coalesce("units", F.lit(0).cast("long")),
                "goods": F.coalesce("goods", zero).cast("decimal(18,4)"),
                "discount": F.coalesce("discount", zero).cast("decimal(18,4)"),
                "discount_absent": F.coalesce("discount_absent", F.lit(False)),
            }
        )
        .withColumns({"delivery_date": real, "delivery_days": F.datediff(real, F.col("order_date")), "total": (F.col("goods") - F.col("discount") + F.col("freight")).cast("decimal(18,4)"), "effective": F.col("status") != CANCELLED})
    )


def products(legacy: DataFrame, shop: DataFrame, categories: DataFrame) -> DataFrame:
    """Products of both systems, never merged: legacy labels by the map, shop categories by parent or self."""
    label = text.fold_label(F.coalesce("label", F.lit("")))
    level = lambda i: recode(label, {k: v[i] for k, v in CATEGORY_MAP.items() if v[i] is not None})
    old = legacy.select(F.lit("LEGADO").alias("system"), "product_id", "description", level(0).alias("level1"), level(1).alias("level2"), F.coalesce(level(2), F.lit("sem_mapeamento")).alias("mapping"))
    child, parent = categories.alias("c"), categories.alias("p")
    tree = child.join(parent, F.col("c.parent_id") == F.col("p.category_id"), "left").select(
        F.col("c.category_id").alias("category_id"), F.coalesce("p.name", "c.name").alias("level1"), F.when(F.col("p.name").isNotNull(), F.col("c.name")).alias("level2")
    )
    new = shop.join(tree, "category_id", "left").select(F.lit("ECOM").alias("system"), "product_id", "description", "level1", "level2", F.lit("taxonomia_origem").alias("mapping"))
    return old.unionByName(new)


def tickets(raw: DataFrame, tax_ids: DataFrame) -> DataFrame:
    """raw (protocol, tax_id, opened, closed, channel, reason, rating, hours; all text, with line) at one row a protocol.

    The first line of a protocol counts. The customer is attached by tax id (tax_id, customer_key) if that is one
    customer's alone; else it is null, with a flag where there are several.
    """
    first = W.partitionBy("protocol").orderBy("line")
    owners = tax_ids.where("tax_id IS NOT NULL").groupBy("tax_id").agg(F.min("customer_key").alias("_least"), F.max("customer_key").alias("_greatest"))
    rating, hours = numbers.comma_number(F.col("rating")), numbers.comma_number(F.col("hours"))
    reason = text.fold_label(text.without_note(F.col("reason")))
    return (
        raw.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .withColumn("tax_id", F.nullif(text.digits(F.col("tax_id")), F.lit("")))
        .join(owners, "tax_id", "left")
        .select(
            "protocol",
            F.when(F.col("_least") == F.col("_greatest"), F.col("_least")).alias("customer_key"),
            F.coalesce(F.col("_least") < F.col("_greatest"), F.lit(False)).alias("tax_id_ambiguous"),
            dates.day_month_year(F.col("opened")).alias("opened"),
            dates.day_month_year(F.col("closed")).alias("closed"),
            F.upper(F.trim("channel")).alias("channel"),
            recode(reason, REASON_MAP).alias("reason"),
            F.coalesce(F.col("reason").rlike(r"(?i)obs:\s*cliente reiterou"), F.lit(False)).alias("reiterated"),
            numbers.within(rating, 1, 5).cast("int").alias("rating"),
            F.coalesce(rating == 0, F.lit(False)).alias("rating_zero"),
            F.when(hours >= 0, hours).alias("hours"),
            F.coalesce(hours < 0, F.lit(False)).alias("hours_negative"),
        )
    )


def reviews(raw: DataFrame, product_keys: DataFrame) -> DataFrame:
    """raw (as readers.ndjson gives it) with product by reference, local date, and the rating as a number.

    The order stays as declared (ref_system, ref_id). product_keys: (system, reference, product_key).
    """
    instant, missing = dates.iso_instant(F.col("submitted_at"))
    system, number = text.reference(F.col("order_ref"))
    rating = F.col("rating").try_cast("int")
    prefix = F.when(F.col("sku").startswith("LEG-"), "LEGADO").otherwise("ECOM")
    return (
        raw.select(
            "review_id",
            prefix.alias("system"),
            F.regexp_replace("sku", "^LEG-", "").alias("reference"),
            system.alias("ref_system"),
            number.alias("ref_id"),
            dates.local_clock(instant).alias("local_time"),
            dates.local_date(instant).alias("local_day"),
            missing.alias("offset_missing"),
            numbers.within(rating, 1, 5).alias("rating"),
            F.array_contains("text_paths", "rating").alias("rating_was_text"),
            F.array_contains("absent_paths", "rating").alias("rating_absent"),
        )
        .join(product_keys, ["system", "reference"], "left")
    )
