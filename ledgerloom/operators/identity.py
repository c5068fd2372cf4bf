"""Customer identities across systems: rules give links, components are persons, golden records follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..storage import saved
from .graph import components
from .keys import dense_keys


def nodes(records: DataFrame) -> DataFrame:
    """records (node long, system, source_id, name, tax_id, email, phone, city, region, signed_up) with their match keys."""
    tax = text.digits(F.col("tax_id"))
    return records.select(
        "node", "system", "source_id", "name", "signed_up",
        text.fold_name(F.col("name")).alias("folded"),
        F.when((F.length(tax) == 11) & ~tax.rlike(r"^([0-9])\1{10}$"), tax).alias("tax"),
        text.tax_id_valid(F.col("tax_id")).alias("tax_ok"),
        text.blank_to_null(F.lower("email")).alias("email"),
        F.nullif(text.digits(F.col("phone")), F.lit("")).alias("phone"),
        text.blank_to_null(text.sentinel_to_null(F.col("city"))).alias("city"),
        text.blank_to_null(F.col("region")).alias("region"),
    )


def rules() -> list[tuple[str, Column, list[str]]]:
    """Name, condition and keys of each rule. Null regions match null regions."""
    return [
        ("CPF_INVALIDO_NOME_UF", (~F.col("tax_ok")) & F.col("tax").isNotNull(), ["tax", "folded", "region"]),
        ("CPF_VALIDO_NOME", F.col("tax_ok"), ["tax", "folded"]),
        ("DUPLICATA_LEGADO", (F.col("system") == "L") & F.col("email").isNotNull(), ["email", "folded", "phone"]),
    ]


def links(keyed: DataFrame) -> DataFrame:
    """Star links (a, b, rule): the smallest node of each group to every other; a group of any size is one min."""
    found = []
    for name, condition, keys in rules():
        rows = keyed.where(condition)
        least = rows.groupBy(*keys).agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
        on = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(least[k]) for k in keys))
        found.append(rows.join(least, on).select("a", F.col("node").alias("b"), F.lit(name).alias("rule")))
    return reduce(DataFrame.unionByName, found)


def persons(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Golden records and the bridge of resolve()."""
    gold, bridge, _ = resolve(records)
    return gold, bridge


def key_order() -> list[Column]:
    """How persons are numbered: by the smallest legacy id, those without one after them, by the smallest shop id."""
    return [F.col("least_legacy").isNull(), F.coalesce("least_legacy", "shop_id"), F.col("person")]


def _shop() -> Column:
    return F.col("system") == "E"


def _rank() -> tuple[Column, Column]:
    """0 for a record with a valid tax id, and how many of its fields are there."""
    return 1 - F.coalesce(F.col("tax_ok").cast("int"), F.lit(0)), sum((F.col(c).isNotNull().cast("int") for c in ("tax", "city", "region", "phone", "email")), F.lit(0))


def grouped(member: DataFrame) -> DataFrame:
    """A row a person of member (the columns of nodes() and person): first values, ids and numbers of records."""
    shop, (unsure, complete) = _shop(), _rank()
    priority = F.struct(F.when(shop, 0).otherwise(1).alias("p"), unsure.alias("u"), (-complete).alias("c"), F.col("source_id").alias("i"), F.col("node").alias("n"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), priority)).alias(c)
    return member.groupBy("person").agg(
        *map(first, ("name", "city", "region")),
        F.min("signed_up").alias("first_signed_up"),
        F.min_by("source_id", F.when(~shop, priority)).alias("legacy_id"),
        F.min(F.when(~shop, F.col("source_id"))).alias("least_legacy"),
        F.min(F.when(shop, F.col("source_id"))).alias("shop_id"),
        F.count_if(~shop).alias("n_legacy"),
        F.count_if(shop).alias("n_shop"),
    )


def described(gold: DataFrame, member: DataFrame, used: DataFrame) -> DataFrame:
    """gold with each person's tax id (before conflicts), the rules of used (person, rules) and the origin."""
    votes = member.where("tax IS NOT NULL").groupBy("person", "tax").agg(F.count("*").alias("n"), F.max(F.coalesce("tax_ok", F.lit(False))).alias("ok"))
    tax = votes.groupBy("person").agg(F.min_by(F.struct("tax", "ok"), F.struct((~F.col("ok")).alias("x"), -F.col("n"), F.col("tax"))).alias("t")).select("person", "t.tax", F.col("t.ok").alias("tax_valid"))
    origin = F.when((F.col("n_legacy") > 0) & (F.col("n_shop") > 0), "AMBOS").when(F.col("n_shop") > 0, "ECOM").otherwise("LEGADO")
    return gold.drop("least_legacy").join(tax, "person", "left").join(used, "person", "left").withColumn("origin", origin)


def rule_names(found: DataFrame) -> DataFrame:
    """(person, rules) of rows (person, rule)."""
    return found.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("rule")), "+").alias("rules"))


def first_run(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records with their person, and the persons before conflicts of tax ids are settled."""
    keyed = saved(nodes(records), "nodes")
    edges = links(keyed)
    label = components(edges.select("a", "b"))
    member = keyed.join(label, "node", "left").withColumn("person", F.coalesce("component", "node")).drop("component")
    used = rule_names(edges.select(F.col("a").alias("node"), "rule").join(label, "node").select(F.col("component").alias("person"), "rule"))
    return member, described(dense_keys(grouped(member), key_order(), "person_key"), member, used)


def resolve(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Golden records, the bridge (node, person, role, system_role, person_key), and each person's usable tax ids
    (person_key, tax, tax_valid).

    Tax id: the most frequent among valid ones if there is one, else among usable ones, ties by value. Name, city and
    region: shop rows first, then legacy ones, first that is not null; within a system rows with a valid tax id come
    first, then more complete ones, then smaller ids. legacy_id is the first legacy row in that order, shop_id the
    smallest. A valid tax id of several persons is a conflict: it stays with the one that has most records, or with
    none if there are several such. person is the smallest node; person_key is 1..n by the smallest legacy id, persons
    without one after those, by shop id. role has one survivor a person; system_role one a system: legacy_id, shop_id.
    """
    return finished(*first_run(records))


def finished(member: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three results of resolve() from the two of first_run()."""
    shop, (unsure, complete) = _shop(), _rank()
    ids = gold.select("person", "person_key", "legacy_id", "shop_id")
    size = F.col("n_legacy") + F.col("n_shop")
    claims = gold.where("tax_valid").withColumn("size", size).groupBy("tax").agg(F.count("*").alias("n"), F.max("size").alias("most"))
    claims = claims.where("n > 1").join(gold.where("tax_valid").select("tax", size.alias("size")), "tax").groupBy("tax", "most").agg(F.count_if(F.col("size") == F.col("most")).alias("n_most"))
    gold = gold.join(claims, "tax", "left").withColumn("tax_conflict", F.col("tax_valid").isNotNull() & F.coalesce("tax_valid", F.lit(False)) & F.col("most").isNotNull())
    lost = F.col("tax_conflict") & ~((size == F.col("most")) & (F.col("n_most") == 1))
    gold = gold.withColumns({"tax": F.when(~lost, F.col("tax")), "tax_valid": F.when(~lost, F.col("tax_valid"))}).drop("most", "n_most")
    order = W.partitionBy("person").orderBy(unsure, complete.desc(), "source_id", "system")
    ranked = member.select("node", "system", "source_id", "person", F.when(F.row_number().over(order) == 1, "SOBREVIVENTE").otherwise("ABSORVIDO").alias("role"))
    own = F.col("source_id") == F.when(shop, F.col("shop_id")).otherwise(F.col("legacy_id"))
    bridge = ranked.join(ids, "person").select("node", "system", "source_id", "person", "role", F.when(own, "SOBREVIVENTE").otherwise("ABSORVIDO").alias("system_role"), "person_key")
    tax_ids = member.where("tax IS NOT NULL").join(ids, "person").select("person_key", "tax", F.col("tax_ok").alias("tax_valid")).distinct()
    return gold, bridge, tax_ids
