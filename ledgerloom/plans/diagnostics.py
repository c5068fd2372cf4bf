"""Diagnostics: measures by several cuts, formula hypotheses, anomalies, grain and semantics checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_cuts(df: DataFrame, cuts: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures in total and by each cut (cut, value), in one pass with grouping sets."""
    sets = [[]] + [[c] for c in cuts]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, cuts)).agg(*(m.alias(k) for k, m in measures.items()), F.grouping_id().alias("_g"))
    n = len(cuts)
    name, value = F.lit("total"), F.lit("").cast("string")
    for i, c in enumerate(cuts):
        here = F.col("_g") == (2**n - 1) - 2 ** (n - 1 - i)
        name, value = F.when(here, c).otherwise(name), F.when(here, F.col(c).cast("string")).otherwise(value)
    return grouped.select(name.alias("cut"), value.alias("value"), *measures)


def formula_shares(df: DataFrame, total: Column, hypotheses: dict[str, Column], cuts: list[str], tolerance: float = 0.01) -> DataFrame:
    """Rows that each hypothesis explains, |total - formula| <= tolerance, in total and by each cut."""
    marked = df.withColumns({f"_{k}": F.coalesce(F.abs(total - f) <= tolerance, F.lit(False)) for k, f in hypotheses.items()})
    return by_cuts(marked, cuts, {"n": F.count("*")} | {k: F.count_if(F.col(f"_{k}")) for k in hypotheses})


def residuals(df: DataFrame, residual: Column) -> DataFrame:
    return df.groupBy(residual.alias("residual")).agg(F.count("*").alias("n"))


def anomalies(df: DataFrame, tests: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """(anomaly, lower, upper, base): rows that surely have it and rows that may; one test gives both. One scan."""
    pairs = {k: t if isinstance(t, tuple) else (t, t) for k, t in tests.items()}
    cells = [F.struct(F.lit(k).alias("anomaly"), F.count_if(F.coalesce(lo, F.lit(False))).alias("lower"), F.count_if(F.coalesce(hi, F.lit(False))).alias("upper"), F.count("*").alias("base")) for k, (lo, hi) in pairs.items()]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the two key sets, of what they share and of their symmetric difference, in one outer join."""
    left, right = (df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(s, F.lit(1)) for df, s in ((a, "_a"), (b, "_b")))
    both = left.join(right, key, "full")
    return both.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_difference"))


def audit_keys(records: DataFrame, keys: dict[str, Column], side: str, sides: tuple[str, str], attributes: list[str]) -> DataFrame:
    """For each candidate key, a column with its test of validity: present, valid, distinct, repeated within a side, shared by both, rows of each
    side whose key the other has, pairs over both sides, and pairs that agree on each attribute (null agrees with nothing).

    Counts of each key and attribute value meet, not pairs.
    """
    cells = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value"), F.coalesce(ok, F.lit(False)).alias("valid")) for k, ok in keys.items()))
    others = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("is")) for c in attributes))
    long = records.select(F.col(side).alias("_side"), others.alias("_others"), F.explode(cells).alias("x")).select("_side", "_others", "x.*").where("value IS NOT NULL")
    a, b = (F.count_if(F.col("_side") == s) for s in sides)
    by_value = long.groupBy("key", "value").agg(a.alias("a"), b.alias("b"), F.count_if("valid").alias("valid"))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    counts = by_value.groupBy("key").agg(
        F.sum(F.col("a") + F.col("b")).alias("n_present"), F.sum("valid").alias("n_valid"), F.count("*").alias("n_distinct"), F.sum((F.col("a") > 1).cast("long") + (F.col("b") > 1).cast("long")).alias("n_repeated"), F.count_if(both).alias("n_shared"),
        F.sum(F.when(both, F.col("a")).otherwise(0)).alias("n_left_covered"), F.sum(F.when(both, F.col("b")).otherwise(0)).alias("n_right_covered"), F.sum(F.col("a") * F.col("b")).alias("n_pairs"),
    )
    agreeing = long.select("_side", "key", "value", F.explode("_others").alias("o")).where("o.is IS NOT NULL").groupBy("key", "value", "o").agg(a.alias("a"), b.alias("b"))
    agreed = agreeing.groupBy("key").agg(*(F.sum(F.when(F.col("o.name") == c, F.col("a") * F.col("b")).otherwise(0)).alias(f"n_agree_{c}") for c in attributes))
    return counts.join(agreed, "key", "left").select(*counts.columns, *(F.coalesce(f"n_agree_{c}", F.lit(0)).alias(f"n_agree_{c}") for c in attributes))


def candidate_precision(records: DataFrame, rules: dict[str, list[str]], side: str, sides: tuple[str, str], truth: str) -> DataFrame:
    """For each rule, a list of keys: pairs over the two sides that share them, those whose truth (a tax id) is the same and those
    whose truth differs. From counts by keys and truth, without making the pairs."""
    out = []
    a, b = (F.count_if(F.col(side) == s) for s in sides)
    for rule, keys in rules.items():
        counts = records.dropna(subset=keys).groupBy(*keys, truth).agg(a.alias("a"), b.alias("b"))
        known = F.col(truth).isNotNull()
        each = counts.groupBy(*keys).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.when(known, F.col("a")).otherwise(0)).alias("ka"), F.sum(F.when(known, F.col("b")).otherwise(0)).alias("kb"), F.sum(F.when(known, F.col("a") * F.col("b")).otherwise(0)).alias("right"))
        out.append(each.agg(F.sum(F.col("a") * F.col("b")).alias("n_pairs"), F.sum("right").alias("n_right"), F.sum(F.col("ka") * F.col("kb") - F.col("right")).alias("n_wrong")).select(F.lit(rule).alias("rule"), "*"))
    return reduce(DataFrame.unionByName, out)


def confinement(right: DataFrame, leak: DataFrame, key: str, value: str, others: list[str]) -> DataFrame:
    """(check, n) of a leaking feature table against the right one, both with y: what must be 0 but for "recency below zero".

    leak has recency_days_leaky, frequency_leaky, leaky_y and z of value beside the right columns.
    """
    a = right.select(key, "y", "frequency", *others, F.lit(1).alias("_a"))
    b = leak.select(key, "leaky_y", "recency_days_leaky", "frequency_leaky", "z", *(F.col(c).alias(f"_{c}") for c in others), F.lit(1).alias("_b"))
    both = a.join(b, key, "full")
    differs = reduce(lambda x, c: x | ~F.col(c).eqNullSafe(F.col(f"_{c}")), others, F.lit(False))
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    stats = right.agg(F.avg(F.col(value).cast("double")).alias("_mean"), F.stddev_pop(F.col(value).cast("double")).alias("_std"))
    both = both.crossJoin(F.broadcast(stats))  # one row
    back = F.abs(F.col("z") * F.col("_std") + F.col("_mean") - F.col(value).cast("double")) > 1e-6 * F.col("_std")
    tests = {
        "population differs": F.count_if(F.col("_a").isNull() | F.col("_b").isNull()), "target differs": F.count_if(there & ~F.col("y").eqNullSafe(F.col("leaky_y"))), "other columns differ": F.count_if(there & differs),
        "recency below zero": F.count_if(F.col("recency_days_leaky") < 0), "fewer orders than without": F.count_if(F.col("frequency_leaky") < F.col("frequency")),
        "z mean off": (F.abs(F.avg("z")) > 1e-6).cast("long"), "z deviation off": (F.abs(F.stddev_pop("z") - 1) > 1e-5).cast("long"), "z not invertible": F.count_if(back),
    }
    cells = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(0)).cast("long").alias("n")) for k, v in tests.items()))
    return both.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def repeats_in_group(lines: DataFrame, group: list[str], item: str) -> DataFrame:
    """Groups that hold an item more than once, and by how many lines."""
    pairs = lines.groupBy(*group, item).agg(F.count("*").alias("n")).where("n > 1")
    return pairs.groupBy(*group).agg(F.count("*").alias("n_items"), F.sum(F.col("n") - 1).alias("n_surplus"))


def price_outliers(lines: DataFrame, prices: DataFrame, key: str, factor: int = 10) -> DataFrame:
    """Lines whose price is factor times the list price or more: an equi join with a theta residual."""
    return lines.join(prices, key).where(F.col("unit_price") >= factor * F.col("list_price"))


def as_metrics(df: DataFrame, prefix: str, key: str, value: str) -> DataFrame:
    """Rows of the metric registry (key, value) from a report."""
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.col(value).cast("double").alias("value"))


def upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new keys added and known ones replaced."""
    return registry.join(new, "key", "left_anti").unionByName(new)


def verify_numbers(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """Numbers in the texts (doc, text) that no registered value explains, as (doc, shown).

    A number with decimal comma is explained by a value that rounds to it at its decimals, as it is, negated or as a
    percentage. Candidates are joined on the rounded value, so no text meets the whole registry.
    """
    shown = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?"), F.lit(0))).alias("shown")).distinct()
    number = F.replace(F.replace(F.col("shown"), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("decimal(24,6)")
    shown = shown.withColumns({"number": number, "places": F.least(F.length(F.regexp_extract("shown", r",([0-9]+)$", 1)), F.lit(6))})
    values = registry.select(F.explode(F.array(F.abs("value"), F.abs("value") * 100)).alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("places"), "v")
    rounded = reduce(lambda x, k: F.when(F.col("places") == k, F.round("v", k)).otherwise(x), range(1, 7), F.round("v", 0)).cast("decimal(24,6)")
    return shown.join(values.select("places", rounded.alias("number")).distinct(), ["places", "number"], "left_anti").select("doc", "shown")
