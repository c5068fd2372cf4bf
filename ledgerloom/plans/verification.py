"""Numbers in texts against what was measured, and two runs of files, tables and assertions item by item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A number as reports write it (points between thousands, decimal comma), and what is no measurement:
# code, rules of tables, days, semesters, versions, numbered headings and lists, labels of tables, figures and decisions.
NUMBER = r"(?U)(?<![\w.,/-])[-−+]?\d{1,3}(?:\.\d{3})+(?:,\d+)?(?![\w/])|(?<![\w.,/-])[-−+]?\d+(?:,\d+)?(?![\w/])"
BLOCKS = [r"(?s)```.*?```", r"`[^`]*`"]
LINES = [r"^\s*#.*$", r"^\s*\|[-:| ]+\|\s*$"]
WORDS = [
    r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}/\d{2}\b|\b\d{4}/\d\b", r"\b\d{1,2}\.\d{1,2}\.\d{1,2}\b", r"(?U)\b(?:RDT-\d+|D\d+|H\d|Tabela \d+|Figuras? \d+|[Ss]eção \d+|Caso \d+|item \d+(?:\.\d+)?)\b",
    r"^\s*\d+\.\s", r"\(\d\)|\b[a-e]\)",
]
#: Decimals that are compared; more are cut.
PLACES = 6


def numbers_of(texts: DataFrame, after: str | None = None, before: str | None = None, drop: list[str] | None = None) -> DataFrame:
    """(doc, line, shown, number, places) of the numbers in texts (doc, text), line by line (from 1, of the part read).

    Of a text only what lies between the marks `after` and `before` is read, all of it where a mark is not there. Code
    blocks may span lines and count as one blank, as do the patterns of drop. Null and empty texts have no numbers.
    """
    part = F.col("text")
    if before:
        part = F.substring_index(part, before, 1)
    if after:
        at = F.locate(after, part)
        part = F.when(at > 0, F.substring(part, at + len(after), F.length(part))).otherwise(part)
    for pattern in BLOCKS:
        part = F.regexp_replace(part, pattern, " ")
    lines = texts.select("doc", F.posexplode(F.split(part, "\n")).alias("_at", "_line"))
    clean = F.col("_line")
    for pattern in [*LINES, *(WORDS if drop is None else drop)]:
        clean = F.regexp_replace(clean, pattern, " ")
    shown = lines.select("doc", (F.col("_at") + 1).alias("line"), F.explode(F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(0))).alias("shown"))
    bare = F.regexp_replace(F.regexp_replace(F.translate("shown", "−", "-"), r"[+.]", ""), ",", ".")
    return shown.select("*", bare.cast("decimal(30,6)").alias("number"), F.least(F.length(F.regexp_extract("shown", r",(\d+)$", 1)), F.lit(PLACES)).alias("places"))


def measured(df: DataFrame, origin: str, key: Column) -> DataFrame:
    """(value, origin) of every number column of a report and of its number of rows; key names a row. One scan each."""
    kinds = ("int", "bigint", "smallint", "double", "float")
    cells = [F.struct(F.col(f"`{c}`").cast("double").alias("value"), F.concat(F.lit(f"{origin}:"), key.cast("string"), F.lit(f":{c}")).alias("origin")) for c, t in df.dtypes if t in kinds or t.startswith("decimal")]
    rows = df.agg(F.count("*").cast("double").alias("value")).withColumn("origin", F.lit(f"{origin} (rows)"))
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value IS NOT NULL").unionByName(rows) if cells else rows


def _candidates(registry: DataFrame, exact: bool) -> DataFrame:
    """(places, units, origin): the integers in units of the last decimal that a value explains; one origin each, the first."""
    own = registry.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e11")
    if exact:
        cells = own.select(F.lit(4).alias("places"), F.round(F.col("value") * 10_000).cast("long").alias("units"), "origin")
    else:
        seen = own.select(F.explode(F.array(F.abs("value"), F.when(F.col("value") >= 0, F.col("value") * 100))).alias("v"), "origin").where("v IS NOT NULL")
        v, slack = F.col("v"), 1e-9
        # a value half-way between two is shown as either; without decimals only whole values count
        at = [
            F.array(F.struct(F.lit(k).alias("places"), F.floor(v * 10**k + 0.5 + slack * 10**k).alias("units")), F.struct(F.lit(k).alias("places"), F.ceil(v * 10**k - 0.5 - slack * 10**k).alias("units"))) for k in range(1, PLACES + 1)
        ]
        whole = F.when(F.abs(v - F.round(v)) <= slack, F.array(F.struct(F.lit(0).alias("places"), F.round(v).cast("long").alias("units"))))
        cells = seen.select(F.explode(F.concat(F.coalesce(whole, F.array().cast("array<struct<places:int,units:bigint>>")), *at)).alias("x"), "origin").select("x.*", "origin")
    return cells.groupBy("places", "units").agg(F.min("origin").alias("origin"))


def verified(numbers: DataFrame, registry: DataFrame, constants: dict[float, str], exact: bool = False) -> DataFrame:
    """numbers with verdict (found, constant or missing) and why (the value's origin, or the constant's reason).

    A shown number is found where a registered (value, origin) rounds to it at its decimals, as it is, without its sign, or as a
    percentage; a number without decimals only where the value is whole. Constants of at most one decimal go first. With
    exact, values must be equal at four decimals, sign included, and constants come last. Candidates meet on the rounded
    value, counted by number first, so a number that a third of all texts show is one row.
    """
    number = F.col("number") if exact else F.abs("number")
    places = F.lit(4) if exact else F.col("places")
    units = F.round(number.cast("double") * F.pow(F.lit(10.0), places)).cast("long")
    tokens = numbers.withColumns({"_places": places, "_units": units})
    found = tokens.select("_places", "_units").distinct().join(_candidates(registry, exact).withColumnsRenamed({"places": "_places", "units": "_units"}), ["_places", "_units"])
    met = tokens.join(found, ["_places", "_units"], "left")
    known = reduce(lambda x, c: F.when(number == F.lit(str(c[0])).cast("decimal(30,6)"), F.lit(c[1])).otherwise(x), constants.items(), F.lit(None).cast("string"))
    reason = known if exact else F.when(F.col("places") <= 1, known)
    verdict = lambda first, a, second, b: F.when(first.isNotNull(), a).when(second.isNotNull(), b).otherwise("missing")
    origin = F.col("origin")
    out = met.withColumn("_why", reason)
    first, second = (origin, F.col("_why")) if exact else (F.col("_why"), origin)
    names = ("found", "constant") if exact else ("constant", "found")
    return out.select(*numbers.columns, verdict(first, names[0], second, names[1]).alias("verdict"), F.coalesce(first, second).alias("why"))


def run_items(files: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, log: DataFrame | None = None, without: list[str] | None = None) -> DataFrame:
    """(kind, item, print) of a run: files (path, digest), tables by rows and hash sum (a second time without the columns
    that tell when they were made), and assertions (stage, name, passed, observed), each with all its results and how often."""
    from ..operators import profile

    text = lambda df: df.select(F.concat(F.col("n_rows"), F.lit(" rows, sum "), F.coalesce(F.col("hash_sum").cast("string"), F.lit("0"))).alias("print"))
    out = [] if files is None else [files.select(F.lit("file").alias("kind"), F.col("path").alias("item"), F.col("digest").alias("print"))]
    for name, df in (tables or {}).items():
        out.append(text(profile.fingerprint(df)).select(F.lit("table").alias("kind"), F.lit(name).alias("item"), "print"))
        if without and set(without) & set(df.columns):
            out.append(text(profile.fingerprint(df.drop(*without))).select(F.lit("table without stamps").alias("kind"), F.lit(name).alias("item"), "print"))
    if log is not None:
        shown = F.concat(F.lit("passed="), F.coalesce(F.col("passed").cast("string"), F.lit("none")), F.lit(" observed="), F.coalesce(F.col("observed").cast("string"), F.lit("none")))
        times = log.groupBy("stage", "name", shown.alias("p")).agg(F.count("*").alias("n"))
        one = times.groupBy("stage", "name").agg(F.array_join(F.array_sort(F.collect_list(F.concat("p", F.lit(" times="), "n"))), "; ").alias("print"))
        out.append(one.select(F.lit("assertion").alias("kind"), F.concat_ws(" / ", "stage", "name").alias("item"), "print"))
    return reduce(DataFrame.unionByName, out)


def compare_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, item, state, before, after) of two runs' items: equal, differs, added or gone."""
    a, b = before.withColumnRenamed("print", "before"), after.withColumnRenamed("print", "after")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "equal").otherwise("differs")
    return a.join(b, ["kind", "item"], "full").select("kind", "item", state.alias("state"), "before", "after")
