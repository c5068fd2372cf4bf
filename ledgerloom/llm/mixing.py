"""Mixing sources to target weights: budgets down a tree, then a token prefix of each leaf's seeded epochs.

A node's budget is dealt to its children by weight. A child that has fewer tokens than its share gets all it has,
and what it leaves goes to its siblings first; only what a whole subtree cannot use is left to the
subtree's own siblings, since a node's capacity is that of all leaves below it. A leaf with budget A and Z
tokens gives A div Z whole epochs, and of the next one, in its own seeded order, the first A mod Z tokens.
All amounts are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, SPACE, other_columns, row_hash, saved

#: Rows of a leaf for each slice of its order; only the slice in which the prefix ends is sorted.
SLICE_ROWS, MOST_SLICES = 2000, 1 << 20
#: Copies of a repeated row that one task makes at a time.
COPIES = 10_000
BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _key(doc_id: Column, of_text: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in an epoch's order: 60 bits of an MD5. The text's MD5 is in it, so that rows under one id spread."""
    name = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("none")), of_text)
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, name, weight, capacity, total) with budget: total dealt within each parent.

    Sorted by capacity over weight, the children that get all they have come first; child k is one of
    them while capacity * (weights from k on) <= weight * (total - capacities before k).
    """
    each = W.partitionBy(*parent)
    order = each.orderBy(F.col("capacity") / F.col("weight"), F.col(name))
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(BIG))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    out = children.withColumn("full", F.col("capacity").cast(BIG) * rest.cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * (F.col("total") - before).cast(BIG))
    used = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(each)
    weights = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(each)
    share = F.floor((F.col("weight").cast("decimal(12,0)") * (F.col("total") - used).cast("decimal(20,0)")) / weights.cast("decimal(12,0)"))
    return out.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(share, F.lit(0))).cast(BIG)).drop("full")


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """leaves (levels, size in tokens, docs) with budget. weights: (level, name, weight); a name without a row weighs 1.

    A weight below 1 takes a node with all below it out of the mixture.
    """
    weights = weights.select("level", "name", F.col("weight").cast("long").alias("weight")).groupBy("level", "name").agg(F.max("weight").alias("weight"))
    nodes = leaves.withColumn("root", F.lit(0))
    given = nodes.select("root").distinct().withColumn("total", F.lit(total).cast(BIG))
    for depth, level in enumerate(levels):
        parent = ["root", *levels[:depth]]
        children = nodes.groupBy(*parent, level).agg((F.sum("size").cast(BIG) * max_epochs).cast(BIG).alias("capacity"))
        own = weights.where(F.col("level") == level).select(F.col("name").alias(level), "weight")
        children = children.join(own, level, "left").withColumn("weight", F.coalesce("weight", F.lit(1))).where("weight > 0 AND capacity > 0")
        given = deal(children.join(given, parent), parent, level).select(*parent, level, F.col("budget").alias("total"))
    return leaves.join(given.select(*levels, F.col("total").alias("budget")), levels, "left").withColumn("budget", F.coalesce(F.col("budget").cast("long"), F.lit(0)))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: DataFrame, numerator: int = 4, denominator: int = 5, max_epochs: int = 2, seed: int = 20262, tokens: Column | None = None
) -> DataFrame:
    """Rows of docs that the mixture takes, with epoch, n_tokens, take_tokens and the levels as columns.

    The mixture has numerator / denominator of all tokens of docs, exactly as far as weights, max_epochs and whole numbers
    allow. A row is there once for each epoch that takes it. In the row in which a leaf's prefix ends only the first
    take_tokens count, and its text is cut behind them (unless tokens are given: then the text stays whole).
    levels: the tree's levels from the root, as columns of docs; a null is "unknown". tokens: tokens of a row, by
    default its words; a null text has none. Rows without tokens come along while their leaf's prefix has not ended.
    Repeated rows are rows of their own, of which as many are taken as fit; a null doc_id has its place too.
    Columns of docs (doc_id, text, ...) named like a result, in any case, are replaced; all others pass.
    """
    names = list(levels)
    own = other_columns(docs, *names, "doc_id", "text", "epoch", "n_tokens", "take_tokens")
    words = n_words(F.col("text")) if tokens is None else tokens
    # the columns of docs are kept apart from those of the plan
    base = docs.select(
        F.struct("doc_id", "text", *own).alias("row"),
        F.struct(*(F.coalesce(c.cast("string"), F.lit("unknown")).alias(k) for k, c in levels.items())).alias("at"),
        F.coalesce(words.cast("long"), F.lit(0)).alias("n_tokens"),
        row_hash(docs).alias("hash"),
    )
    level = [f"l{i}" for i in range(len(names))]
    full = base.select("row", *(F.col("at").getField(n).alias(k) for n, k in zip(names, level, strict=True)), "n_tokens", "hash")
    doc_id, text = F.col("row.doc_id"), F.col("row.text")
    light = full.select(doc_id.alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("of_text"), *level, "n_tokens", "hash")
    # equal rows are one row with a number
    sizes = saved(light.groupBy("id", "of_text", *level, "n_tokens", "hash").agg(F.count("*").alias("copies")), "sizes")
    leaves = sizes.groupBy(*level).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("size"), F.sum("copies").alias("docs"))
    leaves = saved(leaves, "leaves")
    total = int(leaves.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    numbered = weights.select(F.coalesce(*(F.when(F.col("level") == n, k) for n, k in zip(names, level, strict=True))).alias("level"), "name", "weight")
    dealt_out = budgets(leaves, level, numbered, total * numerator // denominator, max_epochs)
    some = F.col("size") > 0
    dealt_out = saved(dealt_out.withColumns({"epochs": F.when(some, F.floor(F.col("budget") / F.col("size"))).otherwise(0).cast("int"), "part": F.when(some, F.pmod("budget", "size")).otherwise(0).cast("long")}), "budgets")

    # where each leaf's prefix ends: sums of slices of its order, then the rows of one slice
    small = dealt_out.count() * 400 <= BROADCAST_BYTES
    near = lambda t: F.broadcast(t) if small else t
    slices = F.least(F.ceil(F.col("docs") / SLICE_ROWS), F.lit(MOST_SLICES)).cast("long")
    key = lambda i, t: _key(i, t, F.col("epochs"), seed)
    keyed = sizes.join(near(dealt_out.where("part > 0")), level).withColumns({"key": key(F.col("id"), F.col("of_text")), "all": F.col("n_tokens") * F.col("copies")})
    keyed = keyed.withColumn("slice", F.shiftright(F.shiftright("key", 20) * slices, 40))
    sums = keyed.groupBy(*level, "slice").agg(F.sum("all").alias("sum"), F.first("part").alias("part"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy(*level).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ending = sums.withColumn("before", before).where("before < part AND before + sum >= part").select(*level, "slice", "before")
    row_order = W.partitionBy(*level, "slice").orderBy("key", "id", "n_tokens", "hash").rowsBetween(W.unboundedPreceding, -1)
    place = lambda i: F.struct("key", i.isNotNull().alias("known"), F.coalesce(i, F.lit(0).cast(doc_type)).alias("id"), "n_tokens", "hash")
    doc_type = sizes.schema["id"].dataType
    ends = (
        keyed.join(near(ending), [*level, "slice"])
        .withColumn("sofar", F.col("before") + F.coalesce(F.sum("all").over(row_order), F.lit(0)))
        .where("sofar < part AND sofar + all >= part")
        .select(*level, place(F.col("id")).alias("end"), (F.col("part") - F.col("sofar")).alias("rest"), "copies")
    )
    plan = saved(dealt_out.join(ends, level, "left").select(*level, "epochs", "end", "rest", "copies"), "plan")

    out = full.join(near(plan), level).withColumn("key", key(doc_id, F.md5(F.coalesce(text, F.lit("")))))
    here = F.col("end").isNotNull() & (place(doc_id) == F.col("end"))
    within = F.col("end").isNotNull() & (place(doc_id) < F.col("end"))
    last = F.when(within, F.col("epochs")).otherwise(F.col("epochs") - 1)
    columns = ["row", *level, "n_tokens"]
    whole = out.where(~(here & (F.col("copies") > 1))).withColumn("last", F.when(here, F.col("epochs")).otherwise(last)).where("last >= 0")
    whole = whole.select(*columns, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("epoch"), F.when(here, F.col("rest")).otherwise(F.col("n_tokens")).alias("last_take"), "epochs")
    whole = whole.withColumn("take", F.when(F.col("epoch") == F.col("epochs"), F.col("last_take")).otherwise(F.col("n_tokens"))).select(*columns, "epoch", "take")
    # of equal rows at the end as many as fit: they are one row again, and its copies are made in blocks
    tied = out.where(here & (F.col("copies") > 1)).groupBy(*level, "n_tokens", "epochs", "rest", "copies").agg(F.first("row").alias("row"))
    fits = F.col("rest").cast("long")
    tied = tied.withColumns({"q": F.when(F.col("n_tokens") > 0, F.floor(fits / F.col("n_tokens"))).otherwise(F.col("copies")), "r": F.when(F.col("n_tokens") > 0, F.pmod(fits, F.col("n_tokens"))).otherwise(0)})
    tied = tied.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    times = F.when(F.col("epoch") < F.col("epochs"), F.col("copies")).otherwise(F.col("q"))
    blocks = tied.withColumn("times", times).where("times > 0").select(*columns, "epoch", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))).alias("block"))
    size = F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("block") * COPIES).cast("int")
    copied = blocks.select(*columns, "epoch", F.explode(F.sequence(F.lit(1), size)).alias("i")).select(*columns, "epoch", F.col("n_tokens").alias("take"))
    piece = tied.where("epoch = epochs AND r > 0").select(*columns, "epoch", F.col("r").alias("take"))
    took = whole.unionByName(copied).unionByName(piece).withColumn("take", F.col("take").cast("long"))
    cut = text if tokens is not None else F.when(F.col("take") < F.col("n_tokens"), first_words(text, F.col("take"))).otherwise(text)
    kept = [F.col("row").getField(c) for c in base.schema["row"].dataType.names[2:]]
    return took.select(
        doc_id.alias("doc_id"), cut.alias("text"), *(k.alias(c) for k, c in zip(kept, base.schema["row"].dataType.names[2:], strict=True)),
        *(F.col(k).alias(n) for n, k in zip(names, level, strict=True)), "epoch", "n_tokens", F.col("take").alias("take_tokens"),
    )
