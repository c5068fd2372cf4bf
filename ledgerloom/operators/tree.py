"""Decision trees by entropy of any depth: nodes of many rows are split by counts of values, smaller ones inside tasks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, saved
from .keys import running_sums

#: A node of at most so many rows is grown in one task; this bounds memory, results are the same at any number.
SMALL = 100_000
#: Scores that differ by less are ties, whatever the order of their sums.
PLACES = 10
#: Levels that rows go down before their plan is cut.
LEVELS = 8
NODES = "node string, depth int, n long, ones long, feature int, threshold double"


def _value(column: str) -> Column:
    """Null and NaN lie below all numbers."""
    v = F.col(column).cast("double")
    return F.when(v.isNull() | F.isnan(v), float("-inf")).otherwise(v)


def _mass(n: Column, ones: Column) -> Column:
    """Entropy of a node times its rows, in nats."""
    part = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    return part(n) - part(ones) - part(n - ones)


def _middle(low: Column, high: Column) -> Column:
    """Half-way, or low where no number between is told from high."""
    half = low / 2 + high / 2
    return F.when(half >= high, low).otherwise(half)


def splits(rows: DataFrame, leaf: int) -> DataFrame:
    """(node, feature, threshold): the split of least entropy of each node of rows (node, y, x array), leaving leaf rows or
    more on both sides; ties go to the earlier feature, then the smaller threshold. Nodes without one are left out.

    Rows are counted by node, feature and value before they shuffle; counts are added up along ranges of these, so one node
    may hold all rows and one value most of them.
    """
    long = rows.select("node", "y", F.posexplode("x").alias("feature", "value"))
    counts = long.groupBy("node", "feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    order = [F.col("node"), F.col("feature"), F.col("value")]
    run = saved(running_sums(counts, order, {"n": "n_before", "ones": "ones_before"}), "running")
    whole = run.groupBy("node", "feature").agg(F.min("n_before").alias("n_start"), F.min("ones_before").alias("ones_start"), F.sum("n").alias("n_all"), F.sum("ones").alias("ones_all"))
    n, ones = F.col("n_before") - F.col("n_start") + F.col("n"), F.col("ones_before") - F.col("ones_start") + F.col("ones")
    rest, rest_ones = F.col("n_all") - n, F.col("ones_all") - ones
    score = F.round((_mass(n, ones) + _mass(rest, rest_ones)) / F.col("n_all"), PLACES)
    fit = run.join(whole, ["node", "feature"]).where((n >= leaf) & (rest >= max(leaf, 1))).select("node", F.struct(score.alias("score"), "feature", "value").alias("s"))
    best = fit.groupBy("node").agg(F.min("s").alias("s")).select("node", "s.feature", F.col("s.value").alias("low"))
    above = run.join(best, ["node", "feature"]).where("value > low").groupBy("node", "feature", "low").agg(F.min("value").alias("high"))
    found = saved(above.select("node", "feature", _middle(F.col("low"), F.col("high")).alias("threshold")), "splits")
    discard(run)
    return found


def _step(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows one level down where found has a split of their node; others keep it."""
    side = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), "0").otherwise("1")
    return rows.join(found.select("node", "feature", "threshold"), "node", "left").withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.concat("node", side))).drop("feature", "threshold")


def _inside(depth: int, split: int, leaf: int):  # noqa: ANN202
    """The nodes below one node of at most SMALL rows."""

    def mass(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        part = lambda x: x * np.log(np.maximum(x, 1.0))
        return part(n) - part(ones) - part(n - ones)

    def best(x: np.ndarray, y: np.ndarray) -> tuple[float, int, float] | None:
        found = None
        for feature in range(x.shape[1]):
            at = np.argsort(x[:, feature], kind="stable")
            v, n = x[at, feature], np.arange(1.0, len(y))
            ones = np.cumsum(y[at])[:-1].astype(float)
            score = (mass(n, ones) + mass(len(y) - n, y.sum() - ones)) / len(y)
            score = np.where((v[:-1] < v[1:]) & (n >= leaf) & (len(y) - n >= leaf), np.round(score, PLACES), np.inf)
            k = int(np.argmin(score))
            if np.isfinite(score[k]) and (found is None or score[k] < found[0]):
                half = v[k] / 2 + v[k + 1] / 2
                found = float(score[k]), feature, float(half if half < v[k + 1] else v[k])
        return found

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        out, todo = [], [(group["node"].iloc[0], np.stack(group["x"].to_numpy()), group["y"].to_numpy())]
        while todo:
            node, x, y = todo.pop()
            ones = int(y.sum())
            found = best(x, y) if len(y) >= split and 0 < ones < len(y) and len(node) < depth else None
            out.append((node, len(node), len(y), ones, *(found[1:] if found else (None, None))))
            if found:
                low = x[:, found[1]] <= found[2]
                todo += [(node + "0", x[low], y[low]), (node + "1", x[~low], y[~low])]
        return pd.DataFrame(out, columns=["node", "depth", "n", "ones", "feature", "threshold"]).astype({"feature": "Int32", "threshold": "Float64"})

    return grown


def grow(train: DataFrame, label: str, features: list[str], depth: int = 100, split: int = 5, leaf: int = 2) -> DataFrame:
    """A tree by entropy: (node, depth, n, ones, feature, threshold), feature an index of features and null in leaves.

    A node is named by its path (0: value at most threshold, 1: above); label is 0 or 1, rows without one are left out.
    Nodes of fewer than `split` rows, of one label, at `depth`, or that no threshold cuts into two parts of at least `leaf`
    rows are leaves; a cut that gains nothing is made. Null and NaN features count as below all numbers. Nodes of more than
    SMALL rows are split a level at a time by counts of values, the others each in one task. No rows give no nodes.
    """
    rows = saved(train.where(F.col(label).isNotNull()).select(F.lit("").alias("node"), F.col(label).cast("int").alias("y"), F.array(*map(_value, features)).alias("x")), "rows")
    done = []
    while True:
        sizes = saved(rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).withColumn("depth", F.length("node")), "sizes")
        open_ = (F.col("n") >= split) & (F.col("ones") > 0) & (F.col("ones") < F.col("n")) & (F.col("depth") < depth)
        large = open_ & (F.col("n") > SMALL)
        small = rows.join(sizes.where(~large).select("node"), "node", "left_semi")
        done.append(saved(small.groupBy("node").applyInPandas(_inside(depth, split, leaf), NODES), "nodes"))
        if not sizes.where(large).limit(1).count():
            return reduce(DataFrame.unionByName, done)
        inner = rows.join(sizes.where(large).select("node"), "node", "left_semi")
        found = splits(inner, leaf)
        done.append(sizes.where(large).join(found, "node", "left").select("node", "depth", "n", "ones", "feature", "threshold"))
        below = saved(_step(inner.join(found.select("node"), "node", "left_semi"), found), "rows")
        discard(rows)
        rows = below


def _descend(nodes: pa.Table, rows: pa.Table) -> pa.Table:
    """(key, score, depth) of rows in the leaves of one subtree."""
    names, ones, n = nodes.column("node").to_pylist(), nodes.column("ones").to_numpy(), nodes.column("n").to_numpy()
    place = {name: i for i, name in enumerate(names)}
    feature = nodes.column("feature").cast(pa.int64()).fill_null(-1).to_numpy()
    threshold = nodes.column("threshold").fill_null(0.0).to_numpy()
    below = np.array([[place.get(f"{name}{side}", -1) for side in "01"] for name in names], np.int64).reshape(-1, 2)
    x = rows.column("x").combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    at = np.full(len(rows), min(range(len(names)), key=lambda i: len(names[i]), default=0), np.int64)
    inner = np.flatnonzero(feature[at] >= 0) if names else np.zeros(0, np.int64)
    while len(inner):
        now = at[inner]
        at[inner] = below[now, (x[inner, feature[now]] > threshold[now]).astype(np.int64)]
        inner = inner[feature[at[inner]] >= 0]
    depth = np.array([len(name) for name in names], np.int32)
    return pa.table({"key": rows.column("key"), "score": ones[at] / n[at], "depth": depth[at]}) if len(rows) else pa.table({"key": rows.column("key"), "score": pa.array([], pa.float64()), "depth": pa.array([], pa.int32())})


def scores(tree: DataFrame, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, score, depth): the share of ones in each row's leaf. Down to the first node of at most SMALL training rows a level is
    a join with that level's splits, which Spark broadcasts if they are small by their size; the subtree below such a node meets its rows, by
    SMALL of them, in one task. Rows are whole: an empty tree gives null scores."""
    tree = saved(tree, "tree")
    large = tree.where(F.col("n") > SMALL)
    deepest = large.agg(F.max("depth")).first()[0]
    now = rows.select(F.col(key).alias("key"), F.lit("").alias("node"), F.array(*map(_value, features)).alias("x"))
    for level in range(0 if deepest is None else deepest + 1):
        now = _step(now, large.where((F.col("depth") == level) & F.col("feature").isNotNull()))
        if level % LEVELS == LEVELS - 1:
            now = saved(now, "rows")
    now = saved(now, "rows")
    # roots of the subtrees: small nodes at the top or below a large one
    above = large.select(F.explode(F.array(F.concat("node", F.lit("0")), F.concat("node", F.lit("1")))).alias("top"))
    tops = saved(tree.where((F.col("n") <= SMALL) & (F.col("depth") == 0)).select(F.col("node").alias("top")).unionByName(above.join(tree.where(F.col("n") <= SMALL).select(F.col("node").alias("top")), "top", "left_semi")), "tops")
    dealt = saved(tops.join(now.groupBy(F.col("node").alias("top")).agg(F.ceil(F.count("*") / SMALL).cast("int").alias("parts")), "top"), "parts")
    depths = [r[0] for r in tops.select(F.length("top")).distinct().collect()]  # a number a level of large nodes
    ways = F.explode(F.array(*(F.substring("node", 1, d) for d in depths))) if depths else F.lit(None).cast("string")
    small = tree.where(F.col("n") <= SMALL).withColumn("top", ways).where(F.col("top").isNotNull() & (F.length("top") <= F.col("depth"))).distinct().join(dealt, "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = now.withColumnRenamed("node", "top").join(dealt, "top").select("top", F.pmod(F.xxhash64("key", "x"), F.col("parts")).cast("int").alias("part"), "key", "x")
    kind = dict(now.dtypes)["key"]
    inside = small.select("top", "part", "node", "n", "ones", "feature", "threshold").groupBy("top", "part").cogroup(part.groupBy("top", "part")).applyInArrow(_descend, f"key {kind}, score double, depth int")
    leaves = tree.where("feature IS NULL").select("node", (F.col("ones") / F.col("n")).alias("score"), "depth")
    rest = now.join(tops, F.col("node") == F.col("top"), "left_anti").join(leaves, "node", "left").select("key", "score", "depth")
    return rest.unionByName(inside).withColumnRenamed("key", key)
