"""Entropy trees against a plain recursive one, by levels and inside tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import mechanisms
from ledgerloom.operators import models, tree
from ledgerloom.queries import customer_features

SF = "/root/testdata/sf0.001"


def entropy(ys):
    return sum(-k * math.log(k / len(ys)) for k in (sum(ys), len(ys) - sum(ys)) if k)


def plain(rows, depth, split, leaf, node=""):
    """rows (y, features); the nodes of the tree by definition."""
    ys = [y for y, _ in rows]
    found = None
    if len(rows) >= split and len(set(ys)) == 2 and len(node) < depth:
        for f in range(len(rows[0][1])):
            seen = sorted({x[f] for _, x in rows})
            for low, high in zip(seen, seen[1:], strict=False):
                a, b = [y for y, x in rows if x[f] <= low], [y for y, x in rows if x[f] > low]
                if min(len(a), len(b)) >= leaf:
                    half = low / 2 + high / 2
                    score = (round((entropy(a) + entropy(b)) / len(rows), tree.PLACES), f, low, half if half < high else low)
                    found = min(found, score) if found else score
    out = {node: (len(rows), sum(ys), found and found[1], found and found[3])}
    if found:
        out |= plain([r for r in rows if r[1][found[1]] <= found[3]], depth, split, leaf, node + "0")
        out |= plain([r for r in rows if r[1][found[1]] > found[3]], depth, split, leaf, node + "1")
    return out


def nodes(df):
    rows = df.collect()
    assert all(r.depth == len(r.node) for r in rows) and len({r.node for r in rows}) == len(rows)
    return {r.node: (r.n, r.ones, r.feature, r.threshold) for r in rows}


def numbers(x):
    return tuple(float("-inf") if v is None or math.isnan(v) else float(v) for v in x)


@pytest.mark.parametrize("small", [20_000, 25])
@pytest.mark.parametrize(("depth", "split", "leaf"), [(100, 5, 2), (2, 2, 1)])
def test_tree(spark, monkeypatch, small, depth, split, leaf):
    """Nulls, NaN, infinities, constant features, equal rows of both labels, and a value that a third of all rows have."""
    monkeypatch.setattr(tree, "SMALL", small)
    rng = random.Random(4)
    inf = float("inf")
    data = [(k, rng.choice([0, 0, 1]), rng.choice([7.0, 7.0, None, rng.randrange(12) / 3]), rng.choice([float("nan"), -inf, inf, rng.random()]), 1.0) for k in range(130)]
    data += [(200 + k, k % 2, 1.5, 0.5, 1.0) for k in range(8)] + [(300, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "k long, y int, a double, b double, c double").withColumns({"node": F.lit("clash"), "x": F.lit(1)})
    grown = tree.grow(df, "y", ["a", "b", "c"], depth, split, leaf)
    rows = [(y, numbers(x)) for _, y, *x in data if y is not None]
    assert nodes(grown) == plain(rows, depth, split, leaf)
    got = {r.k: r for r in tree.scores(grown, df, "k", ["a", "b", "c"]).collect()}
    assert len(got) == len(data) and max(r.depth for r in got.values()) == grown.agg(F.max("depth")).first()[0]
    want = nodes(grown)
    for k, _, *x in data:
        at, x = "", numbers(x)
        while want[at][2] is not None:
            at += "0" if x[want[at][2]] <= want[at][3] else "1"
        assert got[k].score == want[at][1] / want[at][0]


def test_deeper_than_thirty(spark):
    """Labels that only a chain of some 70 cuts tells apart: MLlib's trees end at depth 30."""
    data = [(k, int(k % 4 > 1), float(k)) for k in range(140)]
    df = spark.createDataFrame(data, "k long, y int, v double")
    grown = tree.grow(df, "y", ["v"], split=2, leaf=1)
    assert nodes(grown) == plain([(y, (v,)) for _, y, v in data], 100, 2, 1)
    assert all(r.score in (0.0, 1.0) for r in tree.scores(grown, df, "k", ["v"]).collect()) and grown.agg(F.max("depth")).first()[0] > 30
    empty = tree.grow(df.limit(0), "y", ["v"])
    assert empty.count() == 0 and tree.scores(empty, df, "k", ["v"]).where("score IS NULL").count() == 140


def test_report(spark):
    """The query's tree and its scores by plain Python, on its whole table."""
    base = customer_features(spark, SF).select("customer_id", "y", *mechanisms.TREE_FEATURES)
    split = {r.customer_id: r.train for r in models.stratified_split(base.select("customer_id", "y"), "customer_id", "y").collect()}
    rows = [(r.customer_id, r.y, numbers(None if v is None else float(v) for v in r[2:])) for r in base.collect()]
    want = plain([(y, x) for k, y, x in rows if split[k]], 100, 5, 2)
    got = mechanisms.tree_report(spark, SF).first()
    assert (got.n_nodes, got.n_leaves, got.depth) == (len(want), sum(v[2] is None for v in want.values()), max(map(len, want)))
    counts = [0, 0, 0, 0]
    for k, y, x in rows:
        if not split[k]:
            at = ""
            while want[at][2] is not None:
                at += "0" if x[want[at][2]] <= want[at][3] else "1"
            counts[2 * y + (want[at][1] / want[at][0] > 0.5)] += 1
    assert [got.tn, got.fp, got.fn, got.tp] == counts


def test_scores_join_large_levels_only(spark, monkeypatch):
    """A deep tree of small nodes is gone through in tasks, not by a join a level; scores are a plain walk's at any bound, and rows repeat."""
    frame = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 37 % 101 < 40).cast("int").alias("y"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("a"), (F.col("id") * 7 % 13).alias("b"))
    grown = tree.saved(tree.grow(frame, "y", ["a", "b"]), "grown")
    nodes = {r.node: r for r in grown.collect()}
    want = []
    for r in frame.collect():
        node = nodes[""]
        while node.feature is not None:
            x = (r.a, r.b)[node.feature]
            node = nodes[node.node + ("0" if x is None or x <= node.threshold else "1")]
        want += [(r.k, node.ones / node.n, node.depth)] * (2 if r.k < 20 else 1)
    joins, step = [], tree._step
    monkeypatch.setattr(tree, "_step", lambda *a: joins.append(1) or step(*a))
    for small in (10_000, 150):
        monkeypatch.setattr(tree, "SMALL", small)
        joins.clear()
        assert sorted(map(tuple, tree.scores(grown, frame.unionByName(frame.where("k < 20")), "k", ["a", "b"]).collect())) == want
        assert len(joins) == (0 if small == 10_000 else max(r.depth for r in nodes.values() if r.n > small) + 1) < max(r.depth for r in nodes.values())
