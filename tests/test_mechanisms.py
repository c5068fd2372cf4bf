"""Operators with a mechanism of their own against plain Python, with hot keys, nulls and ties."""

import bisect
import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom import mechanisms
from ledgerloom.operators import quantiles, temporal

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


# --- as-of join


def plain_asof(left, right, inclusive, tolerance):
    out = []
    for row in left:
        key, t = row[0], row[1]
        best = [r for r in right if None not in (key, t, r[0], r[1]) and r[0] == key and (r[1] <= t if inclusive else r[1] < t) and (tolerance is None or True)]
        top = max(best, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        if top and tolerance is not None and top[1] < t - tolerance:
            top = None
        out.append((*row, top[2] if top else None, top[1] if top else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("inclusive", "tolerance"), [(True, None), (False, None), (True, 3)])
def test_asof(spark, inclusive, tolerance):
    rng = random.Random(1)
    key = lambda: rng.choice([7, 7, 7, 1, 2, 3, None, rng.randrange(40)])  # noqa: E731  a third and more under one key
    left = [(key(), rng.choice([None, *range(50)]), k) for k in range(900)] + [(7, 5, 0)] * 3
    right = [(key(), rng.choice([None, *range(0, 50, 2)]), rng.choice([None, *range(9)])) for _ in range(700)]
    a = spark.createDataFrame(left, "k long, t long, `v` long")
    b = spark.createDataFrame(right, "k long, t long, v long")
    out = temporal.asof(a, b, [("k", "k")], "t", "t", {"got": "v", "at": "t"}, inclusive, (lambda t: t - tolerance) if tolerance is not None else None)
    assert out.columns == ["k", "t", "v", "got", "at"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_asof(left, right, inclusive, tolerance)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_asof_carries_over_ranges_of_one_key(spark):
    """One key alone, one early right row: every range gets it from the ones before."""
    left = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, 3, "early")], "k long, t long, v string")
    out = temporal.asof(left, right, [("k", "k")], "t", "t", {"v": "v"})
    assert {tuple(r) for r in out.groupBy("v").count().collect()} == {(None, 3), ("early", 4997)}
    assert temporal.asof(left.limit(0), right, [("k", "k")], "t", "t", {"v": "v"}).count() == 0
    assert temporal.asof(left, right.limit(0), [("k", "k")], "t", "t", {"v": "v"}).where("v IS NULL").count() == 5000


# --- interval join


@pytest.mark.parametrize("hot", [50_000, 20])
def test_interval_join(spark, monkeypatch, hot):
    monkeypatch.setattr(temporal, "HOT", hot)
    rng = random.Random(2)
    day = lambda n: None if n is None else datetime.date(1999, 1, 1) + datetime.timedelta(n)
    key = lambda: rng.choice([1, 1, 2, None, rng.randrange(9)])
    points = [(k, key(), rng.choice([None, *range(-40, 400)])) for k in range(500)]
    spans = [(k, key(), s := rng.randrange(-30, 390), rng.choice([None, s, s + 1, s + rng.randrange(300), s - 1])) for k in range(120)]
    a = spark.createDataFrame([(p, k, day(t)) for p, k, t in points], "p long, k long, at date")
    b = spark.createDataFrame([(s, k, day(x), day(y)) for s, k, x, y in spans], "s long, kk long, lo date, hi date")
    out = temporal.interval_join(a, b, [("k", "kk")], "at", "lo", "hi")
    want = sorted((p, s) for p, k, t in points for s, q, x, y in spans if None not in (k, t, y) and k == q and x <= t <= y)
    assert sorted((r.p, r.s) for r in out.collect()) == want and len(want) > 400
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert ("_salt" in plan(out)) == (hot == 20)
    micros = temporal.interval_join(a.withColumn("at", F.col("at").cast("timestamp")), b.withColumns({"lo": F.col("lo").cast("timestamp"), "hi": F.col("hi").cast("timestamp")}), [("k", "kk")], "at", "lo", "hi")
    assert sorted((r.p, r.s) for r in micros.collect()) == want
    assert temporal.interval_join(a, b.limit(0), [("k", "kk")], "at", "lo", "hi").count() == 0


# --- exact quantiles


def plain_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("small", [1024, 3])
def test_group_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    rng = random.Random(3)
    values = {
        "spread": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(99)],
        "equal": [2.5] * 40,
        "near": [1.0, 1.0000000000000002, 1.0000000000000004, 1.0] * 5,
        "signs": [-0.0, 0.0, -5e-324, 5e-324, 1.7e308, -1.7e308, 3.0, 3.0],
        None: [float(k) for k in range(11)],
        "one": [4.0],
        "ends": [float("inf")] * 3 + [float("-inf")] * 3 + [1.0],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("none", float("nan")), ("one", None), ("near", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").withColumn("_v", F.lit("clash"))
    out = {r.g: r for r in quantiles.group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    assert set(out) == {*values, "none"} and out["none"].b is None
    for g, vs in values.items():
        if g != "ends":
            for name, p in (("a", 0.25), ("b", 0.5), ("c", 1.0)):
                assert out[g][name] == pytest.approx(plain_quantile(vs, p), rel=1e-12, abs=0), (g, name)
    assert (out["ends"].b, out["ends"].c) == (1.0, float("inf"))
    assert quantiles.group_quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_a_group_of_a_million(spark):
    """Counted in buckets: what a rank leaves after the partial sums is some thousand rows a task, never the group."""
    df = spark.range(1_000_001).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 1_000_001 / 7).alias("v"))
    out = quantiles.group_quantiles(df, ["g"], "v", {"median": 0.5, "p99": 0.99}).first()
    assert (out.median, out.p99) == (500_000 / 7, 990_000 / 7)
    assert statistics.median([1, 2]) == 1.5


def test_hot_cells_and_ranges_bound_what_meets(spark):
    """A third of all points and tickets under one key: results stay whole."""
    out = mechanisms.ticket_last_order(spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert out.count() == events.count()
    times = sorted(r[0] for r in out.where("last_order IS NOT NULL").select("placed").collect())
    assert bisect.bisect(times, datetime.date(2001, 12, 31)) == len(times)


# --- metrics


def test_metrics_scan_each_table_once(spark, tmp_path):
    from ledgerloom.plans import metrics
    from ledgerloom.plans.metrics import Metric, rows_that

    a = [(k, "x" if k % 3 else None, k % 2 == 0 if k % 5 else None, float(k)) for k in range(40)]
    spark.createDataFrame(a, "id long, kind string, flag boolean, v double").write.parquet(str(tmp_path / "a"))
    t = {"a": spark.read.parquet(str(tmp_path / "a")), "b": spark.range(7), "empty": spark.range(0).withColumn("g", F.lit("q"))}
    specs = [
        Metric("n", "a", F.count("*")), Metric("flagged", "a", rows_that(F.col("flag")), "n"), Metric("kinds", "a", F.count("*"), "n", by="kind"), Metric("sum", "a", F.sum("v"), by="flag"), Metric("distinct", "a", F.countDistinct("kind")),
        Metric("b", "b", F.max("id")), Metric("of_b", "b", F.count("*"), "b"), Metric("none", "empty", F.count("*")), Metric("by of none", "empty", F.count("*"), "none", by="g"),
    ]
    got = {r.key: (r.value, r.percent) for r in metrics.measure(t, specs).collect()}
    flagged = sum(bool(r[2]) for r in a)
    assert got["n"] == (40, None) and got["flagged"] == (flagged, 100 * flagged / 40) and got["distinct"] == (1, None)
    assert got["kinds.x"] == (26, 65.0) and got["kinds.none"] == (14, 35.0) and got["b"] == (6, None) and got["of_b"][1] == 700 / 6
    assert {k: v[0] for k, v in got.items() if k.startswith("sum.")} == {f"sum.{n}": sum(r[3] for r in a if r[2] is f) for n, f in (("true", True), ("false", False), ("none", None))}
    assert got["none"] == (0, None) and "by of none.q" not in got and len(got) == 11
    assert plan(metrics._of_table(t["a"], specs[:5])).split("== Physical")[1].count("FileScan") == 1
    for bad in ([specs[0], specs[0]], [Metric("k", "a", F.count("*"), "nothing")], [Metric("k", "c", F.count("*"))]):
        with pytest.raises(ValueError, match="twice|bases|tables"):
            metrics.measure(t, bad)


def test_z_scores_by_training_rows_only(spark):
    """Rows left out of training get z scores by the mean and deviation of the others; those without a value get none."""
    from ledgerloom.plans import features

    values = [(k, float(k % 17) if k % 9 else None, k % 3 != 0) for k in range(200)]
    rows = features.z_scores(spark.createDataFrame(values, "k long, v double, t boolean"), "v", train=F.col("t")).collect()
    seen = [v for _, v, t in values if t and v is not None]
    mean, std = statistics.fmean(seen), statistics.pstdev(seen)
    assert len(rows) == 200 and all((r.z is None) == (r.v is None) and (r.v is None or abs(r.z - (r.v - mean) / std) < 1e-5) for r in rows)
    assert abs(statistics.fmean(r.z for r in rows if r.t and r.v is not None)) < 1e-5


def test_profiles_of_parts_merge_to_that_of_all(spark, tmp_path):
    from ledgerloom.operators import sketches

    rows = [(k % 7 if k % 50 else None, float(k * 7919 % 10_007) if k % 11 else None, k) for k in range(20_000)]
    df = spark.createDataFrame(rows, "day long, v double, k long").withColumn("part", F.lit("clash"))
    parts = sketches.profile_parts(df, F.coalesce("day", F.lit(-1)), ["v", "k"])
    sketches.store(parts, str(tmp_path / "p"))
    sketches.store(sketches.profile_parts(df.where("day = 3"), F.col("day"), ["v", "k"]), str(tmp_path / "p"))  # the same day once more
    kept = spark.read.parquet(str(tmp_path / "p"))
    assert kept.count() == 16
    points = {"q1": 0.25, "median": 0.5}
    merged = {r["column"]: r for r in sketches.merge(kept, points).collect()}
    direct = {r["column"]: r for r in sketches.merge(sketches.profile_parts(df, F.lit(0), ["v", "k"]), points).collect()}
    for c, i in (("v", 1), ("k", 2)):
        seen = sorted(r[i] for r in rows if r[i] is not None)
        a, b = merged[c], direct[c]
        assert (a.n_rows, a.n_null, a.least, a.greatest) == (b.n_rows, b.n_null, b.least, b.greatest) == (20_000, 20_000 - len(seen), seen[0], seen[-1])
        assert a.mean == pytest.approx(statistics.fmean(seen)) and a.n_distinct == b.n_distinct and abs(a.n_distinct - len(set(seen))) < 0.04 * len(set(seen))
        for name, p in points.items():
            assert abs(bisect.bisect(seen, a[name]) / len(seen) - p) < 0.02 and abs(bisect.bisect(seen, b[name]) / len(seen) - p) < 0.02
    empty = sketches.merge(sketches.profile_parts(df.where("k < 1").withColumn("v", F.lit(None).cast("double")), F.lit(0), ["v"]), points).first()
    assert (empty.n_rows, empty.n_null, empty["median"], empty.n_distinct) == (1, 1, None, 0)
    assert sketches.merge(sketches.profile_parts(df.limit(0), F.lit(0), ["v"]), points).count() == 0
