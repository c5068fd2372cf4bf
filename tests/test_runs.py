"""Versioned reloads and the comparison of runs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hash_tree
from ledgerloom.plans import reload, star
from ledgerloom.queries import star_tables

SF = "/root/testdata/sf0.001"


def facts(tables):
    return {n: sorted(map(tuple, t.collect()), key=repr) for n, t in tables.items()}


def two(spark, x):
    return {"a": lambda _: spark.range(x).withColumn("v", F.lit(f"é{x}")), "b": lambda t: t["a"].agg(F.count("*").alias("n"), F.sum("id").alias("s"))}


def test_a_reload_that_fails_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "star")
    with pytest.raises(reload.ReloadFailed, match="no version"):
        reload.open_tables(spark, root)
    assert reload.publish(spark, root, two(spark, 3)) == 1
    pinned = reload.open_tables(spark, root)
    before = facts(pinned)

    def broken(_):
        return spark.range(9).select(F.raise_error(F.lit("half-way")).cast("long").alias("id"))

    with pytest.raises(Exception, match="half-way"):
        reload.publish(spark, root, two(spark, 5) | {"c": broken})
    failing = lambda t: t["a"].agg(F.lit("a is small").alias("name"), (F.count("*") < 4).alias("passed"))
    with pytest.raises(reload.ReloadFailed, match="a is small"):
        reload.publish(spark, root, two(spark, 5), failing)
    assert reload.versions(spark, root) == [1] and facts(reload.open_tables(spark, root)) == before
    assert reload.publish(spark, root, two(spark, 4)) == 2
    assert reload.publish(spark, root, {"a": two(spark, 0)["a"]}, failing) == 3
    assert facts(pinned) == facts(reload.open_tables(spark, root, 1)) == before
    assert reload.open_tables(spark, root)["a"].count() == 0 and set(reload.open_tables(spark, root)) == {"a"}
    assert reload.manifest(spark, root, 2)["tables"]["a"]["n_rows"] == 4
    # two folders of failed reloads and the first version go
    assert len(reload.vacuum(spark, root, 2)) == 3 and reload.versions(spark, root) == [2, 3]
    assert reload.open_tables(spark, root, 2)["b"].first().n == 4
    with pytest.raises(reload.ReloadFailed, match="no version 1"):
        reload.open_tables(spark, root, 1)


def test_a_number_is_given_once(spark, tmp_path):
    """A reload that ended between claim and manifest blocks its number only; one that lost the race publishes nothing."""
    root = str(tmp_path / "star")
    reload.publish(spark, root, two(spark, 1))
    reload._write(spark, f"{root}/manifests/00000002.claim", b"")
    assert reload.publish(spark, root, two(spark, 2)) == 3 and reload.versions(spark, root) == [1, 3]
    with pytest.raises(Exception, match="exist"):
        reload._write(spark, f"{root}/manifests/00000003.claim", b"")


def test_the_whole_star_and_its_checks(spark, tmp_path):
    root = str(tmp_path / "star")
    orders, items, products, tickets = star_tables(spark, SF)
    customers = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").alias("customer_id"))
    check = lambda t: star.star_checks(t, items)
    reload.publish(spark, root, star.star(customers, products, orders, items, tickets), check)
    t = reload.open_tables(spark, root)
    assert t["fact_item"].count() + t["quarantine"].count() == items.count() and t["quarantine"].count() > 0
    with pytest.raises(reload.ReloadFailed, match="orders have a customer"):
        reload.publish(spark, root, star.star(customers.where("customer_id % 3 <> 0"), products, orders, items, tickets), check)
    twice = products.unionByName(products.limit(1))
    with pytest.raises(reload.ReloadFailed, match="once"):
        reload.publish(spark, root, star.star(customers, twice.unionByName(products), orders, items, tickets), check)
    assert reload.versions(spark, root) == [1]


@pytest.mark.parametrize("pushed", [200, 1])
def test_differences(spark, monkeypatch, pushed):
    monkeypatch.setattr(hash_tree, "PUSHED", pushed)
    rng = random.Random(pushed)
    rows = [(rng.choice([k, -k, k * 10**12]), rng.choice(["x", None]), k) for k in range(3000)] + [(None, "n", 1), (5, "twice", 1), (5, "twice", 1)]
    after = [r for r in rows if r[2] % 400 != 9]
    after = [(k, "changed" if n % 700 == 3 else v, n) for k, v, n in after] + [(77_777_777, "new", 1), (None, "m", 1), (5, "twice", 1)]
    a, b = (spark.createDataFrame(x, "k long, v string, n long") for x in (rows, after))

    def grouped(x):
        out = {}
        for r in x:
            out.setdefault(r[0], []).append(r)
        return {k: sorted(v, key=repr) for k, v in out.items()}

    p, q = grouped(rows), grouped(after)
    want = sorted(((k, "added" if k not in p else "gone" if k not in q else "changed", len(p.get(k, [])), len(q.get(k, []))) for k in {*p, *q} if p.get(k) != q.get(k)), key=repr)
    got = sorted((tuple(r) for r in hash_tree.differences(a, b, "k").collect()), key=repr)
    assert got == want and len(want) > 10
    shuffled = b.repartition(7).select("n", "v", "k")  # the order of rows and columns does not matter
    assert hash_tree.differences(b, shuffled, "k").count() == 0
    assert hash_tree.differences(a.limit(0), a.limit(0), "k").count() == 0
    assert hash_tree.differences(a.limit(0), a, "k").agg(F.sum("n_after")).first()[0] == len(rows)
    texts = lambda df: df.withColumn("k", F.col("k").cast("string"))
    assert sorted((tuple(r) for r in hash_tree.differences(texts(a), texts(b), "k").collect()), key=repr) == sorted(((k if k is None else str(k), *r) for k, *r in want), key=repr)


def test_kept_trees_and_pushed_ranges(spark, tmp_path):
    """Compared by kept trees, the runs are read only where they differ: the scan gets the leaves as ranges."""
    spark.range(200_000).withColumn("v", F.col("id") % 7).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    b = a.withColumn("v", F.when(F.col("id") == 123_456, 99).otherwise(F.col("v")))
    trees = [hash_tree.tree(df, "id") for df in (a, b)]
    assert trees[0].where("level = 0").count() == 200_000 // 2**hash_tree.LEAF + 1
    assert [r.node for r in hash_tree.differing_leaves(*trees).collect()] == [123_456 >> hash_tree.LEAF]
    out = hash_tree.differences(a, b, "id", *trees)
    assert [tuple(r) for r in out.collect()] == [(123_456, "changed", 1, 1)]
    assert "GreaterThanOrEqual(id,122880)" in out._jdf.queryExecution().toString()
