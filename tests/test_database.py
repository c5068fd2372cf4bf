"""Database sources against the embedded database that comes with Spark."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers
from ledgerloom.sources.database import Database

SF = "/root/testdata/sf0.001"


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})


def test_load_and_read_back(spark, db):
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumns({"o_orderdate": F.to_date("o_orderdate"), "o_totalprice": F.col("o_totalprice").cast("decimal(14,2)"), "o_orderpriority": F.when(F.col("o_orderkey") % 9 != 0, "é;\n\"x\"")})
    db.wait()
    assert db.load(orders, "orders") == orders.count()
    back = db.table("orders", orders.columns, "o_orderkey", "erp", parts=5)
    assert sorted(map(repr, back.select(*orders.columns).collect())) == sorted(map(repr, orders.collect()))
    numbers = [(r._line, r.o_orderkey) for r in back.collect()]
    assert sorted(n for n, _ in numbers) == list(range(1, len(numbers) + 1)) and sorted(numbers) == sorted(zip(range(1, len(numbers) + 1), sorted(k for _, k in numbers), strict=True))
    assert {r._source for r in back.select("_source").distinct().collect()} == {"erp"}
    keyed = db.table("orders", ["o_orderkey", "o_custkey"], "o_orderkey", "erp", numbered=False)
    assert keyed.where("_line <> o_orderkey").count() == 0 and keyed.columns[:2] == ["o_orderkey", "o_custkey"]


def test_ranges_of_a_skewed_key(spark, db):
    """Nine tenths of the rows on a thousandth of the keys, a quarter of all on one key, and rows without a key."""
    rows = [(k % 50 + 10**6, k) for k in range(6000)] + [(10**6 + 7, k) for k in range(2500)] + [(k * 10**5, k) for k in range(-300, 700)] + [(None, 1)] * 30 + [(2**62, 0), (-(2**62), 0)]
    df = spark.createDataFrame(rows, "k long, v long")
    db.load(df, "skewed", types="k BIGINT, v BIGINT")
    found = db.ranges("skewed", "k", 12)
    assert sum(r[2] for r in found) == 9502 and len(found) <= 30
    assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
    most = -(-9502 // 12)
    assert all(n <= most or lo == hi for lo, hi, n in found)
    back = db.table("skewed", ["k", "v"], "k", "erp", parts=12, numbered=False)
    assert sorted(map(repr, back.select("k", "v").collect())) == sorted(map(repr, df.collect()))
    sizes = [len(p) for p in back.rdd.glom().collect()]
    assert max(n for n in sizes) <= 2500 + 6000 // 50 + most
    db.load(df.where("k IS NULL"), "skewed", types="k BIGINT, v BIGINT")
    assert db.ranges("skewed", "k", 3) == [] and db.table("skewed", ["k"], "k", "erp").count() == 30


def test_a_load_that_fails_leaves_the_table(spark, db):
    db.load(spark.range(5), "t")
    with pytest.raises(Exception, match="broken"):
        db.load(spark.range(9).withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long"))), "t")
    assert db.ask("SELECT COUNT(*) AS n FROM t").first()[0] == 5
    db.load(spark.range(7), "t")
    assert db.ask("SELECT COUNT(*) AS n FROM t").first()[0] == 7 and not db.exists("t_load") and not db.exists("t_old")


def test_seed_files_into_tables(spark, db, tmp_path):
    """Empty fields of a seed file are nulls in the database."""
    (tmp_path / "seed.csv").write_text('id,name,price,day\n1,,2.50,2024-01-02\n2,"a, ""b""",,\n')
    seed = readers.seed_csv(spark, str(tmp_path / "seed.csv"), "id long, name string, price decimal(8,2), day date")
    db.load(seed, "seed")
    got = sorted(tuple(r)[:4] for r in db.table("seed", ["id", "name", "price", "day"], "id", "seed").collect())
    assert got == [(1, None, decimal.Decimal("2.50"), datetime.date(2024, 1, 2)), (2, 'a, "b"', None, None)]


def test_names_and_absent_databases(spark, tmp_path):
    absent = Database(spark, f"jdbc:derby:{tmp_path}/none", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    with pytest.raises(Exception, match="none"):
        absent.wait(2, 0.01)
    with pytest.raises(ValueError, match="plain name"):
        absent.table("t; DROP TABLE t", ["a"], "a", "x")
