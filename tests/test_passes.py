"""Steps that many queries share go through the lines once, and deal rows once."""

from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.llm.jaccard_join import jaccard_classes
from ledgerloom.operators.keys import dense_keys
from ledgerloom.plans import conform, star
from ledgerloom.plans import features as feat
from ledgerloom.queries import CUT, raw_items, raw_orders, star_tables, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_keys_are_dealt_once(spark):
    """Ranges are numbered in the order they are written in, not by a window over rows that are shuffled again."""
    df = spark.range(2_000).select((F.col("id") * 7919 % 2_003).alias("k"))
    out = dense_keys(df, [F.col("k").desc()], "nth")
    assert [r.k for r in out.orderBy("nth").collect()] == sorted((i * 7919 % 2_003 for i in range(2_000)), reverse=True)
    assert [r.nth for r in out.orderBy("nth").collect()] == list(range(1, 2_001)) and out.columns == ["k", "nth"]
    shown = plan(out.select("k", "nth"))
    assert shown.count("hashpartitioning(_range") == 1  # of the sizes, a row a range


def test_orders_need_no_join_of_lines(spark):
    """Lines are summed where they are read: no row of a line meets the orders."""
    raw, lines = raw_orders(spark, SF), raw_items(spark, SF)
    a, b = conform.orders(raw, conform.mended(lines)), conform.orders(raw, conform.items(lines, raw))
    assert a.schema == b.schema and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert plan(a).count("Join") < plan(b).count("Join")


def test_features_of_orders_that_carry_their_categories(spark):
    orders, items, products, tickets = star_tables(spark, SF)
    with_levels = storage.saved(feat.with_levels(orders, items, products), "levels")
    a, b = feat.features(orders, items, products, tickets, CUT), feat.features(with_levels, None, None, tickets, CUT)
    assert with_levels.count() == orders.count() and a.schema == b.schema
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.where("n_categories > 1").count() > 10


def test_lines_of_a_star_meet_their_orders_once(spark):
    """Facts and quarantine come from the same scratch table."""
    orders, items, products, tickets = star_tables(spark, SF)
    build = star.star(table(spark, SF, "customer").select(F.col("c_custkey").alias("customer_id")), products, orders, items, tickets)
    done = {}
    for name in ("dim_customer", "dim_product", "dim_channel", "fact_order", "fact_item", "quarantine"):
        done[name] = storage.saved(build[name](done), "test")
    aside = build["quarantine"](done)
    assert all("/lines-" in f for f in aside.inputFiles()) and "Join" not in plan(aside)
    assert aside.columns == star.quarantine(items).columns and aside.exceptAll(star.quarantine(items)).count() == 0 < aside.count()
    assert done["fact_item"].count() == star.fact_item(items, done["fact_order"]).count() == items.where("order_exists").count()


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    before = spark.conf.get(storage.PARTITIONS)
    assert storage.tasks_for_rows(spark, 1_234) == 13 and storage.tasks_for_rows(spark, 0) == int(before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = storage.saved(spark.range(5_000).groupBy((F.col("id") % 999).alias("k")).count(), "tasks", 13)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out.inputFiles()) == 13 and spark.conf.get(storage.PARTITIONS) == before


def test_classes_are_joined_from_saved_tables(spark):
    """The last plan of the near-duplicate join has two joins; the tables below are not planned, broadcast and run twice."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 5, i % 5 + 9))) for i in range(20)]
    out = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, i % 5) for i in range(20)}
