"""Plausibility of references and estimates with bounds: by hand, on the tables, with nulls and empty inputs."""

import datetime

from pyspark.sql import functions as F

from ledgerloom import evidence
from ledgerloom.plans import plausibility

SF = "/root/testdata/sf0.001"


def test_references_by_hand(spark):
    day = lambda n: datetime.date(2024, 1, n)
    claims = spark.createDataFrame(
        [(1, "A", 5, 70, day(3)), (2, "A", 6, 70, day(1)), (3, "B", 6, 71, day(9)), (4, "A", 9, 70, day(3)), (5, None, 5, 70, day(3)), (6, "A", None, None, None), (7, "B", 5, 99, day(2))], "id long, ref_system string, ref_id long, product_id long, sent date"
    ).withColumns({"system": F.lit("clash"), "placed": F.lit(1)})
    orders = spark.createDataFrame([("A", 5, day(2)), ("B", 5, day(4)), ("B", 6, day(5))], "system string, order_id long, placed date")
    lines = spark.createDataFrame([("A", 5, 70), ("A", 5, 70), ("B", 6, 71), ("B", 5, 70)], "system string, order_id long, product_id long")
    products = spark.createDataFrame([(70,), (71,), (71,)], "product_id long")
    met = plausibility.referred(claims, orders, lines, products, ("A", "B"))
    got = {r.id: (r.in_declared, r.in_other, r.product_known, r.product_in_order, r.sent_after) for r in met.collect()}
    assert got == {
        1: (True, True, True, True, True), 2: (False, True, True, False, None), 3: (True, False, True, True, True), 4: (False, False, True, False, None),
        5: (False, False, True, False, None), 6: (False, False, False, False, None), 7: (True, True, False, False, False),
    }
    counts = {r.ref_system: tuple(r)[1:] for r in plausibility.reference_counts(met).collect()}
    assert counts == {"A": (4, 1, 1, 1, 2, 3, 1, 1), "B": (2, 2, 0, 1, 0, 1, 1, 1), None: (1, 0, 0, 0, 1, 1, 0, 0)}
    assert plausibility.reference_counts(plausibility.referred(claims.limit(0), orders, lines, products, ("A", "B"))).count() == 0
    assert plausibility.referred(claims, orders.limit(0), lines.limit(0), products, ("A", "B")).where("in_declared OR in_other OR product_in_order").count() == 0


def test_counterparts_by_hand(spark):
    """A pair by tax id; a namesake without a valid id on one side; namesakes with two valid ids are two persons."""
    rows = [("L", "1", True, "ANA", "PE"), ("E", "1", True, "ANA", None), ("L", "2", True, "RUI", None), ("E", "3", True, "RUI", None), ("L", None, None, "RUI", None), ("L", "4", True, "EVA", "SP"), ("E", "4", False, "EVA", "SP"), ("L", "1", False, "X", None), ("L", None, None, None, None)]
    r = spark.createDataFrame(rows, "system string, tax string, tax_ok boolean, folded string, region string")
    out = plausibility.bounds("both", *plausibility.with_counterpart(r, "L")).first()
    # surely: the two records with tax id 1; perhaps: the RUI without one, and EVA
    assert tuple(out) == ("both", 2, 4, 6)
    assert tuple(plausibility.bounds("both", *plausibility.with_counterpart(r.limit(0), "L")).first()) == ("both", 0, 0, 0)


def test_reports_tell_something(spark):
    estimates = {r.estimate: r for r in evidence.bounded_estimates(spark, SF).collect()}
    assert len(estimates) == 5 and all(r.lower <= r.upper <= r.base for r in estimates.values())
    assert all(0 < estimates[e].lower < estimates[e].upper < estimates[e].base for e in ("customers of both systems", "tickets of the other system"))
    assert all(0 < r.n < r.base for r in evidence.source_anomalies(spark, SF).collect())
    for r in evidence.review_references(spark, SF).collect():
        assert min(r[1:]) > 0 and r.in_declared + r.only_other + r.nowhere == r.n
    for q in evidence.QUERIES.values():
        plan = q(spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan
