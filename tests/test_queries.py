"""Every registered retail query with SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom import audits, evidence, mechanisms, queries, reports

QUERIES, ORACLES = queries.QUERIES | audits.QUERIES | reports.QUERIES | evidence.QUERIES | mechanisms.QUERIES, queries.ORACLES | audits.ORACLES | reports.ORACLES | evidence.ORACLES | mechanisms.ORACLES
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert ours == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())


def test_controls_differ(spark):
    """What must fail does: a leaking copy, discounts that were mended, lines without an order, taxes of two persons."""
    proof = QUERIES["leakage_proof"](spark, SF).collect()
    assert all(r.n_different == 0 for r in proof if r.against == "snapshot") and sum(r.n_different > 0 for r in proof if r.against != "snapshot") >= 8
    assert {r["column"] for r in QUERIES["column_parity"](spark, SF).collect() if not r.equal} == {"discount"}
    assert {r.name for r in QUERIES["assertion_log"](spark, SF).collect() if not r.passed} == {"lines without an order"}
    assert all(r.difference == 0 for r in QUERIES["reconciliation"](spark, SF).collect()) and any(r.false_difference for r in QUERIES["reconciliation"](spark, SF).collect())
    planted = {(r.source, r.anomaly): r.n for r in QUERIES["anomalies_by_source"](spark, SF).collect()}
    assert planted["SAC", "lines equal to an earlier one"] and planted["LEGADO", "name and date repeated"] and planted["ECOM", "lines without an order"] and not planted["LEGADO", "lines without an order"]
    checks = {(r.run, r.check): r.n for r in QUERIES["leak_confinement"](spark, SF).collect()}
    assert {c for (run, c), n in checks.items() if run == "leak" and n} == {"recency below zero"}
    assert {c for (run, c), n in checks.items() if run == "broken" and not n} == {"recency below zero"} and len(checks) == 16
    assert {r.key: r.n for r in QUERIES["foreign_keys"](spark, SF).collect()}["line to order"] > 0
    audit = {r.key: r for r in QUERIES["key_audit"](spark, SF).collect()}
    assert all(0 < r.n_valid < r.n_present for r in audit.values()) and all(r.n_agree_email < r.n_pairs for k, r in audit.items() if k != "email")
    persons = QUERIES["people"](spark, SF).collect()
    assert any(r.tax_conflict for r in persons) and any("DUPLICATA_LEGADO" in (r.rules or "") for r in persons)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
