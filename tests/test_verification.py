"""Numbers of texts against a registry, by hand and by plain Python, and runs compared item by item."""

import random

from pyspark.sql import functions as F

from ledgerloom.plans import verification

TEXT = """# Capa 11
## 1. Parte
Foram 1.234 pedidos (12,35 %) e -7,5 de saldo; `55` não, nem Tabela 3, 2024-01-02 ou 30/06.
| 8,125 | 12,3 |
|---|--:|
```
66
77
```
2. Em 90 dias, v1.2.3 e x9, 3/4; +0,5
## 7. Fim
88"""


def test_numbers_of_a_text(spark):
    df = spark.createDataFrame([("a", TEXT), ("b", None), ("c", ""), ("d", "5\n6")], "doc string, text string").withColumn("line", F.lit("clash"))
    out = verification.numbers_of(df, after="\n## 1.", before="\n## 7.")
    got = sorted((r.doc, r.line, r.shown, float(r.number), r.places) for r in out.collect())
    assert [x[2:] for x in got if x[0] == "a"] == [("-7,5", -7.5, 1), ("1.234", 1234.0, 0), ("12,35", 12.35, 2), ("12,3", 12.3, 1), ("8,125", 8.125, 3), ("+0,5", 0.5, 1), ("90", 90.0, 0)]
    assert [x for x in got if x[0] != "a"] == [("d", 1, "5", 5.0, 0), ("d", 2, "6", 6.0, 0)]
    assert {r.shown for r in verification.numbers_of(df).where("doc = 'a'").collect()} >= {"88"}


def plain(number, places, values, constants):
    if places <= 1 and abs(number) in constants:
        return "constant"
    tol = 0.5 * 10**-places + 1e-9 if places else 1e-9
    return "found" if any(abs(c - abs(number)) <= tol and (places or abs(c - round(c)) <= 1e-9) for v in values for c in (v, abs(v), v * 100)) else "missing"


def test_verdicts(spark):
    rng = random.Random(6)
    values = [1234.0, -7.5, 0.1235, 8.12449, 2.0, 1 / 3, -0.25, 0.125, 12.3, *(round(rng.uniform(-50, 50), 5) for _ in range(30))]
    shown = ["1.234", "7,5", "-7,5", "12,35", "8,124", "8,12", "2", "200", "33,3", "0,33", "25", "0,25", "0,13", "0,12", "12", "12,3", "90", "0,5", "0,50", "1.235", *(f"{rng.uniform(0, 50):.1f}".replace(".", ",") for _ in range(200))]
    texts = spark.createDataFrame([(k, s) for k, s in enumerate(shown)], "doc long, text string")
    registry = spark.createDataFrame([(v, f"o{k}") for k, v in enumerate(values)] + [(None, "none"), (float("nan"), "nan")], "value double, origin string")
    constants = {90.0: "days", 0.5: "threshold"}
    got = {r.doc: r for r in verification.verified(verification.numbers_of(texts, drop=[]), registry, constants).collect()}
    want = [plain(float(s.replace(".", "").replace(",", ".")), len(s.split(",")[1]) if "," in s else 0, values, constants) for s in shown]
    assert [got[k].verdict for k in range(len(shown))] == want and set(want) == {"found", "missing", "constant"}
    assert got[0].why == "o0" and got[16].why == "days" and got[19].why is None
    exact = {r.shown: r.verdict for r in verification.verified(verification.numbers_of(texts.limit(20), drop=[]), registry, {90.0: "days", 2.0: "two"}, exact=True).collect()}
    assert (exact["1.234"], exact["-7,5"], exact["7,5"], exact["2"], exact["90"], exact["12,35"], exact["0,12"]) == ("found", "found", "missing", "found", "constant", "missing", "missing")
    assert verification.verified(verification.numbers_of(texts), registry.limit(0), {}).where("verdict <> 'missing'").count() == 0


def test_runs_by_items(spark):
    table = spark.createDataFrame([(1, "x", "t1"), (2, None, "t1")], "k long, v string, made string")
    log = spark.createDataFrame([("02", "a", True, "0"), ("02", "a", True, "0"), ("02", "b", False, None), ("02", "b", True, "1")], "stage string, name string, passed boolean, observed string")
    files = spark.createDataFrame([("f.csv", "00"), ("g.csv", "11")], "path string, digest string")
    first = verification.run_items(files, {"t": table, "plain": table.select("k")}, log, without=["made"])
    later = verification.run_items(files.where("path = 'f.csv'"), {"t": table.withColumn("made", F.lit("t2")), "new": table, "plain": table.select("k")}, log.union(log.limit(1)), without=["made"])
    got = {(r.kind, r.item): r.state for r in verification.compare_items(first, later).collect()}
    assert got == {
        ("file", "f.csv"): "equal", ("file", "g.csv"): "gone", ("table", "t"): "differs", ("table without stamps", "t"): "equal", ("table", "new"): "added", ("table without stamps", "new"): "added", ("table", "plain"): "equal",
        ("assertion", "02 / a"): "differs", ("assertion", "02 / b"): "equal",
    }
    b = first.where("item = '02 / b'").first()["print"]
    assert b == "passed=false observed=none times=1; passed=true observed=1 times=1"
    reports = verification.measured(table, "t", F.col("k"))
    assert sorted((r.value, r.origin) for r in reports.collect()) == [(1.0, "t:1:k"), (2.0, "t (rows)"), (2.0, "t:2:k")]
