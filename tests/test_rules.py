"""Edge rows of the conformance rules, sources and sinks, and the streams."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers, text
from ledgerloom.operators import graph, identity, models, profile
from ledgerloom.operators.assertions import Suite
from ledgerloom.plans import conform, diagnostics, features
from ledgerloom.sources import csv_ranges, generator, readers, sinks
from ledgerloom.streaming import events


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_text(spark):
    assert values(spark, text.tax_id_valid, ["529.982.247-25", "52998224724", "11111111111", "123", None, ""]) == [True, False, False, None, None, None]
    assert values(spark, text.fold_name, [" José  da Sílva ", None]) == ["JOSE DA SILVA", None]
    assert values(spark, text.ascii_label, ["Ção 中 x"]) == ["cao x"]
    assert values(spark, text.sentinel_to_null, ["n/a", "Recife"]) == [None, "Recife"]
    assert values(spark, text.without_note, ["TROCA\nobs: cliente reiterou o contato"]) == ["TROCA"]
    assert values(spark, lambda x: text.reference(x)[1], ["LEG-12", "nothing", None, "ECOM-7"]) == [12, None, None, 7]
    assert values(spark, text.looks_garbled, ["SÃ£o", "São", "a�"]) == [True, False, True]


def test_numbers_and_dates(spark):
    assert [None if v is None else float(v) for v in values(spark, numbers.comma_number, ["1,5", " 2 ", "x", "", None])] == [1.5, 2.0, None, None, None]
    assert values(spark, dates.day_month_year, ["31/02/2025", "01/02/2025"]) == [None, datetime.date(2025, 2, 1)]
    assert values(spark, lambda x: dates.local_date(dates.iso_instant(x)[0]), ["2025-06-30T23:30:00", "2025-07-01T02:00:00Z", "bad"]) == [datetime.date(2025, 6, 30), datetime.date(2025, 6, 30), None]
    assert dates.calendar(spark).count() == 1217


def test_orders(spark):
    raw = spark.createDataFrame(
        [("LEGADO", 1, 5, "ENTREGUE", "LOJA", "2025-06-01", "1900-01-01", "-5"), ("ECOM", 1, 5, "delivered", "app", "2025-06-10", "2025-06-08", "0"), ("ECOM", 2, 6, "payment_declined", "?", "2025-06-10", None, "1")],
        "system string, order_id long, customer_id long, raw_status string, raw_channel string, order_date string, delivery_date string, freight string",
    ).withColumns({"order_date": F.to_date("order_date"), "delivery_date": F.to_date("delivery_date"), "freight": F.col("freight").cast("decimal(18,4)")})
    lines = spark.createDataFrame([("LEGADO", 1, 1, 9, 2, "10", "-1"), ("LEGADO", 2, 77, 9, 1, "1", "0")], "system string, item_id long, order_id long, product_id long, quantity int, unit_price string, discount string")
    lines = conform.items(lines.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("unit_price", "discount")}), raw)
    got = {(r.system, r.order_id): r for r in conform.orders(raw, lines).collect()}
    a, b, c = got["LEGADO", 1], got["ECOM", 1], got["ECOM", 2]
    assert (float(a.total), a.discount_absent, a.delivery_undated, a.delivery_date, a.freight_negative, a.channel) == (15.0, True, True, None, True, "FISICO")
    assert (b.delivery_too_early, b.delivery_days, b.units) == (True, None, 0)
    assert (c.status, c.cancel_reason, c.effective, c.channel) == ("CANCELADO", "PAGAMENTO_RECUSADO", False, None)
    assert lines.where("NOT order_exists").count() == 1
    assert conform.unmapped(raw.select("system", "raw_channel"), conform.channel_table(spark), ["system", "raw_channel"]).collect()[0].n == 1


def test_tickets_reviews_products(spark, tmp_path):
    raw = spark.createDataFrame(
        [("p1", "529.982.247-25", "01/06/2025", "", " web ", "TROCA\nobs: cliente reiterou o contato", "0", "-3", 2), ("p1", "x", "01/06/2025", "", "late", "elogio", "5", "1", 3), ("p2", "111", "bad", None, None, "nada", "4,0", "2,5", 4)],
        "protocol string, tax_id string, opened string, closed string, channel string, reason string, rating string, hours string, line int",
    )
    owners = spark.createDataFrame([("52998224725", 1), ("111", 2), ("111", 3)], "tax_id string, customer_key long")
    got = {r.protocol: r for r in conform.tickets(raw, owners).collect()}
    assert (got["p1"].customer_key, got["p1"].reason, got["p1"].reiterated, got["p1"].rating, got["p1"].rating_zero, got["p1"].hours, got["p1"].channel) == (1, "TROCA", True, None, True, None, "WEB")
    assert (got["p2"].customer_key, got["p2"].tax_id_ambiguous, got["p2"].rating, float(got["p2"].hours), got["p2"].reason, got["p2"].opened) == (None, True, 4, 2.5, None, None)
    path = tmp_path / "r.ndjson"
    path.write_text('{"review_id":"a","order":{"ref":"LEG-3"},"product":{"sku":"LEG-9"},"submitted_at":"2025-06-30T23:30:00","rating":"5"}\n\n{"review_id":"b","product":{"sku":"S1"},"submitted_at":"2025-07-01T02:00:00Z","rating":null,"comment":null}\n{"review_id":"c","rating":0}\n')
    rows = readers.ndjson(spark, str(path))
    lines = {r.review_id: r for r in rows.collect()}
    assert [lines[k]._line for k in "abc"] == [1, 3, 4]
    assert "order_ref" in lines["b"].absent_paths and set(lines["b"].null_paths) == {"rating", "comment"} and "rating" in lines["a"].text_paths
    keys = spark.createDataFrame([("LEGADO", "9", 7), ("ECOM", "S1", 8)], "system string, reference string, product_key long")
    got = {r.review_id: r for r in conform.reviews(rows, keys).collect()}
    assert (got["a"].rating, got["a"].rating_was_text, got["a"].ref_id, got["a"].product_key, got["a"].offset_missing) == (5, True, 3, 7, True)
    assert (got["b"].rating, got["b"].product_key, got["b"].local_day) == (None, 8, datetime.date(2025, 6, 30)) and got["c"].rating is None
    old = spark.createDataFrame([(1, "x", "Eletro-Domésticos"), (2, "y", None), (3, "z", "eletro")], "product_id long, description string, label string")
    new = spark.createDataFrame([(1, "w", 20)], "product_id long, description string, category_id int")
    tree = spark.createDataFrame([(10, "Casa", None), (20, "Móveis", 10)], "category_id int, name string, parent_id int")
    got = {(r.system, r.product_id): (r.level1, r.level2, r.mapping) for r in conform.products(old, new, tree).collect()}
    assert got == {("LEGADO", 1): ("Eletrodomésticos", None, "nivel"), ("LEGADO", 2): (None, None, "sem_mapeamento"), ("LEGADO", 3): (None, None, "ambiguo"), ("ECOM", 1): ("Casa", "Móveis", "taxonomia_origem")}


def test_csv_and_sinks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('a;b\r\n1;"São\nPaulo"\r\n;x\r\n'.encode("latin-1"))
    rows = readers.text_csv(spark, str(path), ["a", "b"], "sac").orderBy("_line").collect()
    assert [(r.a, r.b, r._line) for r in rows] == [("1", "São\nPaulo", 1), ("", "x", 2)]
    assert readers.count_records(spark, str(path)).first().n_records == 2
    df = spark.createDataFrame([(1, 2.5, "a", 1), (2, None, "b", 0)], "id long, x double, c string, y int")
    sinks.annotated_csv(df, str(tmp_path / "o"), "y", ["id"], "id")
    out = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert out == ["id,x,c,y", "continuous,continuous,discrete,discrete", "meta,,,class", "1,2.5,a,1", "2,,b,0"]
    again = csv_ranges.annotated_csv(spark, str(tmp_path / "o"), ["id"])
    assert sorted(r.id for r in again.collect()) == ["1", "2"]
    assert sinks.render("{{a|pct}} {{b|brl}} {{c}}", {"a": 12.5, "b": 1234.5, "c": 1000}) == "12,50 % R$ 1.234,50 1.000"
    assert "| 1 |" in sinks.markdown(df.select("id"), "t") and '"k": 2' in sinks.registry_json(spark.createDataFrame([("k", 2.0)], "key string, value double"))


def test_assertions_profile_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k long, v string")
    suite = Suite(spark, "s").unique(df, "u", "k").no_nulls(df, "n", "v").domain(df, "d", "v", ["a"]).at_least(df, "l", F.count("*"), 3)
    got = {r.name: (r.passed, r.value) for r in suite.results().collect()}
    assert got == {"u": (False, 1.0), "n": (False, 1.0), "d": (False, 2.0), "l": (True, 3.0)} and suite.failed()
    suite.write(str(tmp_path / "log"))
    Suite(spark, "t").at_least(df, "l", F.count("*"), 3).write(str(tmp_path / "log"))
    suite.write(str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5
    assert profile.fingerprint(df).collect() == profile.fingerprint(df.orderBy(F.desc("k"))).collect()
    registry = spark.createDataFrame([("a", 12.345), ("b", 0.25)], "key string, value double")
    texts = spark.createDataFrame([("d", "12,35 e 25 % mas 99,9")], "doc string, text string")
    assert [r.shown for r in diagnostics.verify_numbers(texts, registry).collect()] == ["99,9"]
    assert diagnostics.upsert(registry, spark.createDataFrame([("a", 1.0)], "key string, value double")).count() == 2


def test_components_and_identity(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3), (100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.components(chain).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert graph.components(chain.limit(0)).count() == 0
    fields = "node long, system string, source_id long, name string, tax_id string, email string, phone string, city string, region string, signed_up date"
    rows = [
        (1, "L", 1, "José Silva", "529.982.247-25", "A@x", "1", "N/A", "PE", None), (2, "L", 2, "JOSE  SILVA", None, "a@X ", "1", "Olinda", "PE", None),
        (3, "E", 3, "Jose Silva", "52998224725", "b@x", "2", "Recife", None, None), (4, "E", 4, "Ana", "52998224725", "c@x", "3", None, None, None),
        (5, "L", 5, "Rui", "12345678900", None, None, None, None, None), (6, "E", 6, "RUI", "12345678900", None, None, None, None, None),
    ]
    gold, bridge = identity.persons(spark.createDataFrame(rows, fields))
    got = {r.person: r for r in gold.collect()}
    assert set(got) == {1, 4, 5}
    assert (got[1].origin, got[1].rules, got[1].city, got[1].tax, got[1].tax_conflict) == ("AMBOS", "CPF_VALIDO_NOME+DUPLICATA_LEGADO", "Recife", "52998224725", True)
    assert got[4].tax is None and got[4].tax_conflict and got[5].rules == "CPF_INVALIDO_NOME_UF"
    assert sorted((r.node, r.role) for r in bridge.where("person = 1").collect()) == [(1, "SOBREVIVENTE"), (2, "ABSORVIDO"), (3, "ABSORVIDO")]


def test_golden_records_by_the_order_of_the_rows(spark):
    """The best row of a system is neither its first nor the person's smallest node; and a person only of the shop comes last."""
    fields = "node long, system string, source_id long, name string, tax_id string, email string, phone string, city string, region string, signed_up date"
    rows = [
        (1, "E", 9, "Ana Lima", "52998224725", "z@x", "3", "Natal", "RN", None),
        (2, "L", 10, "Rui  Sa", "12345678900", "r@x", "1", "Olinda", "PE", None), (3, "L", 11, "RUI SA", "390.533.447-05", "r@x", "1", None, "BA", None), (4, "L", 12, "Rui Sá", "39053344705", "R@x", "1", "Recife", "PE", None),
        (5, "E", 21, "RUI SA", "39053344705", None, None, None, None, None), (6, "E", 22, "Rui Sa", "39053344705", "q@x", "5", "Caruaru", "AL", None),
        (7, "L", 4, "Bia", "11111111111", None, None, None, None, None),
    ]
    gold, bridge, tax_ids = identity.resolve(spark.createDataFrame(rows, fields))
    got = {r.person: r for r in gold.collect()}
    assert {p: r.person_key for p, r in got.items()} == {7: 1, 2: 2, 1: 3}
    r = got[2]
    assert (r.name, r.city, r.region, r.legacy_id, r.shop_id) == ("Rui Sa", "Caruaru", "AL", 12, 21)
    assert {r.node: (r.person_key, r.system_role) for r in bridge.collect()} == {
        1: (3, "SOBREVIVENTE"), 2: (2, "ABSORVIDO"), 3: (2, "ABSORVIDO"), 4: (2, "SOBREVIVENTE"), 5: (2, "SOBREVIVENTE"), 6: (2, "ABSORVIDO"), 7: (1, "SOBREVIVENTE"),
    }
    assert sorted(map(tuple, tax_ids.collect())) == [(2, "12345678900", False), (2, "39053344705", True), (3, "52998224725", True)]
    legacy, _ = identity.persons(spark.createDataFrame(rows[1:4], fields))
    assert [(r.name, r.city, r.region, r.legacy_id, r.person_key) for r in legacy.collect()] == [("Rui Sá", "Recife", "PE", 12, 1)]


def test_target_by_sets(spark):
    rows = [(1, "2025-06-30", "OK"), (1, "2025-09-28", "OK"), (1, "2025-07-01", "OK"), (2, "2025-01-01", "OK"), (2, "2025-07-02", "CANCELADO"), (3, "2025-07-02", "OK"), (4, "2025-02-02", "CANCELADO"), (4, "2025-07-01", "OK"), (5, "2025-02-02", "OK"), (5, "2025-09-29", "OK")]
    orders = spark.createDataFrame(rows, "customer_id long, order_date string, status string").withColumn("order_date", F.col("order_date").cast("date")).withColumn("effective", F.col("status") != "CANCELADO")
    got = sorted(r[0] for r in features.positives_by_sets(orders, "2025-06-30", "2025-09-28", F.col("status") == "CANCELADO").collect())
    assert got == [1, 4] == sorted(r.customer_id for r in features.target(orders, "2025-06-30", "2025-09-28").where("y = 1").collect())


def test_models(spark):
    df = spark.createDataFrame([(i, i % 10, int(i % 10 >= 7 or i == 3)) for i in range(200)], "k long, x int, y int")
    split = models.stratified_split(df, "k", "y")
    n = {r.y: (r.t, r.n) for r in split.groupBy("y").agg(F.count_if("train").alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == -(-7 * m // 10) for t, m in n.values())
    columns = {"x": models.binned("x", models.cuts(df, "x"))}
    scores = models.bayes_scores(df, models.naive_bayes(df, columns, "y"), columns, "k").join(df, "k")
    assert models.auc(scores, "score", "y").first().auc > 0.9
    assert models.confusion(scores, "score", "y").first().recall > 0.6


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), batch.schema)
    query = events.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("w").select("day", "event_type", "n").collect())) == sorted(map(tuple, events.windowed(batch).select("day", "event_type", "n").collect()))
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_generated_sources(spark):
    customers = generator.customers(spark, 400)
    assert sorted(map(tuple, customers.collect()), key=repr) == sorted(map(tuple, generator.customers(spark, 400).repartition(3).collect()), key=repr)
    gold, bridge = identity.persons(customers)
    n = customers.count()
    assert bridge.count() == n and gold.count() < n and gold.where("origin = 'AMBOS'").count() > 5
    raw = generator.orders(spark, 2000, 300)
    lines = conform.items(generator.items(raw), raw)
    orders = conform.orders(raw, lines)
    assert orders.count() == 2000 and conform.unmapped(raw.select("system", "raw_status"), conform.status_table(spark), ["system", "raw_status"]).count() == 0
    assert 5 < orders.where("delivery_too_early").count() < 40 and lines.where("NOT order_exists").count() > 10


def test_library_classifiers(spark):
    df = spark.createDataFrame([(i, float(i % 10), None if i % 7 == 0 else float(i % 3), None, "ab"[i % 2], int(i % 10 >= 6)) for i in range(200)], "k long, x double, z double, e double, c string, y int")
    train, test = models.prepare(df.where("k < 140"), df.where("k >= 140"), ["x", "z", "e"], ["c"])
    for kind in ("logistic", "tree"):
        model = models.classifier(kind, "y", 140).fit(train)
        assert models.auc(models.scored(model, test, "k", "y"), "score", "y").first().auc > 0.95
