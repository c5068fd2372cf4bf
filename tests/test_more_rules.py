"""Sources, sinks, reports and model tools that no query runs."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import storage
from ledgerloom.functions import dates, numbers, text
from ledgerloom.operators import models, profile
from ledgerloom.plans import conform, diagnostics, features
from ledgerloom.sources import csv_ranges, generator, readers, sinks
from ledgerloom.streaming import events

from .test_rules import values


def test_folding(spark):
    assert values(spark, text.fold_name, ["\tJosé  da\nSílva ", "Šimon Ångström", "Việt"]) == ["JOSE DA SILVA", "SIMON ANGSTROM", "VIET"]
    assert values(spark, text.ascii_label, ["ﬁm de Ano", "ＡＢＣ 中", "½ kg", "Joãó"]) == ["fim de ano", "abc", "12 kg", "joao"]
    assert values(spark, lambda x: text.reference(x)[1], ["LEG-12", "ECOM-7", "FOO-12", "LEG-"]) == [12, 7, None, None]
    assert values(spark, text.shape_mask, ["Aé-12"]) == ["Aé-99"]
    assert values(spark, text.phone_digits, ["+55 81 99999-0000", "81 99999-0000", "5599"]) == ["81999990000", "81999990000", "5599"]
    assert values(spark, text.has_line_break, ["a\nb", "ab"]) == [True, False]


def test_small_functions(spark):
    row = spark.range(1).select(
        numbers.percent(F.lit(1), F.lit(3)).alias("a"), numbers.percent(F.lit(1), F.lit(0)).alias("b"), numbers.close(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("c"), numbers.close(F.lit(1.0), F.lit(1.1)).alias("d"),
        dates.hours_fit_days(F.lit(30), F.lit(1)).alias("e"), dates.hours_fit_days(F.lit(50), F.lit(1)).alias("f"), dates.near_midnight(F.lit("1970-01-01 21:00:00").cast("timestamp")).alias("g"),
    ).first()
    assert (float(row.a), float(row.b), row.c, row.d, row.e, row.f, row.g) == (33.33, 0.0, True, False, True, False, True)
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z"), ("b", "q")], "g string, v string")
    assert sorted((r.g, r.v) for r in features.main_by(df, "g", "v").collect()) == [("a", "y"), ("b", "q")]


def test_sources_and_sinks(spark, tmp_path):
    path = sinks.refresh(spark.createDataFrame([(1, "a,b"), (2, 'say "x"')], "id long, v string"), str(tmp_path), "stage", "t")
    back = readers.parquet_table(spark, path, "id", "legacy")
    assert sorted((r._line, r._source) for r in back.collect()) == [(1, "legacy"), (2, "legacy")]
    sinks.annotated_csv(spark.createDataFrame([(1, "a,b", 1), (2, 'say "x"', 0)], "id long, v string, y int"), str(tmp_path / "o"), "y", ["id"], "id")
    assert sorted(tuple(r) for r in readers.sample(csv_ranges.annotated_csv(spark, str(tmp_path / "o"), ["id", "v", "y"]), 9).collect()) == [("1", "a,b", "1"), ("2", 'say "x"', "0")]
    # values that look like kinds and roles, empty ones and line breaks are rows like others
    odd = ["class", "", None, "meta", "string", "x\ny", "discrete"]
    sinks.annotated_csv(spark.createDataFrame([(v, k) for k, v in enumerate(odd)], "v string, k int"), str(tmp_path / "odd"), "k", [], "k")
    assert sorted((r.k, r.v or "") for r in csv_ranges.annotated_csv(spark, str(tmp_path / "odd"), ["v", "k"]).collect()) == [(str(k), v or "") for k, v in enumerate(odd)]
    (tmp_path / "broken.ndjson").write_text('{"review_id":"1"}\n{"review_id":\n\n[]\nnull\n')
    assert [(r.value, r._line) for r in readers.broken_lines(spark, str(tmp_path / "broken.ndjson")).collect()] == [('{"review_id":', 2)]
    assert sorted(r._line for r in readers.ndjson(spark, str(tmp_path / "broken.ndjson")).collect()) == [1, 4, 5]
    sinks.report_csv(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "r"))
    assert [r.n for r in readers.seed_csv(spark, str(tmp_path / "r"), T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())])).collect()] == [1]
    back.createOrReplaceTempView("staged_rows")
    assert [r.column for r in readers.find_columns(spark, "_extracted").collect()] == ["_extracted_at"]
    assert {r["column"]: r.n for r in readers.garbled_rows(spark.createDataFrame([("SÃ£o", "x")], "a string, b string")).collect()} == {"a": 1, "b": 0}
    got = profile.file_digests(spark, str(tmp_path / "r")).where(F.col("file").endswith(".csv")).first()
    file = next((tmp_path / "r").glob("*.csv"))
    assert (got.sha256, got.n_bytes) == (hashlib.sha256(file.read_bytes()).hexdigest(), file.stat().st_size)
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        readers.jdbc(spark, "jdbc:none://x", "t", "id", 0, 10)


def test_line_numbers_of_many_splits(spark, tmp_path):
    lines = [f'{{"review_id":"r{i}"}}' if i % 3 else "" for i in range(3000)]
    (tmp_path / "a.ndjson").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.ndjson").write_text('{"review_id":"other"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.review_id: r._line for r in readers.ndjson(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"r{i}": i + 1 for i in range(3000) if i % 3} | {"other": 1}


def test_registry_and_runs(spark):
    rows = spark.createDataFrame([("a", 1.5)], "k string, v double")
    assert diagnostics.as_metrics(rows, "rdt.", "k", "v").first().key == "rdt.a"
    runs = [spark.createDataFrame(x, "key string, n_rows long, hash_sum long") for x in ([("a", 1, 5), ("b", 1, 6), ("c", 1, 7)], [("a", 1, 5), ("b", 1, 9), ("d", 1, 7)])]
    assert {r.key: r.state for r in profile.compare(*runs, "key").collect()} == {"a": "equal", "b": "differs", "c": "gone", "d": "added"}
    assert features.dictionary(spark).count() == 14
    base = spark.range(3).select(F.col("id").alias("customer_id"), *(F.lit(None if o else 1).cast(k).alias(c) for c, (k, _, o) in features.REGISTRY.items()), F.lit(1).alias("y"))
    assert features.contract(base).columns == ["customer_id", *features.FEATURES, "y"] and all(r.allowed for r in features.null_census(base).collect())


def test_versions_and_sensitivity(spark):
    metrics = spark.createDataFrame([("right", "tree", 0.5), ("leaky", "tree", 0.9)], "version string, model string, auc double")
    assert abs(models.version_differences(metrics, "version", "right", ["auc"], ["model"]).first().auc - 0.4) < 1e-9
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 >= 6)) for i in range(120)], "k long, x double, y int")
    train, test = models.prepare(df.where("k < 80"), df.where("k >= 80"), ["x"], [])
    got = models.sensitivity(train, test, "k", "y", [{"kind": "tree", "leaf": 2}, {"kind": "logistic", "steps": 20}]).collect()
    assert [r.settings for r in got] == ["kind=tree, leaf=2", "kind=logistic, steps=20"] and all(r.auc > 0.9 for r in got)


def test_more_generated_sources(spark, tmp_path):
    products, tickets, reviews = generator.products(spark, 3000), generator.tickets(spark, 3000, 200), generator.reviews(spark, 2000, 300)
    assert {r.table: r.n for r in generator.summary({"products": products, "reviews": reviews}).collect()} == {"products": 3000, "reviews": 2000}
    assert products.where("list_price > 1000").count() < 30 and 3000 < tickets.count() < 3100
    owners = tickets.select(text.digits(F.col("tax_id")).alias("tax_id"), F.lit(1).alias("customer_key")).distinct()
    out = conform.tickets(tickets.withColumn("line", F.monotonically_increasing_id()), owners)
    assert out.count() == 3000 and out.where("reason IS NULL").count() == 0 and 10 < out.where("reiterated").count() < 120
    reviews.coalesce(1).write.text(str(tmp_path / "r"))
    rows = readers.ndjson(spark, str(tmp_path / "r"))
    assert rows.where(F.array_contains("text_paths", "rating")).count() > 100 and rows.where(F.array_contains("absent_paths", "order_ref")).count() > 100
    assert generator.customers(spark, 500).groupBy("name", "tax_id", "email").count().where("count > 1").count() > 0


def test_first_of_a_stream(spark, tmp_path):
    batch = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (2, 5, 2.0)], "event_id long, user_id long, value double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.first_seen(events.read_events(spark, str(tmp_path / "in"), batch.schema))
    query = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_scratch_folder_must_be_shared():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.scratch_root(Session())
