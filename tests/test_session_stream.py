"""The stream of sessions against its batch: out of order, with late rows, stopped and started again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import temporal
from ledgerloom.streaming import sessions

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000
SCHEMA = "event_id long, ts timestamp, user_id long, value double"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


@pytest.fixture
def store(spark):
    for k, v in sessions.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in sessions.STORE:
        spark.conf.unset(k)


def plain_sessions(rows, gap):
    out, by = [], {}
    for _, t, u, v in rows:
        if u is not None and t is not None:
            by.setdefault(u, []).append((t, v or 0.0))
    for u, moments in by.items():
        moments.sort()
        run = [moments[0]]
        for m in [*moments[1:], None]:
            if m is None or m[0] - run[-1][0] > gap:
                out.append((u, run[0][0], run[-1][0], len(run), round(sum(v for _, v in run), 6)))
                run = []
            run.append(m)
    return sorted(out)


def made(rng, n):
    return [(k, T0 + datetime.timedelta(minutes=rng.randrange(60 * 24 * 5)), rng.choice([1, 1, 2, 3, rng.randrange(30), None]), float(rng.randrange(9))) for k in range(n)]


def test_sessions_of_a_table(spark):
    rows = [*made(random.Random(5), 800), (900, None, 1, 1.0), *made(random.Random(5), 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit("clash"))
    got = sorted((r.user_id, r.start.replace(tzinfo=datetime.UTC), r.end.replace(tzinfo=datetime.UTC), r.n, round(r.total, 6)) for r in temporal.sessions(df, ["user_id"], "ts", HOUR, "value").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}).collect())
    assert got == plain_sessions(rows, datetime.timedelta(hours=1))
    assert temporal.sessions(df.limit(0), ["user_id"], "ts", HOUR, "value").count() == 0


def fed(spark, tmp_path, batches, name):
    """Runs the stream over files written one after the other, as a new query after each: state comes from the checkpoint."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = sessions.session_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), HOUR, "10 hours")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), k
    return spark.read.parquet(str(tmp_path / "out")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}).collect()


def test_a_stream_equals_its_batch_across_restarts(spark, store, tmp_path):
    """Files out of order within the lateness; a last event far ahead closes all sessions before it."""
    rng = random.Random(6)
    rows = sorted(made(rng, 400), key=lambda r: r[1] + datetime.timedelta(minutes=rng.randrange(280)))
    batches = [rows[k : k + 100] for k in range(0, 400, 100)]
    got = fed(spark, tmp_path, [*batches, [(999, T0 + datetime.timedelta(days=30), 77, 0.0)]], "a")
    assert not [r for r in got if r.kind == "late"]
    mine = sorted((r.user_id, r.start.replace(tzinfo=datetime.UTC), r.end.replace(tzinfo=datetime.UTC), r.n, round(r.total, 6)) for r in got)
    assert mine == plain_sessions(rows, datetime.timedelta(hours=1))


def test_late_rows_go_out_apart(spark, store, tmp_path):
    at = lambda h: T0 + datetime.timedelta(hours=h)
    first = [(1, at(100), 1, 1.0), (2, at(99.5), 1, 2.0), (3, at(95), 2, 4.0), (8, None, 2, 4.0)]
    second = [(4, at(10), 1, 5.0), (5, at(10), 3, None), (6, at(91), 2, 7.0), (7, at(300), 9, 0.0)]
    got = fed(spark, tmp_path, [first, second], "b")
    assert sorted((r.event_id, r.user_id, r.total) for r in got if r.kind == "late") == [(4, 1, 5.0), (5, 3, None)]
    closed = sorted((r.user_id, r.n, r.total) for r in got if r.kind == "session")
    assert closed == [(1, 2, 3.0), (2, 1, 4.0), (2, 1, 7.0)]


def test_merged_spans():
    assert sessions.merged([(5, 6, 1, 1.0), (1, 2, 1, 1.0), (3, 3, 2, 0.5), (9, 9, 1, 0.0)], 1) == [(1, 3, 3, 1.5), (5, 6, 1, 1.0), (9, 9, 1, 0.0)]
