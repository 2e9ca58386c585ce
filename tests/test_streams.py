"""Streams with state: events out of order, late, twice; batches run again."""

import random

import pytest
from pyspark.sql import functions as F

from logsluice.functions.keyed import KeyedTable
from logsluice.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "event_id long, source_ip string, event_type string, timestamp timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, old)


def _frame(spark, rows):
    base = F.lit("2026-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame(rows, "event_id long, source_ip string, event_type string, s long")
    return df.select("event_id", "source_ip", "event_type", F.timestamp_micros(F.unix_micros(base) + F.col("s") * 1_000_000).alias("timestamp"))


def _plain(rows, threshold):
    """The rule over all events in order of time."""
    out, fails, done = {}, {}, set()
    for s, i, ip, kind in sorted({(r[3], r[0], r[1], r[2]) for r in rows}):
        if kind == "authentication_failure":
            fails[ip] = fails.get(ip, 0) + 1
        elif fails.get(ip, 0) >= threshold and ip not in done:
            done.add(ip)
            out[ip] = (fails[ip], s)
    return out


def test_state_against_the_rule_over_all_events(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    fail, passed = "authentication_failure", "authentication_success"
    rows = [(i, rng.choice("abcd"), rng.choice([fail, fail, fail, passed]), rng.randrange(i, i + 60)) for i in range(300)]  # out of order by up to a minute
    batches = [rows[a : a + 60] for a in range(0, 300, 60)]
    batches[2] = batches[2] + batches[1][-20:]  # delivered twice
    late = (9000, "a", passed, 1)
    end = [(9001, "z", fail, 100_000)]  # moves the watermark beyond all
    folder = tmp_path / "in"
    sizes = []
    folder.mkdir()
    table = KeyedTable(spark, f"file://{tmp_path}/hits", "source_ip", 4)
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = jobs.into_table(jobs.failures_then_success(events, 4, "90 seconds", 600), table, "stream").option("checkpointLocation", str(tmp_path / "at"))
    for n, batch in enumerate([*batches, [late, (9002, "y", fail, 2000)], end, [(9003, "z", fail, 100_700)], [(9004, "z", fail, 200_000)]]):
        _frame(spark, batch).coalesce(1).write.mode("append").parquet(str(folder))
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
        sizes += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    got = {r["source_ip"]: (r["failures"], r["s"]) for r in table.read().withColumn("s", F.unix_timestamp("timestamp") - F.unix_timestamp(F.lit("2026-01-01").cast("timestamp"))).collect()}
    assert got == _plain(rows, 4) and got
    print("rows of state by batch", sizes)
    assert sizes[-1] < max(sizes) / 5


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", 2)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 5), (2, 6), (1, 4)], "k long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k long, n long").parquet(str(tmp_path / "in"))
    for at in ("one", "two"):  # the second stream lost its checkpoint: it sends batch 0 again
        jobs.into_table(rows, table, "stream", {"n": "sum"}).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start().awaitTermination()
        assert sorted(tuple(r) for r in table.read().collect()) == [(1, 5), (2, 6)]
