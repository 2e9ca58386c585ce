"""Streams over the same operators: an extension, with watermarks so that state stays bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.keyed import KeyedTable
from ..operators import normalize as N
from ..operators import parsers as P
from ..operators import shield


def read_raw(spark: SparkSession, path: str, schema: str = "job_id string, source_name string, line_number long, content string, received_at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def normalised(raw: DataFrame, reference: str) -> DataFrame:
    """The stateless stages: screened, parsed and normalised lines that are not quarantined."""
    df = shield.screen(raw).where("NOT quarantine")
    df = P.parse(P.detect(df))
    return N.normalize(N.extracted(N.cleaned(df, reference)), reference)


def without_duplicates(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each line of a job once within the watermark."""
    return raw.withColumn("content_hash", F.sha2("content", 256)).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["job_id", "content_hash"])


def per_minute(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 minute"), "event_type").agg(F.count("*").alias("n"))


def sliding_failures(events: DataFrame, seconds: int = 120, slide: int = 30, threshold: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Failed logins by address in sliding windows: the batch rule but for the slide."""
    rows = events.withWatermark("timestamp", delay).where("event_type = 'authentication_failure' AND source_ip IS NOT NULL")
    return rows.groupBy(F.window("timestamp", f"{seconds} seconds", f"{slide} seconds"), "source_ip").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def sessions(events: DataFrame, gap: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap), "source_ip").agg(F.count("*").alias("n"))


STATE = "fails long, done boolean"


def failed_then_passed(events: DataFrame, threshold: int = 4, delay: str = "10 minutes", forget: int = 86_400) -> DataFrame:
    """An address whose failures reach the threshold before a success. The state is a counter per address, and goes when the address
    was silent for `forget` seconds of event time. Events of a batch are taken in the order of time; events later than the watermark are dropped."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        fails, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["timestamp", "event_id"])
        failed = fails + (rows["event_type"] == "authentication_failure").to_numpy().cumsum()
        hits = np.flatnonzero((rows["event_type"] == "authentication_success").to_numpy() & (failed >= threshold))
        if len(hits) and not done:
            done = True
            yield pd.DataFrame({"source_ip": [key[0]], "failures": [int(failed[hits[0]])], "timestamp": [rows["timestamp"].iloc[hits[0]]]})
        state.update((int(failed[-1]), done))
        last = int(rows["timestamp"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + forget * 1000)

    rows = events.where("source_ip IS NOT NULL AND event_type IN ('authentication_failure', 'authentication_success')").select("source_ip", "event_id", "event_type", "timestamp").withWatermark("timestamp", delay)
    return rows.groupBy("source_ip").applyInPandasWithState(step, "source_ip string, failures long, timestamp timestamp", STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _FailuresThenSuccess(StatefulProcessor):
    """Per address: events that wait for the watermark, and the number of failures so far. Events are taken in the order of time once the watermark has passed
    them, so that those of later batches which are earlier in time still count; one that comes twice counts once. An address that is silent for `forget`
    seconds of event time is forgotten."""

    def __init__(self, threshold: int, forget: int):
        self.threshold, self.forget = threshold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id long", "micros long, failed boolean")
        self.seen = handle.getValueState("seen", "fails long, done boolean, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            at = r["micros"]
            if at // 1000 > mark:  # others are late
                self.waiting.updateValue((r["event_id"],), (at, r["event_type"] == "authentication_failure"))
                self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        due = sorted((v[0], k[0], v[1]) for k, v in self.waiting.iterator() if v[0] // 1000 < mark)
        fails, done, last = self.seen.get() if self.seen.exists() else (0, False, 0)
        out = []
        for at, event, failed in due:
            self.waiting.removeKey((event,))
            last = max(last, at // 1000)
            if failed:
                fails += 1
            elif fails >= self.threshold and not done:
                done = True
                out.append(Row(source_ip=key[0], failures=fails, micros=at))
        if due:
            self.seen.update((fails, done, last))
            self.handle.registerTimer(last + self.forget * 1000)
        elif last + self.forget * 1000 <= mark and not any(True for _ in self.waiting.keys()):
            self.seen.clear()
        return iter(out)

    def close(self) -> None:
        pass


def failures_then_success(events: DataFrame, threshold: int = 4, delay: str = "10 minutes", forget: int = 86_400) -> DataFrame:
    """failed_then_passed with rows of all batches in one order of time: a processor with state and timers per address. Needs the RocksDB state store."""
    rows = events.where("source_ip IS NOT NULL AND event_type IN ('authentication_failure', 'authentication_success')").withWatermark("timestamp", delay)
    rows = rows.select("source_ip", "event_id", "event_type", "timestamp", F.unix_micros("timestamp").alias("micros"))
    found = rows.groupBy("source_ip").transformWithState(
        statefulProcessor=_FailuresThenSuccess(threshold, forget), outputStructType="source_ip string, failures long, micros long", outputMode="append", timeMode="eventTime")
    return found.select("source_ip", "failures", F.timestamp_micros("micros").alias("timestamp"))


def into_table(rows: DataFrame, table: KeyedTable, writer: str, changes: dict[str, str] | None = None) -> DataStreamWriter:
    """A writer whose batches go into a keyed table by their number, so that a batch that is run again after a loss adds nothing. Rows of a
    batch with one key are folded to the one with the largest values."""
    columns = [c for c in rows.columns if c not in table.key]

    def one(batch: DataFrame, number: int) -> None:
        each = batch.groupBy(*table.key).agg(F.max(F.struct(*columns)).alias("row")).select(*table.key, "row.*") if columns else batch.distinct()
        table.upsert(each, writer, number, changes)

    return rows.writeStream.foreachBatch(one)
