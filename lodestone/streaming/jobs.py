"""Streams: a rate limiter with keyed state, the redacted log, and document sync by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as X
from ..operators.index import sync
from ..operators.privacy import allowed


def rate_limit_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: int, late: str = "10 minutes") -> DataFrame:
    """key, event_id, ts, allowed of each event, state being the last limit allowed times of a key.

    Events later than the watermark are dropped and never counted; idle keys leave the state after a window.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values([ts, event_id], kind="stable")
        us = pdf[ts].astype("datetime64[us]").astype("int64").tolist()
        ok, recent = allowed(us, limit, window_s * 1_000_000, recent)
        state.update((recent,))
        expires = max(us[-1] // 1000 + window_s * 1000 + 1, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(expires)
        yield pd.DataFrame({"key": pdf[key].tolist(), "event_id": pdf[event_id].tolist(), "ts": pdf[ts].tolist(), "allowed": ok})

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, event_id)}
    schema = f"key {kinds[key]}, event_id {kinds[event_id]}, ts timestamp, allowed boolean"
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, schema, "recent array<bigint>", "append", "EventTimeTimeout")


class Limiter(StatefulProcessor):
    """State of a key: the last allowed times (a list), and a timer that clears them once they can't matter."""

    def __init__(self, ts: str, event_id: str, limit: int, window_s: int):
        self.ts, self.event_id, self.limit, self.window_s = ts, event_id, limit, window_s

    def init(self, handle) -> None:
        self.handle, self.recent = handle, handle.getListState("recent", "t bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.event_id], kind="stable")
        us = pdf[self.ts].astype("datetime64[us]").astype("int64").tolist()
        before = [t for (t,) in self.recent.get()] if self.recent.exists() else []
        ok, recent = allowed(us, self.limit, self.window_s * 1_000_000, before)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recent:
            self.recent.put([(t,) for t in recent])
            self.handle.registerTimer(recent[-1] // 1000 + self.window_s * 1000 + 1)
        yield pd.DataFrame({"key": key[0], "event_id": pdf[self.event_id].tolist(), "ts": pdf[self.ts].tolist(), "allowed": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: int, late: str = "10 minutes") -> DataFrame:
    """key, event_id, ts, allowed: the limiter with list state and timers of event time, on the RocksDB state store.

    Events later than the watermark are dropped; the query's progress counts them (numRowsDroppedByWatermark).
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, event_id)}
    schema = f"key {kinds[key]}, event_id {kinds[event_id]}, ts timestamp, allowed boolean"
    return events.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(Limiter(ts, event_id, limit, window_s), schema, "Append", "eventTime")


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def limit_stream(spark: SparkSession, events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: int, out: str, checkpoint: str, late: str = "10 minutes"):
    """A query that appends limited events to a Parquet folder and ends when there are no more; the session's state store is set for its start only."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        stream = limited(events, key, ts, event_id, limit, window_s, late).writeStream.format("parquet").option("path", out)
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


def redacted_log_stream(questions: DataFrame) -> DataFrame:
    """Stateless: questions with personal data replaced, ready for an append sink."""
    return questions.withColumn("question", X.redact(F.col("question")))


def sync_stream(arrivals: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls apply(rows, batch id) for each micro-batch; chunk ids are content hashes, so a repeated batch changes nothing."""
    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_arrivals(spark: SparkSession, path: str, chunk, embed, embedder: str, settings: str) -> Callable[[DataFrame, int], None]:
    """An apply for sync_stream: arrived documents (source, text) replace those of their names in the index below path.

    Of several versions of a source in one batch that of the greatest seq counts, if arrivals have such a column.  Each batch
    is a sync of all sources; ``documents`` has the form that reads only what a batch touches.

    The texts in the index are kept beside it (one row a source, the latest batch's), so that each batch is a sync against
    the stored snapshot: only changed sources are chunked and only added chunks embedded.
    """

    def apply(rows: DataFrame, batch_id: int) -> None:
        texts = f"{path.rstrip('/')}/texts"
        version = F.max_by("text", "seq") if "seq" in rows.columns else F.max("text")
        rows.groupBy("source").agg(version.alias("text")).write.mode("overwrite").parquet(f"{texts}/batch={batch_id}")  # a repeated batch overwrites itself
        every = spark.read.option("basePath", texts).parquet(texts)
        latest = every.groupBy("source").agg(F.max_by("text", "batch").alias("text"))
        sync(spark, path, latest, chunk, embed, embedder, settings, f"batch {batch_id}")

    return apply
