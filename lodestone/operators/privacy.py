"""Redacted query log, retention, request limits and admission, freshness of sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import cut, remove


def log_records(answers: DataFrame) -> DataFrame:
    """ts, question (redacted), abstained, cited_chunks, model, prompt_version, mode: no answer and no passage text."""
    return answers.select("ts", X.redact(F.col("question")).alias("question"), "abstained", "cited_chunks", "model", "prompt_version", "mode")


def append_log(answers: DataFrame, path: str, enabled: bool) -> bool:
    """Appends redacted records below path, only if logging was chosen; whether it was."""
    if enabled:
        log_records(answers).write.mode("append").parquet(path)
    return enabled


def purge_counts(log: DataFrame, now: str, days: int, ts: str = "ts") -> DataFrame:
    """kept, dropped in one row: what purge keeps and drops, unreadable times among the dropped."""
    fresh = _fresh(now, days, ts)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return log.agg(n(fresh).alias("kept"), n(~fresh).alias("dropped"))


def _fresh(now: str, days: int, ts: str) -> Column:
    at = F.try_to_timestamp(F.col(ts).cast("string"))
    return F.coalesce(at >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {int(days)} days"), F.lit(False))


def purge(log: DataFrame, now: str, days: int, ts: str = "ts") -> DataFrame:
    """Records not older than days, at the time now; those without a readable time go too. Times without zone are UTC."""
    return log.filter(_fresh(now, days, ts))


#: The partition of records without a readable time.
UNREADABLE = "unreadable"


def append_by_day(records: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends records to a log that is partitioned by the day of their time, one file a day and task."""
    day = F.date_format(F.try_to_timestamp(F.col(ts).cast("string")), "yyyy-MM-dd")
    dealt = records.withColumn("day", F.coalesce(day, F.lit(UNREADABLE)))
    dealt.write.mode("append").partitionBy("day").parquet(path)


def purge_days(spark: SparkSession, path: str, now: str, days: int, ts: str = "ts") -> tuple[int, int]:
    """Purges a log of append_by_day in place; how many records it kept and dropped, as purge_counts.

    Whole days before the limit and unreadable times go as folders, without a record being read (their number is in the
    files' footers); the day in which the limit falls is the only one that is written again.
    """
    path = path.rstrip("/")
    log = spark.read.option("basePath", path).schema(spark.read.parquet(path).schema).parquet(path).withColumn("day", F.col("day").cast("string"))
    edge = str(spark.range(1).select(F.date_format(F.to_timestamp(F.lit(now)) - F.expr(f"interval {int(days)} days"), "yyyy-MM-dd").alias("d")).first().d)
    per = {r.day: r["count"] for r in log.groupBy("day").count().collect()}  # a row a day
    kept, dropped = 0, 0
    for day, n in sorted(per.items()):
        if day == edge:
            stays = cut(purge(log.filter(F.col("day") == edge), now, days, ts).drop("day"))
            left = stays.count()
            if left:  # beside the old files first, so that a purge that breaks off loses none
                if left < n:
                    old = [r.f for r in log.filter(F.col("day") == edge).select(F.input_file_name().alias("f")).distinct().collect()]  # a day's files
                    stays.write.mode("append").parquet(f"{path}/day={day}")
                    for f in old:
                        remove(spark, f)
            else:
                remove(spark, f"{path}/day={day}")
            kept, dropped = kept + left, dropped + n - left
        elif day == UNREADABLE or day < edge:
            remove(spark, f"{path}/day={day}")
            dropped += n
        else:
            kept += n
    return kept, dropped


def allowed(times: list[float], limit: int, window: float, recent: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """For each time, in order, whether fewer than limit allowed ones lie within the window before it."""
    recent, out = list(recent or []), []
    for t in times:
        ok = limit <= 0 or len(recent) < limit or t - recent[-limit] >= window
        out.append(ok)
        if ok and limit > 0:
            recent = [*recent[-limit + 1 :], t] if limit > 1 else [t]
    return out, recent


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: float) -> DataFrame:
    """events with allowed boolean. What a key may do depends on what it was allowed before, so keys are taken in order.

    Spark sorts by key and time, spilling if need be; a task keeps the last ``limit`` allowed times of the key it is at.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    us = int(window_s * 1_000_000)

    same = lambda a, b: a == b or (a != a and b != b)  # noqa: E731  (NaN is one key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = (), []  # no key yet
        for b in batches:
            keys, ok, lo = b.column(key).to_pylist(), [], 0
            times = b.column(ts).cast(pa.int64()).fill_null(-(1 << 63)).to_pylist()
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and same(keys[hi], keys[lo]):
                    hi += 1
                if not same(keys[lo], now):
                    now, recent = keys[lo], []
                some, recent = allowed(times[lo:hi], limit, us, recent)
                ok += some
                lo = hi
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "allowed"])

    dealt = events.repartition(F.col(key)).sortWithinPartitions(key, F.col(ts).asc_nulls_last(), F.col(order).asc_nulls_last())
    return dealt.mapInArrow(run, f"{fields}, allowed boolean")


def rate_limit_by_sessions(events: DataFrame, key: str, ts: str, order: str, limit: int, window_s: int) -> DataFrame:
    """As rate_limit; a key's events are dealt by its sessions, which idle times of a window or more divide.

    After such a time nothing that was allowed before matters.  Events are counted by windows of time: only the first event
    of a window can begin a session, and does unless the window before has one less than a window earlier.  So sessions are
    found on one row for each key and window of time, and no key's events meet in one task unless it is never idle.
    Events without a time come last, as in the plain form: they are allowed while the key has been allowed fewer than limit.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast(events.schema[ts].dataType)  # with or without a time zone
    us, w = F.timestamp_diff("MICROSECOND", epoch, F.col(ts)), F.lit(int(window_s * 1_000_000))
    at = events.withColumn("_w", F.floor(us / w))
    spans = at.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_k"), "_w").agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    by = Window.partitionBy("_k").orderBy("_w")
    begins = F.coalesce((F.lag("_w").over(by) < F.col("_w") - 1) | (F.col("lo") - F.lag("hi").over(by) >= w), F.lit(True))
    spans = spans.withColumn("_b", F.when(begins, F.col("_w")))
    spans = spans.select("_k", "_w", F.last("_b", True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    same = F.col(key).eqNullSafe(F.col("_k"))
    timed = at.filter(F.col(ts).isNotNull()).alias("e").join(spans.alias("s"), same & (F.col("e._w") == F.col("s._w"))).select("e.*", "_s")
    keyed = timed.withColumn("_k", F.struct(F.col(key).alias("k"), "_s")).drop("_w", "_s")
    timed = rate_limit(keyed, "_k", ts, order, limit, window_s).drop("_k")
    if limit <= 0:
        return timed.unionByName(events.filter(F.col(ts).isNull()).withColumn("allowed", F.lit(True)))
    used = timed.filter("allowed").groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last()))
    timeless = events.filter(F.col(ts).isNull()).withColumn("_i", nth).join(used, same, "left")
    timeless = timeless.withColumn("allowed", F.coalesce("_n", F.lit(0)) + F.col("_i") <= limit)
    return timed.unionByName(timeless.drop("_n", "_i", "_k"))


def admission(requests: DataFrame, limit: int, window_s: float, modes: tuple = ("bm25", "vector", "hybrid"), max_chars: int = 1000, max_history: int = 20) -> DataFrame:
    """requests with status: 422 malformed (never counted), 429 over the limit, 422 unknown mode (counted), else 200.

    requests: request_id, key, ts, question, n_history, mode.
    """
    n = F.length("question")
    formed = F.coalesce(n.between(1, max_chars) & (F.col("n_history") <= max_history), F.lit(False))
    bad = requests.filter(~formed).withColumn("status", F.lit(422))
    good = rate_limit(requests.filter(formed), "key", "ts", "request_id", limit, window_s)
    good = good.withColumn("status", F.when(~F.col("allowed"), 429).when(F.col("mode").isin(*modes), 200).otherwise(422)).drop("allowed")
    return bad.unionByName(good)


def age_days(updated: Column, today: str) -> Column:
    """Days since a date string; null if there is none or it is no date."""
    return F.datediff(F.to_date(F.lit(today)), F.nullif(updated, F.lit("")).try_cast("date"))


def stale_sources(manifest: DataFrame, today: str) -> DataFrame:
    """path, owner, age_days, flag: a source without refresh days is never stale, one with and without date always."""
    age = age_days(F.col("updated"), today)
    stale = (F.col("refresh_days") > 0) & (age.isNull() | (age > F.col("refresh_days")))
    return manifest.select("path", F.when(F.col("owner") == "", "-").otherwise(F.col("owner")).alias("owner"), age.alias("age_days"), F.when(stale, "STALE").otherwise("ok").alias("flag"))
