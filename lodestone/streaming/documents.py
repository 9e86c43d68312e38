"""A corpus that documents stream into: a log-structured snapshot by buckets of sources.

Below a path lie generations; a generation has ``heads`` (source, sha256, deleted) and ``chunks`` (with vectors), each written by
batch and bucket, a bucket being a hash of the source.  Of a source's heads the one of the latest batch counts: a tombstone, or a
version whose chunks lie in the same batch.  ``commits`` has a row for each batch that is whole and is written last, so a
batch that broke off never counts, and one that is repeated overwrites its own folders.

A batch reads the heads and chunks of its own buckets, nothing else, and chunks and embeds only what has changed.
``compact`` writes what counts into a new generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieve import search_text
from ..plans.tables import cut

BUCKETS = 64


def bucket(source: str = "source", n: int = BUCKETS):
    return F.pmod(F.xxhash64(source), F.lit(n)).cast("int")


def last_commit(spark: SparkSession, path: str, before: int | None = None) -> Row | None:
    """batch, generation, buckets of the newest whole batch (before another); None if there is none."""
    try:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/commits")
    except AnalysisException:  # nothing is committed yet
        return None
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.orderBy(F.desc("batch"), F.desc("generation")).first()  # a row a batch


def _stored(spark: SparkSession, path: str, at: Row, table: str, only: list[int] | None = None) -> DataFrame:
    """The table's rows of whole batches, of some buckets if only is given: others are left out by their folders' names."""
    root = f"{path}/generation={at.generation}/{table}"
    rows = spark.read.option("basePath", root).parquet(root).filter(F.col("batch") <= at.batch)
    return rows if only is None else rows.filter(F.col("bucket").isin(only))


def _latest(heads: DataFrame) -> DataFrame:
    newest = Window.partitionBy("source").orderBy(F.desc("batch"))
    return heads.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def current(spark: SparkSession, path: str, only: list[int] | None = None, at: Row | None = None) -> DataFrame:
    """The chunks that count, of some buckets if only is given."""
    at = at or last_commit(spark, path)
    if at is None:
        raise FileNotFoundError(f"{path} has no whole batch")
    alive = _latest(_stored(spark, path, at, "heads", only)).filter("not deleted").select("bucket", "source", "batch")
    return _stored(spark, path, at, "chunks", only).join(alive, ["bucket", "source", "batch"], "left_semi").drop("batch", "bucket")


def _commit(spark: SparkSession, path: str, batch: int, generation: int, buckets: int) -> None:
    spark.createDataFrame([(batch, generation, buckets)], "batch long, generation int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch:010d}-{generation:06d}")


def arrived(rows: DataFrame, order: str) -> DataFrame:
    """source, text of a batch (source, text, order): the version that came last; of equal orders the greatest text. A null text deletes."""
    first = Window.partitionBy("source").orderBy(F.col(order).desc_nulls_last(), F.col("text").desc_nulls_last())
    return rows.filter("source is not null").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("source", "text")


def apply(spark: SparkSession, path: str, rows: DataFrame, batch: int, chunk: Callable, embed: Callable, order: str = "seq", buckets: int = BUCKETS) -> dict:
    """Brings the snapshot up to a batch of arrivals (source, text, order).

    chunk(files) gives chunk_id, source, title, heading, text, ... of files (source, text); embed(chunks) gives chunk_id, vec.
    The report: changed, deleted and unchanged sources, chunks added, reused and embedded, and the stored heads that were read.
    """
    path = path.rstrip("/")
    at = last_commit(spark, path, batch)
    generation, buckets = (at.generation, at.buckets) if at else (0, buckets)
    new = cut(arrived(rows, order).withColumns({"bucket": bucket("source", buckets), "sha256": F.sha2(F.col("text").cast("binary"), 256)}))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
    none = "source string, sha256 string, deleted boolean, batch long, bucket int"
    heads = cut(_stored(spark, path, at, "heads", touched).select("source", "sha256", "deleted", "batch", "bucket")) if at else spark.createDataFrame([], none)
    old = _latest(heads).select("source", F.col("sha256").alias("had"), F.col("deleted").alias("gone"))
    both = cut(new.join(old, "source", "left"))
    there = F.col("had").isNotNull() & ~F.coalesce("gone", F.lit(False))
    changed = both.filter(F.col("text").isNotNull() & ~(there & (F.col("had") == F.col("sha256"))))
    deleted = both.filter(F.col("text").isNull() & there)
    fresh = cut(chunk(changed.select("source", "text")))
    # chunks that the source had before keep their vectors
    state = F.sha2(search_text(), 256)
    before = current(spark, path, touched, at).select("chunk_id", "vec", state.alias("_h")).distinct() if at else None
    if before is None:
        reused, rest = None, fresh
    else:
        hashed = fresh.withColumn("_h", state)
        reused = cut(hashed.join(before, ["chunk_id", "_h"]).select("chunk_id", "vec").dropDuplicates(["chunk_id"]))
        rest = fresh.join(reused.select("chunk_id"), "chunk_id", "left_anti")
    vecs = embed(rest).select("chunk_id", "vec")
    vecs = cut(vecs if reused is None else reused.unionByName(vecs))
    root = f"{path}/generation={generation}"
    entries = changed.select("source", "sha256", F.lit(False).alias("deleted"), "bucket").unionByName(deleted.select("source", F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("deleted"), "bucket"))
    entries.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/heads/batch={batch}")
    whole = fresh.join(vecs, "chunk_id").withColumn("bucket", bucket("source", buckets))
    whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/chunks/batch={batch}")
    n = both.agg(F.count("*").alias("n")).first().n
    n_changed, n_deleted, n_chunks, n_reused = changed.count(), deleted.count(), fresh.count(), 0 if reused is None else reused.count()
    _commit(spark, path, batch, generation, buckets)
    return {"changed": n_changed, "deleted": n_deleted, "unchanged": n - n_changed - n_deleted, "added": n_chunks, "reused": n_reused, "embedded": n_chunks - n_reused, "heads_read": heads.count(), "buckets": len(touched)}


def compact(spark: SparkSession, path: str) -> int:
    """Writes what counts as one batch of a new generation; older generations stay for those who read them. Its number."""
    path = path.rstrip("/")
    at = last_commit(spark, path)
    root = f"{path}/generation={at.generation + 1}"
    alive = _latest(_stored(spark, path, at, "heads")).filter("not deleted")
    alive.select("source", "sha256", "deleted", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/heads/batch={at.batch}")
    live = current(spark, path, at=at).withColumn("bucket", bucket("source", at.buckets))
    live.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/chunks/batch={at.batch}")
    _commit(spark, path, at.batch, at.generation + 1, at.buckets)
    return at.generation + 1


def stream(arrivals: DataFrame, path: str, chunk: Callable, embed: Callable, checkpoint: str, order: str = "seq", buckets: int = BUCKETS, told: list | None = None):
    """A query that applies every micro-batch of arrivals; told gets each batch's report."""

    def each(rows: DataFrame, batch: int) -> None:
        report = apply(rows.sparkSession, path, rows, batch, chunk, embed, order, buckets)
        if told is not None:
            told.append(report)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
