"""The incremental index: fingerprints, the diff of chunks, reuse of vectors, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import cut
from . import inverted
from .retrieve import search_text


def file_hashes(files: DataFrame, content: str = "text") -> DataFrame:
    return files.select("source", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def _line() -> Column:
    return F.concat("source", F.lit("="), "sha256", F.lit(";")).alias("line")


def _digests(lines: DataFrame) -> DataFrame:
    """bucket, d: SHA-256 over the column line of each bucket, in the order that lines' partitions have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], names=["bucket", "d"])
        now, h = None, None
        for batch in batches:
            for bucket, line in zip(batch.column("bucket").to_pylist(), batch.column("line").to_pylist()):
                if bucket != now:
                    if h is not None:
                        yield out()
                    now, h = bucket, sha256()
                h.update((line or "").encode())
        if h is not None:
            yield out()

    return lines.select("bucket", "line").mapInArrow(run, "bucket long, d string")


def _whole(lines: DataFrame, settings: str, *order: str) -> DataFrame:
    """fingerprint: one digest over the settings and then lines in order, in one task that holds a batch at a time."""
    first = lines.sparkSession.range(1).select(F.lit(0).alias("no"), *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(settings).alias("line"))
    every = lines.select(F.lit(1).alias("no"), *order, "line").unionByName(first).withColumn("bucket", F.lit(0).cast("long"))
    return _digests(every.repartition(1).sortWithinPartitions("no", *order)).select(F.col("d").alias("fingerprint"))


def fingerprint(hashes: DataFrame, settings: str) -> DataFrame:
    """One row: SHA-256 over the settings and "name=hash;" of each file in name order.

    One hash over all files is the work of one task; Spark sorts (and spills), so its memory doesn't grow with them.
    """
    return _whole(hashes.select("source", "sha256", _line()), settings, "source", "sha256")


def bucketed_fingerprint(hashes: DataFrame, settings: str, per_bucket: int = 4096) -> DataFrame:
    """The same purpose for very many files: a digest for each bucket of names, then one over those in order.

    There are as many buckets as files / per_bucket, so neither a bucket nor the last digest's input holds all files.
    The bucket is the first 13 hex digits of the name's MD5, modulo the number of buckets.
    """
    n = F.broadcast(hashes.agg(F.greatest(F.ceil(F.count("*") / per_bucket), F.lit(1)).alias("buckets")))  # one row
    place = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 13), 16, 10).cast("long")
    b = hashes.join(n).select("source", "sha256", _line(), F.pmod(place, F.col("buckets")).alias("bucket"))
    per = _digests(b.repartition(F.col("bucket")).sortWithinPartitions("bucket", "source", "sha256"))
    return _whole(per.select("bucket", F.col("d").alias("line")).withColumnRenamed("bucket", "nth"), settings, "nth")


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """New or changed files: only these need chunking again."""
    return new.join(old, ["source", "sha256"], "left_anti")


def _state(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.sha2(search_text(), 256).alias("h"))


def diff(old: DataFrame, new: DataFrame, reusable: bool = True) -> DataFrame:
    """chunk_id, status: added (new, or its search text changed), kept, removed; only hashes are shuffled.

    reusable: false if the embedder changed or a rebuild is forced; then all is added and nothing counts as removed.
    """
    o, n = _state(old), _state(new).withColumnRenamed("h", "nh")
    if not reusable:
        return n.select("chunk_id", F.lit("added").alias("status"))
    both = o.join(n, "chunk_id", "full_outer")
    status = F.when(F.col("nh").isNull(), "removed").when(F.col("h").isNull() | (F.col("h") != F.col("nh")), "added").otherwise("kept")
    return both.select("chunk_id", status.alias("status"))


def report(changes: DataFrame) -> DataFrame:
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("long").alias(s)
    return changes.agg(n("added"), n("removed"), n("kept"))


def reuse_vectors(chunks: DataFrame, changes: DataFrame, old_vectors: DataFrame, embed) -> DataFrame:
    """chunk_id, vec: old vectors of kept chunks, and embed(chunks) of the added ones only."""
    kept = old_vectors.join(changes.filter("status = 'kept'"), "chunk_id", "left_semi").select("chunk_id", "vec")
    return kept.unionByName(embed(chunks.join(changes.filter("status = 'added'"), "chunk_id", "left_semi")).select("chunk_id", "vec"))


def save(path: str, chunks: DataFrame, vectors: DataFrame, embedder: str, settings: Column | str, indexed_at: str, files: DataFrame | None = None) -> str:
    """A snapshot in a folder of its own below path; its manifest is written last, so a broken-off one never counts.
    Snapshots are numbered on from the newest; of two that were begun at once, all readers take the same one.

    files (source, sha256) are kept for the next sync.  The name of the snapshot is returned; older ones stay readable.
    """
    spark = chunks.sparkSession
    last = newest(spark, path)
    number = 1 + int(last.snapshot.split("-")[1]) if last is not None else 0  # no clock: drivers' clocks differ
    name = f"snapshot-{number:020d}-{uuid.uuid4().hex[:8]}"
    at = f"{path.rstrip('/')}/{name}"
    chunks.write.parquet(f"{at}/chunks")
    stored = spark.read.parquet(f"{at}/chunks")
    stats = inverted.write(at, stored)
    vectors.write.parquet(f"{at}/vectors")
    files = file_hashes(chunks.select("source", F.lit("").alias("text"))).limit(0) if files is None else files
    files.write.parquet(f"{at}/files")
    settings = F.lit(settings) if isinstance(settings, str) else settings
    manifest = stats.select("n", "avgdl", F.lit(embedder).alias("embedder"), settings.alias("settings"), F.lit(indexed_at).alias("indexed_at"), F.lit(name).alias("snapshot"))
    manifest.coalesce(1).write.parquet(f"{path.rstrip('/')}/manifests/{name}")
    return name


def newest(spark: SparkSession, path: str) -> Row | None:
    """The manifest of the newest complete snapshot; None if there is none yet."""
    try:
        every = spark.read.option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/manifests")
    except AnalysisException:  # no snapshot yet
        return None
    return every.orderBy(F.desc("snapshot")).first()  # a row a snapshot


def load(spark: SparkSession, path: str, embedder: str | None = None) -> dict[str, DataFrame]:
    """Tables of the newest complete snapshot; another embedder than the asked one is an error."""
    last = newest(spark, path)
    if last is None:
        raise FileNotFoundError(f"{path} has no complete snapshot")
    if embedder is not None and last.embedder != embedder:
        raise ValueError(f"the index was embedded with {last.embedder!r}, the question with {embedder!r}")
    at = f"{path.rstrip('/')}/{last.snapshot}"
    return {"manifest": spark.createDataFrame([last])} | {t: spark.read.parquet(f"{at}/{t}") for t in ("chunks", "places", "postings", "terms", "vectors", "files")}


def sync(spark: SparkSession, path: str, files: DataFrame, chunk, embed, embedder: str, settings: str, indexed_at: str, force: bool = False) -> dict:
    """Brings the index below path up to date with files (source, text): hashes, changed sources, chunks, diff, vectors, snapshot.

    chunk(files) gives chunk_id, okey, source, title, heading, text, ... of some files; embed(chunks) gives chunk_id, vec.
    Nothing is read further if the hashes and settings are those of the last snapshot (loaded_from_cache).  Otherwise only
    new and changed sources are chunked, and only added chunks embedded, unless embedder or settings changed or force is set.
    The report: added, removed, kept, loaded_from_cache, snapshot.
    """
    hashes = cut(file_hashes(files))
    last = newest(spark, path)
    old = load(spark, path) if last is not None else None
    same = last is not None and last.embedder == embedder and last.settings == settings and not force
    if same:
        moved = hashes.join(old["files"], ["source", "sha256"], "left_anti").limit(1).count() + old["files"].join(hashes, ["source", "sha256"], "left_anti").limit(1).count()
        if not moved:
            return {"added": 0, "removed": 0, "kept": last.n, "loaded_from_cache": True, "snapshot": last.snapshot}
    if same:
        fresh = changed_sources(old["files"], hashes).select("source")
        still = old["files"].join(hashes, ["source", "sha256"], "left_semi").select("source")
        new = cut(old["chunks"].join(still, "source", "left_semi").unionByName(chunk(files.join(fresh, "source", "left_semi")), allowMissingColumns=True))
    else:
        new = cut(chunk(files))
    changes = cut(diff(old["chunks"], new) if same else diff(new.limit(0), new, False))
    vectors = reuse_vectors(new, changes, old["vectors"], embed) if same else embed(new).select("chunk_id", "vec")
    counts = report(changes).first()
    name = save(path, new, cut(vectors), embedder, settings, indexed_at, hashes)
    return {"added": counts.added, "removed": counts.removed, "kept": counts.kept, "loaded_from_cache": False, "snapshot": name}
