"""Index snapshots and sync, whole answers, the log that is chosen, and streams into the index."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import answer as A
from lodestone.operators import chunking as C
from lodestone.operators import embed as E
from lodestone.operators import index as I
from lodestone.operators import privacy as R
from lodestone.operators import retrieve as S
from lodestone.streaming import jobs


def chunk(files):
    sections = files.select("source", F.lit("").alias("heading"), "text", F.lit("section").alias("kind"), F.lit(0).alias("section_no"))
    out = C.distinct_chunks(C.with_ids(C.chunk_sections(sections, 20, 4)))
    return out.select("chunk_id", "okey", "source", F.lit("").alias("title"), "heading", "text", "n_tokens")


def embed(chunks):
    return E.hashing(chunks.select("chunk_id", X.search_terms(S.search_text()).alias("t")), "chunk_id", "t", 16)


def files(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "source string, text string")


def synced(spark, path, texts, **more):
    options = {"embedder": "h16", "settings": "20/4", "indexed_at": "now"} | more
    got = I.sync(spark, path, files(spark, **texts), chunk, embed, **options)
    return got["added"], got["removed"], got["kept"], got["loaded_from_cache"]


def test_sync(spark, tmp_path):
    path = str(tmp_path / "index")
    assert I.newest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        I.load(spark, path)
    texts = {"a": "one two three", "b": "four five", "c": "six"}
    assert synced(spark, path, texts) == (3, 0, 0, False)
    assert synced(spark, path, texts) == (0, 0, 3, True)
    assert synced(spark, path, texts | {"b": "four five seven"}) == (1, 1, 2, False)
    assert synced(spark, path, {"a": texts["a"]}) == (0, 2, 1, False)
    assert synced(spark, path, {"a": texts["a"]}, embedder="other") == (1, 0, 0, False)
    assert synced(spark, path, {"a": texts["a"]}, embedder="other", force=True) == (1, 0, 0, False)
    got = I.load(spark, path, "other")
    assert got["chunks"].count() == got["vectors"].count() == 1 and got["manifest"].first().n == 1 and got["postings"].count() > 0
    with pytest.raises(ValueError, match="other"):
        I.load(spark, path, "h16")


def test_a_broken_save_leaves_the_last_snapshot(spark, tmp_path):
    path = str(tmp_path / "index")
    synced(spark, path, {"a": "one two"})
    last = I.newest(spark, path).snapshot
    # a save that stops before its manifest
    synced(spark, path, {"a": "three"})
    newer = I.newest(spark, path).snapshot
    shutil.rmtree(os.path.join(path, "manifests", newer))
    assert newer != last == I.newest(spark, path).snapshot
    assert [r.text for r in I.load(spark, path)["chunks"].collect()] == ["one two"]
    assert synced(spark, path, {"a": "three"}) == (1, 1, 0, False)


def test_only_changed_sources_are_chunked_and_added_chunks_embedded(spark, tmp_path):
    path = str(tmp_path / "index")
    seen = []

    def counted(kind, f):
        def run(df):
            seen.append((kind, sorted(r[0] for r in df.select("source" if kind == "chunk" else "text").collect())))
            return f(df)

        return run

    for texts in ({"a": "one", "b": "two"}, {"a": "one", "b": "three"}):
        I.sync(spark, path, files(spark, **texts), counted("chunk", chunk), counted("embed", embed), "h16", "s", "now")
    assert seen == [("chunk", ["a", "b"]), ("embed", ["one", "two"]), ("chunk", ["b"]), ("embed", ["three"])]


def test_fingerprints_by_buckets(spark):
    f = files(spark, **{f"n{i}": str(i) for i in range(50)})
    one = I.bucketed_fingerprint(I.file_hashes(f), "k", 10).first()[0]
    assert one == I.bucketed_fingerprint(I.file_hashes(f.repartition(7)), "k", 10).first()[0]
    assert one != I.bucketed_fingerprint(I.file_hashes(f), "l", 10).first()[0]
    assert one != I.bucketed_fingerprint(I.file_hashes(f.filter("source <> 'n3'")), "k", 10).first()[0]
    assert I.bucketed_fingerprint(I.file_hashes(f.limit(0)), "k").count() == 1


def test_ask(spark):
    rows = [("1", "a", "s1", "", "Credit", "Transfer credit has a limit. It is ten."), ("2", "b", "s2", "", "", "The library opens early.")]
    chunks = spark.createDataFrame(rows, "chunk_id string, okey string, source string, title string, heading string, text string")
    q = spark.createDataFrame([(0, "What is the credit limit?"), (1, "Where do penguins live?"), (2, " ")], "qid int, question string")
    vec = E.hashing(chunks.select("chunk_id", S.search_text().alias("st")), "chunk_id", "st", 64).join(chunks.select("chunk_id", "okey"), "chunk_id")
    hits = S.search(q, chunks, E.hashing(q, "qid", "question", 64), vec, "hybrid", 2).join(chunks.select("chunk_id", "source"), "chunk_id")
    answers, cited = A.ask(q, hits, contact="the desk")
    got = {r.qid: r for r in answers.collect()}
    assert not got[0].abstained and "Transfer credit has a limit. [1]" in got[0].answer
    assert got[1].abstained and got[2].abstained and got[1].answer == A.FALLBACK.replace("{contact}", "the desk")
    assert {r.qid for r in cited.collect()} == {0}
    asked = []
    answers, cited = A.ask(q, hits, model=lambda m: asked.append(m) or "Ten [1] [9].")
    got = {r.qid: r.answer for r in answers.collect()}
    assert got[0] == "Ten [1]." and got[1].startswith("The documents")
    assert [(r.qid, r.marker) for r in cited.collect()] == [(0, 1)]


def test_log_and_purge(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("2024-01-30T00:00:00Z", "mail a@b.co", False), ("2023-01-01 00:00:00", "old", True), ("never", "odd", True), (None, "none", True)]
    answers = spark.createDataFrame([(*r, ["c"], "m", "v1", "bm25", "secret answer") for r in rows], "ts string, question string, abstained boolean, cited_chunks array<string>, model string, prompt_version string, mode string, answer string")
    assert not R.append_log(answers, path, False) and not os.path.exists(path)
    assert R.append_log(answers, path, True) and R.append_log(answers.limit(1), path, True)
    log = spark.read.parquet(path)
    assert log.count() == 5 and "answer" not in log.columns and {r.question for r in log.collect()} >= {"mail [email]", "old"}
    assert tuple(R.purge_counts(log, "2024-01-31 00:00:00", 30).first()) == (2, 3)
    assert R.purge(log, "2024-01-31 00:00:00", 30).count() == 2


def test_documents_stream_into_the_index(spark, tmp_path):
    path, inbox = str(tmp_path / "index"), str(tmp_path / "in")
    apply = jobs.index_arrivals(spark, path, chunk, embed, "h16", "s")
    for texts in ({"a": "one", "b": "two"}, {"b": "three", "c": "four"}):
        files(spark, **texts).coalesce(1).write.mode("append").parquet(inbox)
        jobs.sync_stream(spark.readStream.schema("source string, text string").parquet(inbox), apply, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted((r.source, r.text) for r in I.load(spark, path)["chunks"].collect()) == [("a", "one"), ("b", "three"), ("c", "four")]


def test_redaction_reads_a_run_once(spark):
    df = spark.createDataFrame([("a" * 300_000 + " x@y.zz +1 (555) 123-4567",)], "t string")
    assert df.select(X.redact(F.col("t"))).first()[0] == "a" * 300_000 + " [email] [phone]"


def test_apply_manifest(spark):
    chunks = spark.createDataFrame([("p", "own", "d"), ("q", None, None), ("r", "own", "d")], "source string, title string, updated string")
    manifest = spark.createDataFrame([("p", "given", ""), ("q", "", "2024")], "path string, title string, updated string")
    assert sorted(tuple(x) for x in C.apply_manifest(chunks, manifest).select("source", "title", "updated").collect()) == [("p", "given", "d"), ("q", "", "2024"), ("r", "own", "d")]
