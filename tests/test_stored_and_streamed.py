"""The stored inverted index, the streamed snapshot, the limiter with timers, and limits by sessions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunking as C
from lodestone.operators import embed as E
from lodestone.operators import index as I
from lodestone.operators import inverted as N
from lodestone.operators import merkle as M
from lodestone.operators import privacy as R
from lodestone.operators import retrieve as S
from lodestone.streaming import documents as T
from lodestone.streaming import jobs as J

# ---------------------------------------------------------------- stored index


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    word = lambda: f"common{rng.randrange(3)}" if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 2000}"
    rows = [(f"c{i:04}", f"s{i % 7}\x01{i:05}", "", "", " ".join(word() for _ in range(rng.choice([0, 5, 30, 80])))) for i in range(1500)]
    rows += [(f"d{i}", "s0\x0100001", "", "", rows[40][4]) for i in range(40)]  # ties
    chunks = spark.createDataFrame(rows, "chunk_id string, okey string, title string, heading string, text string").repartition(4)
    asked = [(i, " ".join(["common0", "common1", *(word() for _ in range(6))])) for i in range(30)] + [(97, "unseen"), (98, "the of"), (99, rows[40][4])]
    return chunks.cache(), spark.createDataFrame(asked, "qid int, question string").cache()


def ranks(df):
    return sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())


def test_stored_search_is_bm25(spark, corpus, tmp_path, monkeypatch):
    chunks, asked = corpus
    stats = N.write(str(tmp_path / "i"), chunks, 200).first()
    stored = N.read(spark, str(tmp_path / "i"))
    assert stored["places"].select("shard").distinct().count() == 8 and stored["postings"].agg(F.max("n")).first()[0] <= N.BLOCK
    assert ranks(N.search(stored, asked, stats.n, stats.avgdl)) == ranks(S.bm25(asked, chunks))
    assert ranks(N.search(stored, asked, stats.n, stats.avgdl, 35)) == ranks(S.bm25(asked, chunks, 35))  # above the stored bound's k
    monkeypatch.setattr(N, "PAIRS", 40)  # many rounds
    monkeypatch.setattr(N, "EACH_TERM", 3)
    monkeypatch.setattr(N, "SOME_TERMS", 10)
    assert ranks(N.search(stored, asked, stats.n, stats.avgdl, 3)) == ranks(S.bm25(asked, chunks, 3))


def test_stored_search_reads_asked_terms_only(spark, corpus, tmp_path):
    chunks, _ = corpus
    stats = N.write(str(tmp_path / "i"), chunks).first()
    stored = N.read(spark, str(tmp_path / "i"))
    found = N.search(stored, spark.createDataFrame([(1, "common1 w17")], "qid int, question string"), stats.n, stats.avgdl)
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(term,common1)" in plan and "EqualTo(term,w17)" in plan
    reads = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert reads and not any("text" in line or "terms:" in line for line in reads)
    empty = N.write(str(tmp_path / "none"), chunks.limit(0)).first()
    assert N.search(N.read(spark, str(tmp_path / "none")), found.select("qid", F.lit("w1").alias("question")), empty.n, empty.avgdl).collect() == []


def test_skipping_leaves_most_postings_of_common_terms():
    """A rare term decides: of a long list of a common one few entries are scored, and the best are those of all."""
    rng = np.random.default_rng(3)
    n, dl = 16_000, 100
    lists = {"rare": np.sort(rng.choice(n, 300, replace=False)), "common": np.arange(n)}
    tf = {t: rng.integers(1, 4, len(p)) for t, p in lists.items()}
    idf = {"rare": 4.0, "common": 0.1}
    term, top, first, last, entries = [], [], [], [], []
    for t, p in lists.items():
        for lo in range(0, len(p), N.BLOCK):
            e = np.stack([p[lo : lo + N.BLOCK], tf[t][lo : lo + N.BLOCK], np.full(len(p[lo : lo + N.BLOCK]), dl)], 1).astype(np.int32)
            term.append(t)
            top.append(N.impact(e[:, 1], e[:, 2], dl).max())
            first.append(e[0, 0])
            last.append(e[-1, 0])
            entries.append(e.tobytes())
    held = N.Lists(term, np.array(top), np.array(first), np.array(last), entries)
    place, score, scored = N.best_of(held, list(idf.items()), 0.0, dl, 20)
    every = np.zeros(n)
    for t, p in lists.items():
        every[p] += idf[t] * N.impact(tf[t], dl, dl)
    want = np.sort(every)[::-1][:20]
    assert np.allclose(np.sort(score)[::-1][:20], want) and np.allclose(score, every[place]) and held.n == n + 300
    assert scored < held.n / 20


def test_snapshot_keeps_a_searchable_index(spark, corpus, tmp_path):
    chunks, asked = corpus
    I.save(str(tmp_path / "i"), chunks.withColumn("source", F.lit("s")), chunks.select("chunk_id", F.array(F.lit(1.0)).alias("vec")).limit(1), "h", "k", "now")
    got = I.load(spark, str(tmp_path / "i"))
    last = got["manifest"].first()
    assert ranks(N.search(got, asked, last.n, last.avgdl, 5)) == ranks(S.bm25(asked, chunks, 5))


def test_all_modes_at_once(spark, corpus):
    chunks, asked = corpus
    vec = lambda df, key, text: E.hashing(df.withColumn("t", X.search_terms(text)), key, "t", 16)
    cv, qv = vec(chunks, ["chunk_id", "okey"], S.search_text()), vec(asked, "qid", F.col("question"))
    got = {(r["mode"], r.qid, r["rank"]): r.chunk_id for r in S.all_modes(asked, chunks, qv, cv, 5).collect()}
    for mode in S.MODES:
        want = {(mode, r.qid, r["rank"]): r.chunk_id for r in S.search(asked, chunks, qv, cv, mode, 5).collect()}
        assert want == {k: v for k, v in got.items() if k[0] == mode}


# ---------------------------------------------------------------- document stream


def chunk(files):
    sections = files.select("source", F.lit("").alias("heading"), "text", F.lit("section").alias("kind"), F.lit(0).alias("section_no"))
    return C.distinct_chunks(C.with_ids(C.chunk_sections(sections, 20, 4))).select("chunk_id", "okey", "source", F.lit("").alias("title"), "heading", "text", "n_tokens")


def embed(chunks):
    return E.hashing(chunks.select("chunk_id", X.search_terms(S.search_text()).alias("t")), "chunk_id", "t", 16)


def test_batches_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    frame = lambda rows: spark.createDataFrame(rows, "source string, text string, seq int")
    step = lambda rows, batch: T.apply(spark, path, frame(rows), batch, chunk, embed, buckets=16)
    now = lambda: sorted((r.source, r.text) for r in T.current(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        T.current(spark, path)
    base = [(f"s{i}", f"text of {i}", 0) for i in range(200)]
    first = step(base, 0)
    assert (first["changed"], first["embedded"], first["heads_read"]) == (200, 200, 0)
    # of several versions the last counts, whatever the alphabet says; equal texts and unknown deletions change nothing
    rows = [("s1", "zz draft", 1), ("s1", "final", 2), ("s2", "text of 2", 1), ("s3", "gone soon", 1), ("s3", None, 2), ("nobody", None, 1), (None, "x", 1)]
    got = step(rows, 1)
    assert (got["changed"], got["deleted"], got["unchanged"], got["embedded"]) == (1, 1, 2, 1)
    assert got["heads_read"] < 200 * (got["buckets"] + 1) / 8 and got["buckets"] <= 4
    want = sorted([(s, "final" if s == "s1" else t) for s, t, _ in base if s != "s3"])
    assert now() == want
    assert step(rows, 1) == got and now() == want  # a repeated batch changes nothing
    # a deleted source comes back, a text keeps the vectors of the chunks that stay
    long = " ".join(f"Sentence number {i} of this text stands here." for i in range(12))
    step([("s3", long, 5)], 2)
    back = step([("s3", long + " One more stands at the end.", 6)], 3)
    assert back["reused"] > 0 and back["embedded"] < back["added"] and back["changed"] == 1
    heads = spark.read.parquet(f"{path}/generation=0/heads").count()
    before = now()
    assert T.compact(spark, path) == 1 and now() == before
    assert spark.read.parquet(f"{path}/generation=1/heads").count() == 200 < heads
    step([("s4", None, 7)], 4)
    assert now() == [r for r in before if r[0] != "s4"]


def test_a_broken_batch_never_counts(spark, tmp_path):
    path = str(tmp_path / "s")
    frame = lambda *rows: spark.createDataFrame(rows, "source string, text string, seq int")
    T.apply(spark, path, frame(("a", "one", 1)), 0, chunk, embed)

    def fails(chunks):
        raise RuntimeError("no embedder")

    with pytest.raises(RuntimeError):
        T.apply(spark, path, frame(("a", "two", 2)), 1, chunk, fails)
    assert [r.text for r in T.current(spark, path).collect()] == ["one"]
    T.apply(spark, path, frame(("a", "two", 2)), 1, chunk, embed)
    assert [r.text for r in T.current(spark, path).collect()] == ["two"]


# ---------------------------------------------------------------- limits


def test_limiter_with_timers_over_batches(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + i * 40) for i in range(60)]
    frame = lambda some: spark.createDataFrame(some, "event_id int, user_id int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    inbox, out, late = str(tmp_path / "in"), str(tmp_path / "out"), 0
    for part in (rows[:25], rows[25:40], [*rows[40:], (999, 1, 1_700_000_000)]):  # the last one is much too late
        frame(part).coalesce(1).write.mode("append").parquet(inbox)
        q = J.limit_stream(spark, spark.readStream.schema(frame(rows).schema).parquet(inbox), "user_id", "ts", "event_id", 2, 300, out, str(tmp_path / "cp"), "1 minute")
        q.awaitTermination(300)
        late += sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    got = {r.event_id: r.allowed for r in spark.read.parquet(out).collect()}
    want = {r.event_id: r.allowed for r in R.rate_limit(frame(rows), "user_id", "ts", "event_id", 2, 300).collect()}
    assert got == want and late == 1 and not all(want.values())
    assert "RocksDB" not in spark.conf.get(J.STORE[0], "")


def test_sessions_spread_a_hot_key(spark):
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 1, 5, 20, 59, 60, 61, 300])
        rows.append((i, 7 if i % 3 else rng.choice([None, 1, 2]), None if i % 97 == 0 else t, "x"))
    df = spark.createDataFrame(rows, "event_id int, user int, s long, _k string").withColumn("ts", F.timestamp_seconds("s")).repartition(5).drop("_k")
    for limit in (1, 3, 0):
        plain, dealt = R.rate_limit(df, "user", "ts", "event_id", limit, 60), R.rate_limit_by_sessions(df, "user", "ts", "event_id", limit, 60)
        assert dealt.columns == plain.columns
        assert {r.event_id: r.allowed for r in dealt.collect()} == {r.event_id: r.allowed for r in plain.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    where = R.rate_limit_by_sessions(df, "user", "ts", "event_id", 3, 60).filter("user = 7").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(where) >= 4 and max(r["count"] for r in where) < 1000  # of 2,000
    assert R.rate_limit_by_sessions(df.limit(0), "user", "ts", "event_id", 3, 60).collect() == []


def test_days_are_purged_in_place(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, t) for i, t in enumerate(["2024-01-01 10:00:00", "2024-01-04 23:59:59", "2024-01-05 00:00:00", "2024-01-05 12:00:00", "2024-01-05 11:59:59", "2024-01-09 00:00:00", "never", None, "2024-02-01 00:00:00"])]
    log = spark.createDataFrame(rows, "id int, ts string").repartition(3)
    for part in (log.filter("id < 4"), log.filter("id >= 4")):
        R.append_by_day(part, path)
    later = next((tmp_path / "log" / "day=2024-01-09").glob("*.parquet"))
    stamp = later.stat().st_mtime_ns
    want = R.purge_counts(log, "2024-01-20 12:00:00", 15).first()
    assert R.purge_days(spark, path, "2024-01-20 12:00:00", 15) == (want.kept, want.dropped) == (3, 6)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(r.id for r in R.purge(log, "2024-01-20 12:00:00", 15).collect()) == [3, 5, 8]
    assert later.stat().st_mtime_ns == stamp and sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["day=2024-01-05", "day=2024-01-09", "day=2024-02-01"]
    assert R.purge_days(spark, path, "2024-01-20 12:00:00", 15) == (3, 0)


def test_trees_are_read_where_they_differ(spark, tmp_path):
    base = {f"dir/{i}": f"{i:064x}" for i in range(3000)}
    frame = lambda files: spark.createDataFrame(list(files.items()), "source string, sha256 string")
    new = {k: v for k, v in base.items() if k != "dir/7"} | {"dir/9": "f" * 64, "more": "0" * 64}
    for name, files in (("old", base), ("new", new), ("none", {})):
        M.write(str(tmp_path / name), frame(files) if files else frame(base).limit(0))
    old, now, none = (M.read(spark, str(tmp_path / n)) for n in ("old", "new", "none"))
    found, compared = M.changes(old, now)
    assert sorted(map(tuple, found.collect())) == [("dir/7", "removed"), ("dir/9", "changed"), ("more", "added")]
    # a root, and at most sixteen children of each of three prefixes that differ
    assert compared[0] == 1 and compared[1] == 16 and all(n <= 48 for n in compared[2:])
    assert old["digests"].filter("level = 4").count() > 2500
    same, compared = M.changes(old, old)
    assert same.collect() == [] and compared == [1, 0, 0, 0, 0]
    assert M.changes(old, none)[0].filter("status = 'removed'").count() == 3000 and M.changes(none, none)[0].collect() == []
    plain = I.changed_sources(frame(base), frame(new))
    assert {r.source for r in plain.collect()} == {r.source for r in found.filter("status <> 'removed'").collect()}


def test_requests_of_mixed_modes(spark):
    """Each request is searched by its own mode, as a search of that mode alone; rejected ones say why and have no hits."""
    texts = [f"alpha word{i % 5} beta{i}" for i in range(30)]
    chunks = spark.createDataFrame([(f"c{i:02}", f"k{i:02}", "", "", t) for i, t in enumerate(texts)], "chunk_id string, okey string, title string, heading string, text string")
    chunks = S.with_terms(chunks).cache()
    vectors = E.hashing(chunks, ["chunk_id", "okey"], "terms").cache()
    embed = lambda q: E.hashing(q, "qid", "question")
    sound = [(i, f"word{i % 5} beta{i}", m, "e", True) for i, m in enumerate(S.MODES)] + [(4, "nothing here", "bm25", "e", None)]
    bad = [
        (10, "beta1", "fuzzy", "e", True), (11, "beta1", None, "e", True), (12, "beta1", "hybrid+rerank", "e", False), (13, "beta1", "hybrid+rerank", "e", None),
        (14, "beta1", "bm25", "f", True), (15, "beta1", "vector", None, True), (16, " ", "hybrid", "e", True), (17, None, "bm25", "e", True), (18, "", "fuzzy", "f", False),
    ]
    asked = spark.createDataFrame(sound + bad, "qid long, question string, mode string, embedder string, reranker boolean")
    got = S.search_requests(asked, chunks, vectors, embed, "e", 3).collect()
    why = {10: S.NO_MODE, 11: S.NO_MODE, 12: S.NO_RERANKER, 13: S.NO_RERANKER, 14: S.NO_EMBEDDER, 15: S.NO_EMBEDDER, 16: S.NO_QUESTION, 17: S.NO_QUESTION, 18: S.NO_MODE, 4: S.OK}
    assert {r.qid: (r.status, r.rank, r.chunk_id) for r in got if r.qid in why} == {q: (s, None, None) for q, s in why.items()}
    for qid, _, mode, _, _ in sound[:4]:
        one = asked.filter(F.col("qid") == qid).select("qid", "question")
        want = {(r.rank, r.chunk_id) for r in S.search(one, chunks, embed(one), vectors, mode, 3).collect()}
        assert want and {(r.rank, r.chunk_id) for r in got if r.qid == qid} == want
        assert {r.status for r in got if r.qid == qid} == {S.OK}
    assert S.search_requests(asked.limit(0), chunks, vectors, embed, "e").count() == 0
    assert {r.rank for r in S.search_requests(asked, chunks.limit(0), vectors.limit(0), embed, "e").collect()} == {None}


def test_placed_chunks_leave_their_texts(spark):
    """Only ids and terms go through the task that splits texts; the lists are those of all columns."""
    rows = [(f"c{i}", f"k{i}", "title", "", f"word{i} common " * 5) for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id string, okey string, title string, heading string, text string")
    assert S.with_terms(chunks, ["chunk_id", "okey"]).columns == ["chunk_id", "okey", "terms"]
    want = {(r.chunk_id, *r.terms) for r in S.with_terms(chunks).collect()}
    assert {(r.chunk_id, *r.terms) for r in N.placed(chunks).collect()} == want
    plan = N.placed(chunks)._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "text#" not in line.split("], ")[-1] and "title#" not in line
