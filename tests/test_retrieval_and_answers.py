import collections
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.functions import patterns as P
from lodestone.functions import text as X
from lodestone.functions import words as W
from lodestone.operators import ablation as B
from lodestone.operators import answer as A
from lodestone.operators import embed as E
from lodestone.operators import evaluate as V
from lodestone.operators import index as I
from lodestone.operators import privacy as R
from lodestone.operators import retrieve as S
from lodestone.plans.tables import cut
from lodestone.streaming import jobs

CHUNKS = "chunk_id string, okey string, source string, title string, heading string, text string"


@pytest.fixture
def chunks(spark):
    rows = [("1", "a", "s1", "", "Credit", "transfer credit limit"), ("2", "b", "s2", "", "", "library opens early"), ("3", "c", "s3", "", "", "")]
    return spark.createDataFrame(rows, CHUNKS)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, question string")


def vectors(chunks):
    v = E.hashing(chunks.select("chunk_id", S.search_text().alias("st")), "chunk_id", "st", 64)
    return v.join(chunks.select("chunk_id", "okey"), "chunk_id")


def test_bm25_by_hand(spark, chunks):
    r = S.bm25(ask(spark, "credit credit zebra"), chunks).collect()
    idf, tf, avg = math.log((3 - 1 + 0.5) / 1.5 + 1), 2, 7 / 3
    assert len(r) == 1 and r[0].chunk_id == "1"
    assert r[0].score == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / avg)))


def test_fusion(spark):
    rows = lambda *x: spark.createDataFrame([(0, c, c, r) for c, r in x], "qid int, chunk_id string, okey string, rank int")
    got = S.fuse([("x", rows(("a", 1), ("b", 2), ("a", 3))), ("y", rows(("b", 1), ("c", 2)))]).orderBy("rank").collect()
    assert [g.chunk_id for g in got] == ["b", "a", "c"] and got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[0].ranks == {"x": 2, "y": 1}
    with pytest.raises(ValueError):
        S.fuse([], 0)


def test_search_modes(spark, chunks):
    q = ask(spark, "credit limits", " ", "the of")
    qv, cv = E.hashing(q, "qid", "question", 64), vectors(chunks)
    for mode in S.MODES:
        hits = S.search(q, chunks, qv, cv, mode, 2).collect()
        assert not [h for h in hits if h.qid == 1]
        assert next(h for h in hits if h.qid == 0 and h.rank == 1).chunk_id == "1"
    # a zero vector ties with all: corpus order
    assert [h.chunk_id for h in sorted((h for h in S.search(q, chunks, qv, cv, "vector", 2).collect() if h.qid == 2), key=lambda h: h.rank)] == ["1", "2"]
    with pytest.raises(ValueError):
        S.search(q, chunks, qv, cv, "other")
    with pytest.raises(ValueError):
        S.search(q, chunks, qv, cv, "hybrid+rerank", reranker=None)
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return -b.str.len().astype(float)

    assert S.search(q.filter("qid = 0"), chunks, qv, cv, "hybrid+rerank", 1, reranker=length).first().chunk_id == "3"


def test_embedders(spark):
    q = ask(spark, "credit", "")
    rows = {r.qid: np.array(r.vec) for r in E.hashing(q, "qid", "question", 32).collect()}
    assert np.linalg.norm(rows[0]) == pytest.approx(1) and not rows[1].any()
    got = E.plugged(q, "qid", "question", lambda t: np.array([[len(x), 1.0] for x in t]), 1).orderBy("qid").collect()
    assert got[1].vec == [0.0, 1.0]


def test_gate_and_messages(spark, chunks):
    q = ask(spark, "credit limit", "unknown words")
    hits = S.search(q, chunks, E.hashing(q, "qid", "question", 64), vectors(chunks), "bm25").join(chunks.select("chunk_id", "source"), "chunk_id")
    gate = {r.qid: r.abstained for r in A.gate(q, hits).collect()}
    assert gate == {0: False, 1: True}
    past = spark.createDataFrame([(0, 1, "a?", "b"), (0, 2, "c?", "d")], "qid int, turn int, question string, answer string")
    m = {r.qid: r.messages for r in A.messages(q, hits, past).collect()}
    assert [x.role for x in m[0]] == ["system", "user", "assistant", "user", "assistant", "user"] and '<passage id="1" source="s1" section="Credit">' in m[0][-1].content
    with pytest.raises(ValueError):
        A.messages(q, hits, version="v9")
    said = {r.qid: r.answer for r in A.extractive(q, hits).collect()}
    assert said[0] == "transfer credit limit [1]" and said[1] == ""
    cites = A.cite(spark.createDataFrame([(0, "none")], "qid int, answer string"), hits)
    assert [(c.marker, c.chunk_id) for c in cites.collect()] == [(1, "1")]
    assert A.sources_block(cites).first().block == "Sources:\n[1] s1 - Credit"
    assert A.chat(A.messages(q, hits), lambda m: str(len(m))).first().answer == "2"
    answers = A.gate(q, hits).withColumn("answer", F.lit("x"))
    assert '"abstained":false' in A.to_records(answers, cites, "m", "v1", "bm25").filter("qid = 0").first().record


def test_history(spark):
    t = [(1, 0, "system", "s"), (1, 1, "user", "a b"), (1, 2, "assistant", "c [1]"), (1, 3, "user", "d"), (1, 4, "assistant", "e"), (1, 5, "user", "f")]
    pairs = A.exchanges(spark.createDataFrame(t, "conv_id int, turn int, role string, text string"))
    assert pairs.count() == 2
    assert [r.turn for r in A.history(pairs, 4).collect()] == [3]
    assert sorted((r.turn, r.answer) for r in A.history(pairs, 5).collect()) == [(1, "c"), (3, "e")]
    assert A.history(pairs, 0).count() == 0


def test_sync(spark, chunks, tmp_path):
    new = chunks.filter("chunk_id <> '2'").withColumn("title", F.when(F.col("chunk_id") == "1", "t").otherwise(""))
    changes = I.diff(chunks, new)
    assert {r.chunk_id: r.status for r in changes.collect()} == {"1": "added", "2": "removed", "3": "kept"}
    assert tuple(I.report(changes).first()) == (1, 1, 1) and tuple(I.report(I.diff(chunks, new, False)).first()) == (2, 0, 0)
    made = []
    vecs = I.reuse_vectors(new, changes, vectors(chunks), lambda c: (made.append(1), vectors(c))[1])
    assert sorted(r.chunk_id for r in vecs.collect()) == ["1", "3"]
    h = I.file_hashes(chunks)
    assert I.fingerprint(h, "a").first() != I.fingerprint(h, "b").first() and I.bucketed_fingerprint(h, "a").count() == 1
    assert I.changed_sources(h, I.file_hashes(chunks.withColumn("text", F.concat("text", F.lit("!"))))).count() == 3
    I.save(str(tmp_path / "i"), chunks, vectors(chunks), "hashing-64", "k", "2024-01-01")
    got = I.load(spark, str(tmp_path / "i"), "hashing-64")
    assert got["chunks"].count() == 3 and got["vectors"].count() == 3
    with pytest.raises(ValueError):
        I.load(spark, str(tmp_path / "i"), "other")


def test_fingerprint_is_streamed(spark):
    """The digest of all lines in name order, without a row that holds them all."""
    names = ["", "a/b", "é", "B", *map(str, range(3000))]
    rows = [(n, hashlib.sha256(n.encode()).hexdigest()) for n in names]
    one = I.fingerprint(spark.createDataFrame(rows, "source string, sha256 string").repartition(7), "k=1")
    lines = "".join(f"{n}={h};" for n, h in sorted(rows, key=lambda r: r[0].encode()))
    assert [tuple(r) for r in one.collect()] == [(hashlib.sha256(("k=1" + lines).encode()).hexdigest(),)]
    assert "collect_list" not in one._jdf.queryExecution().executedPlan().toString()
    digests = collections.defaultdict(hashlib.sha256)
    frame = spark.createDataFrame(rows, "source string, sha256 string").repartition(5)
    for n, h in sorted(rows, key=lambda r: r[0].encode()):  # as many buckets as 3,004 names need at 200 each
        digests[int(hashlib.md5(n.encode()).hexdigest()[:13], 16) % 16].update(f"{n}={h};".encode())
    two = "k=1" + "".join(digests[b].hexdigest() for b in sorted(digests))
    assert I.bucketed_fingerprint(frame, "k=1", 200).first().fingerprint == hashlib.sha256(two.encode()).hexdigest()
    empty = I.fingerprint(spark.createDataFrame([], "source string, sha256 string"), "k=1").collect()
    assert [r.fingerprint for r in empty] == [hashlib.sha256(b"k=1").hexdigest()]


def test_retention_and_staleness(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",), ("bad",), (None,)], "ts string")
    assert R.purge(log, "2024-01-31 00:00:00", 30).count() == 1
    m = spark.createDataFrame([("a", "", 0, ""), ("b", "o", 5, ""), ("c", "o", 5, "2024-01-05"), ("d", "o", 5, "2024-01-04")], "path string, owner string, refresh_days int, updated string")
    assert [r.flag for r in R.stale_sources(m, "2024-01-10").orderBy("path").collect()] == ["ok", "STALE", "ok", "STALE"]


def test_limiter():
    assert R.allowed([0, 1, 2, 59, 60, 61], 2, 60)[0] == [True, True, False, False, True, True]
    assert R.allowed([0, 0], 0, 60)[0] == [True, True]


def test_admission(spark):
    rows = [(1, "k", 0, "q", 0, "hybrid"), (2, "k", 1, "", 0, "hybrid"), (3, "k", 2, "q", 0, "odd"), (4, "k", 3, "q", 0, "hybrid"), (5, "j", 3, "q", 21, "hybrid")]
    df = spark.createDataFrame(rows, "request_id int, key string, s int, question string, n_history int, mode string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert {r.request_id: r.status for r in R.admission(df, 2, 60).collect()} == {1: 200, 2: 422, 3: 422, 4: 429, 5: 422}


def test_limiter_streams_a_hot_key(spark):
    """Keys are taken in small batches, not as a frame each; a key's state goes on across batches, and null is a key."""
    rows = [(i, None if i % 11 == 0 else i % 5 if i % 3 else 1, (i * 7919) % 4000 // 3) for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        limited = R.rate_limit(df, "user_id", "ts", "event_id", 3, 40)
        got = {r.event_id: r.allowed for r in limited.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for user in {r[1] for r in rows}:
        mine = sorted((s, i) for i, u, s in rows if u == user)
        want |= dict(zip([i for _, i in mine], R.allowed([s for s, _ in mine], 3, 40)[0]))
    assert got == want and limited.columns == [*df.columns, "allowed"]
    assert "FlatMapGroups" not in limited._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + i * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    df.orderBy("event_id").write.parquet(str(tmp_path / "in"))
    stream = jobs.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", 2, 60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = R.rate_limit(df, "user_id", "ts", "event_id", 2, 60)
    key = lambda d: {r.event_id: r.allowed for r in d.select("event_id", "allowed").collect()}
    assert key(spark.table("limited")) == key(batch)
    log = jobs.redacted_log_stream(spark.readStream.schema("question string").json(str(tmp_path / "log")) if (tmp_path / "log").mkdir() or (tmp_path / "log" / "a.json").write_text('{"question": "a@b.co"}') else None)
    seen = []
    jobs.sync_stream(log, lambda d, i: seen.extend(r.question for r in d.collect()), str(tmp_path / "cp2")).awaitTermination(120)
    assert seen == ["[email]"]


def test_evaluation(spark):
    rel = "array<struct<source:string,heading:string>>"
    gold = spark.createDataFrame([(1, True, [("s", "He"), ("t", "")]), (2, True, [("u", "x")]), (3, False, [])], f"qid int, answerable boolean, relevant {rel}")
    hits = spark.createDataFrame([("m", 1, 1, "z", "h"), ("m", 1, 2, "s", "the head"), ("m", 1, 3, "t", "any")], "mode string, qid int, rank int, source string, heading string")
    r = V.retrieval_report(hits, gold, spark.createDataFrame([("m",)], "mode string")).first()
    assert (r.questions, r.recall_at_1, r.recall_at_3, r.mrr) == (2, 0.0, 0.5, 0.25)
    a = spark.createDataFrame([(1, False), (2, True), (3, False)], "qid int, abstained boolean")
    assert tuple(V.abstention_report(a, gold).first()) == pytest.approx((1 / 3, 0.5, 1.0))
    assert V.gold_cited(a, hits, gold).first().gold_cited == 1.0
    assert [r.qid for r in V.uncovered(hits.select("source", "heading"), gold).collect()] == [2]


def test_ablation_is_hybrid_and_counts_chunks(spark, monkeypatch):
    """Each size is searched by the mode that answers are given in, and reported with its number of chunks."""
    t = {
        "documents": spark.createDataFrame([(1, "s", "alpha beta gamma delta epsilon zeta eta"), (2, "s", "word " * 90)], "doc_id long, source string, text string"),
        "benchmark": spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "nothing of it")], "item_id long, text string"),
    }
    modes, search = [], S.search
    monkeypatch.setattr(Q, "_t", lambda spark, d, name: t[name])
    monkeypatch.setattr(S, "search", lambda *a, **k: (modes.append(a[4]), search(*a, **k))[1])
    got = {r.chunk_tokens: r for r in Q.chunk_size_ablation(spark, "").collect()}
    assert modes == ["hybrid"] * 4 and [got[s].chunks for s in ("60", "120", "220", "400")] == [3, 2, 2, 2]
    assert all(r.questions == 1 and r.recall_at_1 == 1.0 for r in got.values())


def test_passages_by_an_automaton(spark):
    docs = [("a", "the cat sat on the mat, the cat"), ("b", "Thé cat"), ("c", ""), ("d", None), ("e", "cat sat")]
    passages = [(1, "cat"), (2, "cat sat"), (3, "é c"), (4, "dog"), (5, ""), (6, None), (7, "cat"), (None, "mat")]
    d = spark.createDataFrame(docs, "source string, text string")
    p = spark.createDataFrame(passages, "qid int, text string")
    want = sorted(((s, i) for s, t in docs for i, x in passages if t is not None and x is not None and x in t), key=repr)
    for at_once in (1 << 20, 4):
        assert sorted(map(tuple, V.containing(d, "source", p, "qid", at_once).collect()), key=repr) == want
    assert V.containing(d, "source", p.limit(0), "qid").collect() == [] == V.containing(d.limit(0), "source", p, "qid").collect()


def test_vector_search_skips_blocks_that_are_too_far(spark):
    """Clustered vectors, ties and zero vectors: the exact k best, with a part of the products."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 24))[np.arange(6000) // 500] + 0.05 * rng.normal(size=(6000, 24))
    x[100:130] = x[100]
    x[7] = 0
    v = spark.createDataFrame([(f"c{i}", f"{i // 2:05}", [float(c) for c in r]) for i, r in enumerate(x)], "chunk_id string, okey string, vec array<double>").coalesce(2)
    queries = [*range(0, 6000, 300), 7, 100]
    q = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in queries], "qid int, vec array<double>")
    told = spark.sparkContext.accumulator(0)
    got = {}
    for r in S.vector(q, v, 10, query_block=4, block=128, sample=300, told=told).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id))
    for i in queries:
        s = (x @ x[i]).round(9)
        want = sorted(range(6000), key=lambda j: (-s[j], f"{j // 2:05}", f"c{j}"))[:10]
        assert [c for _, c in sorted(got[i])] == [f"c{j}" for j in want]
    assert told.value < 0.5 * 6000 * len(queries)
    assert S.vector(q, v.limit(0), 10).collect() == [] == S.vector(q.limit(0), v, 10).collect()
    assert sorted(r["rank"] for r in S.vector(q.limit(1), v.limit(3), 10).collect()) == [1, 2, 3]


def test_bm25_where_chunks_lie_and_by_joins(spark, monkeypatch):
    """Both ways give the same rows, whatever a task holds at a time."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{int(rng.exponential(20))}"
    rows = [(f"c{i}", f"{i % 50:03}", "", "", " ".join(word() for _ in range(int(rng.integers(0, 30))))) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, okey string, title string, heading string, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(12)] + [(50, ""), (51, "zzz")], "qid int, question string")
    read = lambda: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 8)) for r in S.bm25(q, chunks, 7).collect())
    got = read()
    assert len(got) == 12 * 7
    monkeypatch.setattr(S, "CELLS", 30)
    assert read() == got
    monkeypatch.setattr(S, "FEW_TERMS", 3)
    assert read() == got
    assert S.bm25(q, chunks.limit(0), 7).collect() == [] == S.bm25(q.limit(0), chunks, 7).collect()


def test_variants_are_corpora_of_their_own(spark, monkeypatch):
    """Searching keyed rows gives what each key's rows give alone, whether terms are sent or joined; rows of no key are in none."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.exponential(15))}"
    rows = [(v, f"c{i}", f"{i % 40:03}", [word() for _ in range(int(rng.integers(0, 5 + 20 * n)))]) for n, v in enumerate(("a", "b", None)) for i in range(150 * (n + 1))]
    chunks = spark.createDataFrame(rows, "size string, chunk_id string, okey string, terms array<string>").repartition(3)
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(4))) for i in range(9)] + [(50, "zzz")], "qid int, question string")
    vectors, asked = E.hashing(chunks, ["size", "chunk_id", "okey"], "terms", 16), E.hashing(q, "qid", "question", 16)
    read = lambda df, v: sorted((v or r["size"], r.qid, r["rank"], r.chunk_id, round(r.score, 8)) for r in df.collect())
    own = lambda df, v: df.filter(F.col("size") == v).drop("size")
    lexical = [x for v in ("a", "b") for x in read(S.bm25(q, own(chunks, v), 6), v)]
    dense = [x for v in ("a", "b") for x in read(S.vector(asked, own(vectors, v), 6), v)]
    pairs = lambda v: [("bm25", S.bm25(q, own(chunks, v), 6)), ("vector", S.vector(asked, own(vectors, v), 6))]
    fused = [x for v in ("a", "b") for x in read(S.fuse(pairs(v)), v)]
    assert len(lexical) == 2 * 9 * 6 and len(dense) == 2 * 10 * 6
    assert read(S.bm25(q, chunks, 6, by="size"), None) == lexical
    assert read(S.vector(asked, vectors, 6, query_block=4, block=32, by="size"), None) == dense
    assert read(S.fuse([("bm25", S.bm25(q, chunks, 6, by="size")), ("vector", S.vector(asked, vectors, 6, by="size"))], by="size"), None) == fused
    monkeypatch.setattr(S, "FEW_TERMS", 3)
    assert read(S.bm25(q, chunks, 6, by="size"), None) == lexical
    assert S.bm25(q, chunks.limit(0), 6, by="size").collect() == [] == S.vector(asked, vectors.limit(0), 6, by="size").collect()


def test_ablation_in_one_plan(spark, monkeypatch):
    """One pass over the sections gives what the loop over sizes gives, and a chunking without chunks has a row of zeros."""
    t = {
        "documents": spark.createDataFrame([(i, "s", " ".join(f"w{(i * 7 + j) % 90}." if j % 9 == 8 else f"w{(i * j) % 70}" for j in range(40 * i))) for i in range(12)] + [(99, "s", None)], "doc_id long, source string, text string"),
        "benchmark": spark.createDataFrame([(1, "w1 w2 w3"), (2, "w0 w7 w14"), (3, "w0 w5 w10 w15"), (4, " ")], "item_id long, text string"),
    }
    monkeypatch.setattr(Q, "_t", lambda spark, d, name: t[name])
    want = sorted((r.chunk_tokens, r.chunks, r.questions, r.recall_at_1, r.recall_at_3, r.recall_at_5, r.mrr) for r in Q.chunk_size_ablation(spark, "").collect())
    sections, asked, gold = Q._sections(spark, ""), Q.questions(spark, ""), Q.gold(spark, "")
    got = sorted((r.variant, r.chunks, r.questions, r.recall_at_1, r.recall_at_3, r.recall_at_5, r.mrr) for r in B.report(sections, asked, gold).collect())
    assert len(got) == 4 and [g[:3] for g in got] == [w[:3] for w in want]
    assert [x for g in got for x in g[3:]] == pytest.approx([x for w in want for x in w[3:]])
    none = B.report(sections.limit(0), asked, gold, {"60": (60, 15)}).first()
    assert (none.variant, none.chunks, none.recall_at_5, none.mrr) == ("60", 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        B.report(sections, asked, gold, {"x": (10, 10)})
    assert {v: o for v, (_, o) in B.variants((60, 400), 30).items()} == {"60": 15, "400": 30}


def test_terms_of_stretches(spark, monkeypatch):
    texts = ["The cats' studies of the bus", None, "", "x " * 40 + "glasses", "Cat cats CATS it's 3.14"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    want = [r.t for r in df.select("n", X.search_terms(F.col("text")).alias("t")).orderBy("n").collect()]
    monkeypatch.setattr(W, "CHARACTERS", 30)
    low = pa.array([(t or "").lower() for t in texts])
    some = list(W.of_texts(low))
    assert len(some) > 1 and [x for t in some for x in t.lists().to_pylist()] == want
    monkeypatch.setattr(W, "TERMS", 3)
    lists = list(W.of_lists(pa.array(want)))
    assert len(lists) > 1 and [x for t in lists for x in t.lists().to_pylist()] == want
    uses = {r.term: (r.uses, r.docs) for r in S.uses(df).collect()}
    assert uses["cat"] == (4, 2) and uses["x"] == (40, 1) and "the" not in uses


def test_hits_are_sent_to_the_chunks(spark):
    chunks = S.with_terms(spark.createDataFrame([(f"c{i}", f"k{i}", "", "", f"word{i} common") for i in range(9)], "chunk_id string, okey string, title string, heading string, text string"))
    q = cut(spark.createDataFrame([(1, "word3 common")], "qid int, question string"))  # of known size
    hits = S.search(q, chunks, E.hashing(q, "qid", "question", 16), E.hashing(chunks, ["chunk_id", "okey"], "terms", 16), "hybrid", 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and hits.count() == 2 and hits.orderBy("rank").first().chunk_id == "c3"


def test_features_are_hashed_in_bulk(monkeypatch):
    """Words, pairs and 4-grams get the first half of their MD5, short ones without a call for each."""
    md5, called = hashlib.md5, []
    monkeypatch.setattr(E, "md5", lambda data: called.append(data) or md5(data))
    half = lambda f: int(md5(f.encode()).hexdigest()[:16], 16)
    texts = ["", "b", "it's u.s.a. version 10.2 of b " * 3, " ".join("x" * n for n in range(50, 60)), *(f"word{i} is near word{i + 1}" for i in range(3000))]
    got = [x for t in W.of_texts(pa.array(texts)) for _, some in E._vectors(t, 32) for x in some]
    assert len(got) == len(texts) and 0 < len(called) < 40 and all(len(x) > 55 for x in called)
    for text, x in zip(texts, got):
        terms, want = next(W.of_texts(pa.array([text]))).lists()[0].as_py(), np.zeros(32)
        for f, weight in [*((w, 1.0) for w in terms), *((f"{a}|{b}", 0.6) for a, b in zip(terms, terms[1:])), *((f"^{w}$"[i : i + 4], 0.25) for w in terms for i in range(max(1, len(w) - 1)))]:
            want[half(f) % 32] += weight if half(f) % 2 else -weight
        assert np.allclose(x, want)


def test_terms_are_split_as_the_pattern_does(monkeypatch):
    """Bytes tell a text's terms: signs join only within a row, between two letters or digits; other scripts and signs part."""
    texts = ["a'b.c", "a..b c.", "'x", "", ".y", "it's é3.14é.5", "glasses", "k", "", "ab's.s' buses cities's"]
    pattern = re.compile(P.TERM)
    want = [[X.folded(w) for w in pattern.findall(t) if w not in P.STOPWORDS] for t in texts]
    for at_once in (1, 7, 1 << 20):
        monkeypatch.setattr(W, "CHARACTERS", at_once)
        for skip in (0, 3, len(texts)):
            assert [x for t in W.of_texts(pa.array(texts, pa.string())[skip:]) for x in t.lists().to_pylist()] == want[skip:]


def test_chunks_are_embedded_where_they_are_compared(spark, monkeypatch):
    """A function of chunks in place of stored vectors gives the same hits; it embeds every chunk once, and again a bounded sample and the hits."""
    monkeypatch.setattr(S, "SAMPLE", 8)
    rows = [(f"c{i:03}", f"k{i:03}", "s", "", f"head{i % 3}", f"word{i % 7} beta{i % 11} common") for i in range(300)]
    chunks = cut(spark.createDataFrame(rows, CHUNKS))
    q = ask(spark, "word3 beta4", "beta9 common", " ")
    asked, stored = E.hashing(q, "qid", "question", 64), vectors(chunks)
    count = spark.sparkContext.accumulator(0)

    def embed(some):
        def told(batches):
            for b in batches:
                count.add(b.num_rows)
                yield b

        return Q.E.hashing(some.withColumn("st", S.search_text()).mapInArrow(told, some.withColumn("st", S.search_text()).schema), ["chunk_id", "okey"], "st", 64)

    read = lambda hits: sorted((h.qid, h["rank"], h.chunk_id, round(h.vector_score, 9), h.rerank_score) for h in hits.collect())
    for mode in S.MODES:
        count.value = 0
        hits = S.search(q, chunks, asked, embed, mode, 2)
        got = read(hits)
        assert got and got == read(S.search(q, chunks, asked, stored, mode, 2))
        assert count.value <= (300 if mode != "bm25" else 0) + 8 + 2 * 2 * S.CANDIDATES
    want = sorted(map(str, S.all_modes(q, chunks, asked, stored, 3).collect()))
    assert want == sorted(map(str, S.all_modes(q, chunks, asked, embed, 3).collect()))


def test_bm25_reads_texts_without_their_lists(spark, chunks):
    """Texts and stored terms give the same scores, and of texts no list of terms leaves the task that splits them."""
    q = ask(spark, "credit limits early", "opening")
    read = lambda c: sorted((r.qid, r["rank"], r.chunk_id, r.score) for r in S.bm25(q, c, 3).collect())
    assert read(chunks) == read(S.with_terms(chunks)) != []
    plan = S._asked_words(S._keyed(chunks, None), ["credit"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array" not in plan.lower().replace("mapinarrow", "")


class _Told:
    """E.Hashing that counts the rows it makes vectors of."""

    def __init__(self, count, dim=64):
        self.count, self.dim = count, dim

    def __call__(self, some):
        self.count.add(some.count())
        return E.Hashing(S.search_text, self.dim)(some)

    def of_terms(self, terms):
        for t, x in E.Hashing(S.search_text, self.dim).of_terms(terms):
            self.count.add(len(x))
            yield t, x


def test_one_pass_makes_both_lists(spark, monkeypatch):
    """Terms are counted and chunks compared in one pass of the texts: every chunk is embedded once, and again the hits only.

    Copies, blank texts and a question without terms; small stretches, so that a task's best change often."""
    monkeypatch.setattr(W, "CHARACTERS", 300)
    rows = [(f"c{i * 7 % 400:03}", f"k{i // 2 * 7 % 200:03}", "s", "", "", "" if i % 50 == 9 else "same text for all" if i % 3 == 0 else f"word{i % 7} beta{i % 11} common") for i in range(400)]
    chunks = cut(spark.createDataFrame(rows, CHUNKS).repartition(3))
    q = ask(spark, "word3 beta4", "same text", "beta9 common", "of the")
    asked, stored, count = E.hashing(q, "qid", "question", 64), vectors(chunks), spark.sparkContext.accumulator(0)
    read = lambda found: sorted((r.qid, r["rank"], r.chunk_id, r.okey, round(r.score, 9)) for r in found.collect())
    for k in (3, 20, 500):
        lexical, dense = S.lists(q, asked, chunks, _Told(count), k)
        assert read(lexical) == read(S.bm25(q, chunks, k)) != []
        assert read(dense) == read(S.vector(asked, stored, k)) and dense.count() == 4 * min(k, 400)
    none = [read(found) for found in S.lists(q.limit(0), asked.limit(0), chunks, _Told(count))]
    assert none == [[], []] == [read(found) for found in S.lists(q, asked, chunks.limit(0), _Told(count))]
    for most in ("AT_ONCE", "FEW_TERMS"):  # more questions than a pass takes
        with monkeypatch.context() as m:
            m.setattr(S, most, 1)
            assert [read(found) for found in S.lists(q, asked, chunks, _Told(count), 3)] == [read(S.bm25(q, chunks, 3)), read(S.vector(asked, stored, 3))]
    for mode in ("hybrid", "hybrid+rerank"):
        count.value = 0
        hits = S.search(q, chunks, asked, _Told(count), mode, 2)
        assert count.value <= 400 + 4 * 2 * S.CANDIDATES
        assert sorted(map(str, hits.collect())) == sorted(map(str, S.search(q, chunks, asked, stored, mode, 2).collect()))


def test_ties_are_broken_within_a_task(spark):
    """Of many equal scores a task passes on few, and those of the first chunks in corpus order."""
    best, n = S._Best(np.array([[1.0, 0.0], [0.0, 0.0]]), 5), 0
    order = np.random.default_rng(3).permutation(4000)
    for lo in range(0, 4000, 100):
        ids = pa.array([f"{i:05}" for i in order[lo : lo + 100]])
        row, query, score = best.of(np.ones((100, 2)), pa.record_batch({"chunk_id": ids, "okey": ids}))
        n += len(row)
        assert (np.diff(row) >= 0).all() and (score == np.where(query == 0, 1, 0)).all()
    assert best.keys["okey"].tolist() == [[f"{i:05}" for i in range(5)]] * 2 and n < 200


def test_hits_are_reranked_by_several_tasks(spark, tmp_path):
    from pyspark import TaskContext

    rows = [(f"c{i:03}", f"k{i:03}", "s", "", "", f"word{i % 7} beta{i % 11} common") for i in range(60)]
    chunks = cut(spark.createDataFrame(rows, CHUNKS).coalesce(1))
    q = cut(ask(spark, *(f"word{i % 7} common" for i in range(40))).coalesce(1))

    def scores(questions, passages):
        (tmp_path / str(TaskContext.get().partitionId())).touch()
        return passages.str.len().astype(float)

    assert S.search(q, chunks, E.hashing(q, "qid", "question", 64), vectors(chunks), "hybrid+rerank", reranker=scores).count() == 40 * S.TOP_K
    assert len(list(tmp_path.iterdir())) > 1
