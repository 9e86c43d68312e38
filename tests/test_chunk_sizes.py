"""Chunks of several sizes from one pass: as ranges of words, their vectors as differences, their lists beside plain searches."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.functions import words as W
from lodestone.operators import ablation as B
from lodestone.operators import chunking as C
from lodestone.operators import embed as E
from lodestone.operators import evaluate as V
from lodestone.operators import retrieve as S

_PARTS = ["a", "B", "é", "..", ".", "!", "? ", "  ", "\n", "\n\n", " \n \n ", " word", "(x", '"q', "_", "　", "\x1c", "İ", "-" * 8, "'", "\x85", "\U0001f600", " Ab c. ", " d e"]


def _cut(texts, variants):
    b = pa.record_batch({"text": pa.array(texts), "heading": pa.array([""] * len(texts)), "kind": pa.array(["section"] * len(texts))})
    return [f for _, _, found in C.stretches(b, variants) for f in found]


def test_chunks_as_ranges_are_those_of_pack(monkeypatch):
    r = random.Random(3)
    for at_once in (1 << 19, 40):
        monkeypatch.setattr(C, "AT_ONCE", at_once)
        for _ in range(300):
            texts = ["".join(r.choice(_PARTS) for _ in range(r.randrange(50))) for _ in range(6)] + [None, " \n\n "]
            m = r.randrange(1, 14)
            variants = {"a": (m, r.randrange(m)), "b": (30, 7)}
            for text, got in zip(texts, _cut(texts, variants), strict=True):
                for v, how in variants.items():
                    assert [(c.text, c.n_tokens) for c in got[v]] == [(t, C.count_tokens(t)) for t in C.pack(text or "", *how)]
    monkeypatch.setattr(C, "pack", None)  # plain texts don't take it: their tokens are counted once for all sizes
    got = _cut(["One two, three. " * 9 + "four " * 40 + ". Five."], {"a": (12, 3), "b": (30, 7)})[0]
    assert all(c.spans and c.n_tokens <= 30 for v in got.values() for c in v)


def test_vectors_of_ranges(monkeypatch):
    """Rows of overlapping, repeated and joined ranges have the vectors of their terms."""
    r, names = np.random.default_rng(1), [*(f"w{i}" for i in range(20)), "a", "long" * 20]
    for n_terms, rows, at_once in ((0, 30, 4), (1, 7, 3), (150, 30, 4), (150, 9, 20)):
        monkeypatch.setattr(E, "ROWS", rows)
        monkeypatch.setattr(E, "ROWS_AT_ONCE", at_once)
        code, own, ranges = r.integers(0, 22, n_terms), [], []
        for i in range(40):
            some = [x for x in (sorted(r.integers(0, n_terms + 1, 2).tolist()) for _ in range(r.integers(0, 4))) if x[0] < x[1]]
            own.append([names[c] for lo, hi in some for c in code[lo:hi]])
            ranges += [(i, lo, hi) for lo, hi in some]
        t = W.Terms(0, 1, np.array([0, n_terms]), code.astype(np.int32), pa.array(names))
        got = E.of_ranges(t, E.Ranges(40, *np.array(ranges, np.int64).reshape(-1, 3).T))
        want = [E.unit(x) for some in W.of_lists(pa.array(own, pa.list_(pa.string()))) for _, x in E._vectors(some, E.DIM)]
        np.testing.assert_allclose(np.concatenate([x for _, x in got]), np.concatenate(want), atol=1e-12)


def test_terms_of_characters():
    texts = ["The Cats' studies", "of", "the bus 3.14 É.x Ab", "", "glasses.", "3 x"]
    t, start = W.of_characters(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(x) for x in texts])])
    assert t.lists().to_pylist() == [x for some in W.of_texts(pa.array([x.lower() for x in texts])) for x in some.lists().to_pylist()]
    assert "".join(texts)[start[0] : start[0] + 4] == "Cats"


def test_repeats_are_among_a_tasks_best_once():
    """A task that meets nine repeats of the best chunk still passes on the others; of repeats the first in corpus order stays."""
    x = np.array([[1.0, 0.0]] * 9 + [[0.6, 0.8], [0.5, 0.8], [0.4, 0.8]])
    okey = [f"{9 - i}" for i in range(9)] + ["a", "b", "c"]
    rows = pa.record_batch({"okey": pa.array(okey), "chunk_id": pa.array(["same"] * 9 + ["p", "q", "r"])})
    for step in (12, 1, 5):
        best, kept = S._Best(np.array([[1.0, 0.0]]), 3), set()
        for lo in range(0, 12, step):
            row, _, _ = best.of(x[lo : lo + step], rows.slice(lo, step))
            kept |= {okey[lo + i] for i in row}
        assert {"1", "a", "b"} <= kept and list(best.keys["chunk_id"][0]) == ["same", "p", "q"]


def _sections(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.exponential(12))}"
    some = lambda n: " ".join(word() + (". A" if rng.random() < 0.1 else "") for _ in range(n))
    rows = [(f"s/{i % 6}", f"Head w{i % 3}" if i % 4 else None, some(int(rng.integers(0, 90))), "faq" if i % 7 == 3 else "section", i) for i in range(40)]
    rows += [("s/1", "", "w1 w2 w3. Same text w4", "section", 50 + i) for i in range(30)]  # repeats, in several tasks
    rows += [("s/2", "", "w1 w2 w3 " * 30, "section", 90), ("s/3", "odd", "W1 \x1cw2 İw3 " + "-" * 60 + "w2", "section", 91), ("s/4", "", None, "section", 92), (None, "", "w1 w5", "section", 93)]
    return spark.createDataFrame(rows, "source string, heading string, text string, kind string, section_no int").repartition(5)


def _plain(sections, size, overlap):
    return C.distinct_chunks(C.with_ids(C.chunk_sections(sections, size, overlap, lambda t: C.count_tokens(t)))).withColumn("title", F.lit(""))


def _rows(df, *names):
    return sorted((tuple(r[n] for n in names) + (round(r.score, 8),) for r in df.collect()), key=repr)


def test_lists_of_all_sizes_are_those_of_plain_searches(spark, monkeypatch):
    """Headings, question and answer, odd texts, and repeats over sections in several tasks; neither terms nor vectors are written."""
    sections, sizes = _sections(spark), {"8": (8, 2), "20": (20, 5)}
    q = spark.createDataFrame([(1, "w1 w2 w3"), (2, "head w5 w9"), (3, "zzz"), (4, "w0 w1 w2 w4 same")], "qid int, question string")
    written, cut = [], B.cut
    monkeypatch.setattr(B, "cut", lambda df: (written.append(df.columns), cut(df))[1])
    got = B.lists(sections, q, sizes, 6)
    assert not any({"terms", "vec", "text"} & set(c) for c in written)
    monkeypatch.setattr(S, "AT_ONCE", 1)
    for chunks, lexical, dense in (got, B.lists(sections, q, sizes, 6)):
        for size, how in sizes.items():
            c, own = _plain(sections, *how).cache(), F.col("variant") == size
            ids = ("chunk_id", "okey", "source", "heading")
            assert sorted((tuple(r) for r in chunks.filter(own).select(*ids).collect()), key=repr) == sorted((tuple(r) for r in c.select(*ids).collect()), key=repr)
            assert _rows(lexical.filter(own), "qid", "rank", "chunk_id") == _rows(S.bm25(q, c, 6), "qid", "rank", "chunk_id")
            vectors = E.Hashing(S.search_text)(c)
            assert _rows(dense.filter(own), "qid", "rank", "chunk_id") == _rows(S.vector(E.hashing(q, "qid", "question"), vectors, 6), "qid", "rank", "chunk_id")


def test_chunk_size_ablation_reads_texts_once_for_all_sizes(spark, monkeypatch):
    """The report is that of plain searches of each size's own chunks; no size writes its terms, texts of hits only are written."""
    rng = np.random.default_rng(9)
    docs = [(i, f"s{i % 3}", " ".join(f"w{int(rng.exponential(40))}" + ("." if rng.random() < 0.1 else "") for _ in range(int(rng.integers(0, 300))))) for i in range(30)] + [(99, "s", None)]
    asked = [(i, " ".join(t.split()[5:11])) for i, _, t in docs[:12] if t and len(t.split()) > 11] + [(90, "zzz w1"), (91, " ")]
    t = {"documents": spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3), "benchmark": spark.createDataFrame(asked, "item_id long, text string")}
    written, cut = [], Q.cut
    monkeypatch.setattr(Q, "_t", lambda spark, d, name: t[name])
    for m in (Q, B):
        monkeypatch.setattr(m, "cut", lambda df: (written.append((df.columns, out := cut(df))), out)[1])
    got = {r.chunk_tokens: tuple(r)[1:] for r in Q.chunk_size_ablation(spark, "").collect()}
    assert not any({"terms", "vec"} & set(c) for c, _ in written)
    (texts,) = [df for c, df in written if "text" in c]
    assert texts.count() < sum(r[-1] for r in got.values())  # not all chunks
    q, asked = Q.questions(spark, ""), E.hashing(Q.questions(spark, ""), "qid", "question")
    for size in (60, 400):
        c = _plain(Q._sections(spark, ""), size, min(30, size // 4)).cache()
        h = S.search(q, c, asked, E.Hashing(S.search_text), "hybrid", 5).join(c.select("chunk_id", "source"), "chunk_id")
        want = V.retrieval_report(h.withColumn("mode", F.lit("m")), Q.gold(spark, ""), spark.createDataFrame([("m",)], "mode string")).first()
        assert got[str(size)] == (*tuple(want)[1:], c.count()) and want.questions > 3
