"""Passages of very many documents, each in other surroundings: the split forms give the same rows, and no task has them all."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, debruijn, jaccard, substring


def texts_around(line, n, words, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    return [(i, " ".join([word() for _ in range(words)] + [line] + [word() for _ in range(words)])) for i in range(n)]


LINE = " ".join(f"licence{i} clause" for i in range(24))


@pytest.fixture(scope="module")
def mixed():
    """Passages in other surroundings, copies of whole texts, a text that repeats itself, short and missing ones."""
    rows = texts_around(LINE, 60, 12, 1) + [(100 + i, t) for i, t in texts_around(LINE + " tail one", 30, 9, 2)]
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (202, f"{LINE} {LINE}"), (203, None), (204, ""), (205, "few words"), (206, LINE)]


def brute_bytes(rows, length):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(x[p : p + length] for x in raw.values() for p in range(len(x) - length + 1))
    return {i: {p + k for p in range(len(x) - length + 1) if seen[x[p : p + length]] > 1 for k in range(length)} for i, x in raw.items()}


@pytest.mark.parametrize("hot", [0, 5, substring.HOT])
@pytest.mark.parametrize("few", [0, 40])
def test_bytes_of_frequent_anchors(spark, mixed, hot, few):
    docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in substring.repeats(docs, 60, hot, few).collect():
        got[r.doc_id].update(range(r.lo, r.hi))
    assert {i: got[i] for i, _ in mixed} == brute_bytes(mixed, 60)


def brute_words(rows):
    words, first = {i: (t or "").split() for i, t in rows}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][p : p + 13]), i)
    return {(i, p) for i, w in words.items() for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i}, words


@pytest.mark.parametrize("hot", [0, 5, debruijn.HOT])
@pytest.mark.parametrize("few", [0, 40])
def test_words_of_frequent_anchors(spark, mixed, hot, few):
    docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    found = debruijn.pieces(docs, hot=hot, few=few).cache()
    edges = found.select("doc_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("e"), (F.col("src_lo") - F.col("lo")).alias("shift"), "src_doc").collect()
    want, words = brute_words(mixed)
    assert len(edges) == len(want) and {(r.doc_id, r.e) for r in edges} == want
    for r in edges:
        at = r.e + r.shift
        assert r.src_doc < r.doc_id and words[r.src_doc][at : at + 13] == words[r.doc_id][r.e : r.e + 13]
    spans = debruijn.paths(found)
    assert debruijn.verified(spans, docs, 13).count() == spans.count()


def test_frequent_keys_are_never_missed(spark):
    """A key that each task sees rarely but all see is told of; rare keys aren't, whatever the tasks' shares."""
    docs = spark.range(0, 9000, 1, 7).select(F.col("id").alias("doc_id"))

    def keys(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy().astype(np.uint64)
            yield np.r_[common.mix(ids), np.full(len(ids[ids % 9 == 0]), 5, np.uint64)]

    heavy = common.key_bucket(np.array([5], np.uint64)).tolist()
    assert common.frequent(docs, keys, 100).tolist() == heavy
    assert common.frequent(docs, keys, 1000).tolist() == []
    assert common.frequent(docs.filter("doc_id < 0"), keys, 0).tolist() == []


@pytest.mark.parametrize("part", ["bytes", "words"])
def test_no_task_has_a_frequent_anchor_alone(spark, part):
    """6,000 texts with one line, all else distinct: entries by bucket stay close together, and are far apart when not split."""
    docs = spark.createDataFrame(texts_around(LINE, 6000, 20, 3), "doc_id long, text string").repartition(4)
    find, counted, args = (substring._find_anchors, substring._counted, (200,)) if part == "bytes" else (debruijn._find_pieces, debruijn._counted, (13, 7))

    def by_bucket(often):
        dealt = docs.mapInArrow(find(*args, 16, often), common.dealt_schema(7))
        return sorted(r[0] for r in dealt.groupBy("bucket").agg(F.sum(F.length("c0") / 8).alias("n")).select("n").collect())

    often = common.frequent(docs, counted(*args))
    whole, split = by_bucket(np.zeros(0, np.int64)), by_bucket(often)
    assert 0 < len(often) < 64 and sum(whole) == sum(split)
    assert split[-1] < 1.3 * split[len(split) // 2] and whole[-1] > 1.8 * whole[len(whole) // 2]


@pytest.mark.parametrize("ways", [1, 2, 5, 64])
def test_any_two_entries_of_a_list_meet_in_one_cell(monkeypatch, ways):
    """A split list's cells hold each pair once, of two groups or in one; a list that isn't split keeps its shingle."""
    monkeypatch.setattr(jaccard, "STEP", 40)
    n = 30
    cols = [np.r_[np.full(n, 7, np.uint64), np.uint64(9)], np.arange(n + 1), np.zeros(n + 1, np.int64), np.arange(n + 1, dtype=np.int32), np.arange(n + 1, dtype=np.int32)]
    got = [np.concatenate(c) for c in zip(*jaccard.celled(cols, np.r_[np.full(n, ways), 1]))]
    met = collections.Counter()
    for cell in np.unique(got[0]):
        at = np.flatnonzero(got[0] == cell)
        for p in at:
            met.update((int(got[1][p]), int(got[1][q])) for q in at if got[1][p] < got[1][q] and (got[5][p] == 0 or got[5][p] != got[5][q]))
    assert met == {(i, j): 1 for i in range(n) for j in range(i + 1, n)}
    assert got[0][got[1] == n].tolist() == [9] and len(got[0]) == n * ways + 1
    assert ways > 1 or set(got[0].tolist()) == {7, 9}
    assert (got[3] == got[1]).all() and (got[4] == got[1]).all()


def test_jaccard_of_frequent_shingles(spark):
    """Short texts around one passage share its shingles whatever they are ordered by: the same rows with lists split and whole."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [f"clause{i}" for i in range(26)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(0, 6))] + passage[rng.randrange(0, 3) :] + [word() for _ in range(rng.randrange(0, 6))])) for i in range(240)]
    rows += [(300, rows[4][1]), (301, rows[4][1]), (302, None), (303, "two words")]
    sets = {i: frozenset(zip(*[(t or "").split()[j:] for j in range(5)])) or (frozenset([tuple(t.split())]) if t else frozenset()) for i, t in rows}
    link = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in sets}
    comp = {}
    for i in sorted(sets):
        if i not in comp:
            todo, comp[i] = [i], i
            while todo:
                new = [j for j in link[todo.pop()] if j not in comp]
                comp.update(dict.fromkeys(new, i))
                todo += new
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read = lambda **o: {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, links=False, **o).collect()}
    want = {i: (len(sets[i]), comp[i]) for i in sets}
    assert len(set(comp.values())) > 3 and len([i for i in sets if link[i]]) > 60
    assert read() == want == read(part=7, few=10)


def test_no_task_has_a_frequent_list_alone(spark):
    docs = spark.createDataFrame([(i, f"w{i} {LINE} v{i}") for i in range(3000)], "doc_id long, text string").repartition(4).select("doc_id", "text", F.col("doc_id").alias("leader"))
    load = spark.sparkContext.broadcast(np.zeros(1 << 20, np.uint32))
    often = common.frequent_counts(docs, jaccard._counted(5, 75, load, 20), 500)
    assert 3000 <= max(often.values()) < 3200 and min(often.values()) > 500
    most = []
    for hot in ({}, often):
        dealt = docs.mapInArrow(jaccard._postings(5, 75, 64, load, 20, hot, 300), common.dealt_schema(6))
        per = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), (F.length("c0") / 8 - 1).cast("int")), lambda i: F.hex(F.substr("c0", i * 8 + 1, F.lit(8))))).alias("tok"))
        most.append(per.groupBy("tok").count().agg(F.max("count")).first()[0])
    assert most[0] == 3000 and most[1] < 900
