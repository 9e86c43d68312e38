"""Ranked search, whitening and SimHash links against brute force, with their edge cases."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import jaccard, ranked_search, simhash, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(rng, n, vocabulary=300):
    return " ".join(rng.choice(["", "É", "x_"]) + f"W{int(rng.expovariate(0.02)) % vocabulary}" for _ in range(n))


# ---------------------------------------------------------------- op11


def brute_search(docs, items, k):
    terms = {i: TERM.findall(lower(t)) for i, t in docs}
    n, total = sum(1 for t in terms.values() if t), sum(map(len, terms.values()))
    df = {}
    for t in terms.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, ts in terms.items():
            m = 100 - 25 + (25 * len(ts) * n) // max(total, 1)
            s = 0
            for x in TERM.findall(lower(text)):
                tf = ts.count(x)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(x, 0) + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = [(i, words(rng, rng.choice([0, 3, 20, 60, 200]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1] or "w1 w2") for i in range(60)]  # ties
    docs += [(2000, None), (2001, " ,;\n"), (2002, words(rng, 30_000)), (2003, "w1")]
    items = [(i, words(rng, rng.choice([1, 5, 25]))) for i in range(40)] + [(90, None), (91, "..."), (92, docs[7][1] or "w1 w2"), (93, "w1 W1 w1 unseen"), (94, docs[9][1])]
    return docs, items


def test_ranked_search(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, rank string, score int").repartition(3)
    q = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank int")
    want = brute_search(docs, items, 20)
    assert sorted(map(tuple, ranked_search.search(d, q).collect())) == want
    for name, value in {"TREE_DOCS": 37, "GROUP_ITEMS": 7}.items():
        monkeypatch.setattr(ranked_search, name, value)
    # many rounds, and a floor from a sample
    assert sorted(map(tuple, ranked_search.search(d, q, sample=50, block_terms=90).collect())) == want
    assert sorted(map(tuple, ranked_search.search(d, q, k=3).collect())) == brute_search(docs, items, 3)


def test_ranked_search_of_odd_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "b")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "b a"), (7, "a"), (None, "a")], "item_id long, text string")
    got = sorted(map(tuple, ranked_search.search(d, q).collect()))
    assert [r[:3] for r in got] == [(7, 1, 1), (7, 2, 1)]  # the least text of item 7 counts, both rows of document 1 are found
    assert ranked_search.search(d.limit(0), q).collect() == [] == ranked_search.search(d, q.limit(0)).collect()


def test_trees_share_paths_and_skip(corpus):
    """Fewer scores are worked out than there are, nodes bound what is below them, and paths are shared."""
    rng = np.random.default_rng(2)
    per = rng.integers(1, 12, 900)
    term = np.concatenate([np.sort(rng.choice(40, n, replace=False, p=np.arange(40, 0, -1) / 820)) for n in per])
    tf, m = rng.integers(1, 5, len(term)).astype(np.int32), rng.integers(80, 200, 900)
    at = np.r_[0, np.cumsum(per)]
    tree = ranked_search.Tree(at, term, tf, m, np.arange(900), leaf=4)
    assert sorted(tree.doc_id) == list(range(900)) and tree.lo[0] == 0 and tree.hi[0] == 900
    leaves = [i for i, b in enumerate(tree.below) if not b]
    assert sorted(x for i in leaves for x in range(tree.lo[i], tree.hi[i])) == list(range(900))
    column, weights = np.arange(40, dtype=np.int32), rng.integers(0, 3000, (40, 3)).astype(float)
    whole = tree.dense(0, 900, column, 40)
    top, least = tree.maxima(column, 40)
    for i in range(len(tree.lo)):
        assert (top[i] == whole[tree.lo[i] : tree.hi[i]].max(axis=0)).all() and least[i] == tree.m[tree.lo[i] : tree.hi[i]].min()
    best = ranked_search.Best(np.ones(3), 5)
    scored = ranked_search.branch_and_bound(tree, np.arange(3), column, weights, best)
    every = ranked_search._gains(whole, tree.m) @ weights
    want = [(i, int(tree.doc_id[j]), int(every[j, i])) for i in range(3) for j in np.lexsort((tree.doc_id, -every[:, i]))[:5]]
    assert list(zip(*(x.tolist() for x in best.rows()))) == want
    assert scored < every.size / 2


# ---------------------------------------------------------------- op12


def check_whitening(spark, rows, most=4):
    got = whitening.whiten(spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, embedding array<float>, component string, n int").repartition(3), most).collect()
    size = max(len(v) for _, v in rows if v)
    good = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in good], np.float32).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(size, size))
    e, u = e[::-1], u[:, ::-1]
    k = min(most, size)
    assert len(got) == k * len(good)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for (i, _), row in zip(good, x):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
        for c in range(k):
            one = [r for r in by[i, c + 1] if r.deviation == deviation][0]
            assert one.n == n and one.identity_error < 1e-9
            if e[c] < 1e-9 * max(e.sum(), 1):
                assert one.whitened is None and one.explained < 1e-9
                continue
            w = float((row - s / n) @ u[:, c] / math.sqrt(e[c]))
            assert abs(abs(one.whitened) - abs(w)) < 1e-8 and abs(one.explained - e[c] / e.sum()) < 1e-12
    for c in range(k):  # either sign, the same for all rows
        if e[c] >= 1e-9 * max(e.sum(), 1):
            ratio = {round(by[i, c + 1][0].whitened / w) for (i, _), row in zip(good, x) if i is not None and len(by[i, c + 1]) == 1 and abs(w := float((row - s / n) @ u[:, c] / math.sqrt(e[c]))) > 1e-3}
            assert len(ratio) <= 1


def test_whitening(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (402, [float("nan")] * 6), (403, [0.0] * 6), (404, [0.0] * 6), (405, [1.0, 2.0]), (406, []), (407, [float("inf")] * 6), (3, rows[3][1])]
    check_whitening(spark, rows + odd)


def test_whitening_of_deficient_rank(spark):
    x = np.random.default_rng(4).normal(size=(200, 5))
    x[:, 2:] = np.round(x[:, :1] * 4) / 4 * np.array([1, 2, 0])  # the last is constant, two others go together
    x[:, 0] = x[:, 2]
    check_whitening(spark, [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)], most=5)


def test_whitening_of_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([(1, [1.0])]).limit(0)).collect() == [] == whitening.whiten(frame([(1, None), (2, [])])).collect()
    same = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    # sums of squares beyond a long
    far = whitening.whiten(frame([(i, [float(2**30 * i), 1.0]) for i in range(4)])).collect()
    assert {r.deviation for r in far} == {None} or all(r.deviation is None or r.deviation >= 0 for r in far)


def test_factor_of_a_singular_matrix():
    a = np.outer([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    r = whitening.factor(a, 10, False)
    assert np.allclose(r.T @ r, a, atol=1e-6) and np.allclose(np.tril(r, -1), 0)
    x = np.random.default_rng(0).normal(size=(7, 3))
    assert np.allclose(whitening.solved(x, r) @ r, x)


# ---------------------------------------------------------------- op13


def brute_fingerprint(text):
    w = lower(text).encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def all_near(fp):
    return [(int(i) + lo, int(j)) for lo in range(0, len(fp), 500) for i, j in zip(*np.nonzero(np.bitwise_count(fp[lo : lo + 500, None] ^ fp[None]) <= 2))]


def test_simhash(spark):
    rng = random.Random(8)
    base = [words(rng, n) for n in (1, 2, 3, 4, 40, 300, 2000)]
    rows = [None, "", " \n\t ", "one", "One", "x" * 700, *base, *[b.upper() for b in base]]
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            w[rng.randrange(len(w))] = "other"
            rows.append("\n".join(w))
    rows.append(words(rng, 90_000))  # more shingles than a lane counts
    docs = [(3 * i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in docs], "doc_id long, text string, fp string, rep int, component int").repartition(3)
    fp = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    want = {docs[i][0]: (f"{int(fp[i]):016x}", docs[c][0]) for i, c in enumerate(classes(len(docs), all_near(fp)))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.join(df).collect()} == want
    assert len({c for _, c in want.values()}) < len(want) - 20
    assert simhash.join(df.limit(0)).collect() == []


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "z"), (7, "A\tb  c d"), (7, "A\tb  c d"), (9, "z")]
    got = simhash.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    f = f"{brute_fingerprint('a b c d'):016x}"
    assert sorted(((r.doc_id, r.fingerprint, r.component_id, r.n_same) for r in got), key=repr) == sorted(
        [(None, f, None, 1), (5, f, 5, 4), (5, f, 5, 4), (7, f, 5, 4), (7, f, 5, 4), (9, f"{brute_fingerprint('z'):016x}", 9, 1)], key=repr
    )


def test_long_texts_are_hashed_in_pieces():
    text = words(random.Random(1), 500).encode()
    whole = np.concatenate(list(simhash.hashes(text)))
    for size in (1, 7, 100):
        assert (np.concatenate(list(simhash.hashes(text, size=size))) == whole).all()
    assert len(whole) == len(text.split()) - 2


@pytest.mark.parametrize("big", [1024, 15])
def test_simhash_links_of_a_dense_group(spark, big):
    """A third of all fingerprints lie about one; no link is lost whether their keys are dealt anew or not."""
    rng = random.Random(1)
    centre, found = rng.getrandbits(64), set()
    while len(found) < 1000:
        x = centre
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    while len(found) < 3000:
        found.add(rng.getrandbits(64))
    fp = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(fp.view(np.int64))], "fp long, rep long")
    edges = [(r.a, r.b) for r in simhash.links(df, big=big).collect()]
    assert classes(len(fp), edges) == classes(len(fp), all_near(fp))
    at = {r.id: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [at.get(i, i) for i in range(len(fp))] == classes(len(fp), edges)


def test_pivot_bound():
    """Fingerprints that differ in two bits or fewer differ by so much in no coordinate, and agree in two of four pairs of bytes."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    assert np.abs(simhash.distances(a).astype(int) - simhash.distances(b).astype(int)).max() <= 2
    agree = (simhash._byte_codes(a) == simhash._byte_codes(b)).reshape(-1, 4, 2).all(axis=2).sum(axis=1)
    assert agree.min() >= 2
    assert len(np.unique(simhash._byte_codes(np.arange(256, dtype=np.uint64))[:, 0])) == 256
