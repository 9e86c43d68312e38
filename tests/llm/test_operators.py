"""Operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, debruijn, jaccard, mixing, pii, quality_classifier, quality_rules, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ',', 'é'])}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [None, "", " \n ", "one", "One TWO", "x" * 700, "a" * 450 + "\n" + "a" * 260]
    base = [text_of(rng, n) for n in (60, 80, 120, 200, 400, 3000)]
    passage = text_of(rng, 70)
    for b in base:
        out += [b, b, b.upper()]
        w = b.split(" ")
        for k in range(3):
            v = list(w)
            for _ in range(1 + 3 * k):
                v[rng.randrange(len(v))] = f"new{rng.randrange(1000)}"
            out.append(" ".join(v))
        out.append(" ".join(w[:20]) + "\n" + passage + "\n" + text_of(rng, 30))
    out += [text_of(rng, 40) + " " + passage for _ in range(8)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s1", len(t or ""), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long")
    return d.repartition(3)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_components(rows, k=5, percent=75):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == brute_components(rows)
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_counts_all_links_of_near_copies(spark):
    """Groups of near copies, some drifting so that there are several leaders, some led by others; one in three texts comes twice."""
    rng = random.Random(17)
    out = []
    for size, edits in ((620, 2), (150, 5), (60, 9)):
        base = text_of(rng, 130).split(" ")
        for i in range(size):
            v = list(base)
            for _ in range(rng.randrange(edits + 1)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(40)}"
            out.append(" ".join(v))
            if size < 600 and i % 12 == 0:
                base[rng.randrange(len(base))] = f"drift{i}"
    out += out[::3] + [text_of(rng, 50) for _ in range(5)]
    rng.shuffle(out)
    sets = []
    for t in out:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)))
    distinct = list(set(sets))
    want = collections.Counter()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= 75 * len(a | b):
                want.update((a, b))
    got = {r.doc_id: r.n_links for r in jaccard.join(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)).collect()}
    assert max(want.values()) > 300 and got == {i: want[s] for i, s in enumerate(sets)}


def test_jaccard_lists_are_complete():
    """Blocks and shifts give every pair of a long list that no bound rules out."""
    rng = np.random.default_rng(1)
    n = 700
    x = {"tok": np.repeat(np.array([5, 9], np.uint64), n // 2), "n": rng.integers(20, 60, n), "pos": rng.integers(0, 6, n), "id": rng.permutation(n), "lead": rng.integers(1000, 1020, n)}
    o = np.lexsort((x["id"], x["pos"], x["n"], x["tok"]))
    x = {k: v[o] for k, v in x.items()}
    got = {(a, b) for i, j in jaccard.list_pairs(x, 75) for a, b in zip(i.tolist(), j.tolist())}
    i, j = np.triu_indices(n, 1)
    same = x["tok"][i] == x["tok"][j]
    i, j = i[same], j[same]
    hit = jaccard._maybe(x, i, j, 75)
    assert got == set(zip(i[hit].tolist(), j[hit].tolist()))


def encoder():
    import public_tokenizers as P

    return bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_bpe_tree(leaf):
    enc, size, _ = encoder()
    rng = random.Random(leaf)
    alphabet = list("ab '\n\t.,!éß  1234  \x1c") + ["'s", "'ll", "漢字", "🙂", "   ", "\r\n"]
    for n in (0, 1, 5, 60, 400):
        for _ in range(8):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            ids = bpe.encode(t, enc, size, leaf)
            assert ids == enc.encode_ordinary(t) and bpe.decode(ids, enc, leaf) == t.encode()


def test_bpe_windows_at_every_seam():
    """The settled places that windows use are found in order from either end, and long texts without any still join."""
    text = "ab cd  ef\n\ngh i" * 40 + "x" * 300 + " yz"
    want = [m.end() for m in bpe._SEAM.finditer(text)]
    assert list(bpe._settled_before(text)) == [*reversed(want), 0] and list(bpe._settled_after(text)) == [*want, len(text)]
    enc, size, _ = encoder()
    for t in ("a" * 5000, "é漢" * 3000, " " * 5000, "0" * 3000 + " " + "-=" * 2000):
        assert bpe.encode(t, enc, size) == enc.encode_ordinary(t)


def test_bpe_documents(docs, rows):
    enc, _, _ = encoder()
    got = {r.doc_id: r for r in bpe.production(docs).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.raw) for r in back.collect()} == {i: (t or "").encode() for i, t in rows}


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[50]
    vecs = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None] * 8), (1080, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 20 = 0").select("vec_id")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(400), -s.round(9))) if i != q][:20]
        assert [s[i] for i, _ in found] == pytest.approx([v for _, v in found]) and len(found) == 20
        hits += len(set(want) & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(df.limit(0), df.select("vec_id")).count() == 0
    few = df.filter("vec_id < 3")
    assert [r.vec_id for r in ann.search(few, few.filter("vec_id = 0").select("vec_id")).orderBy("rank").collect()] and ann.search(few, few.select("vec_id")).count() == 6


def ann_recall(spark, x, k=20, step=20, **options):
    """Recall against brute force, and the number of rows of each query."""
    df = spark.createDataFrame([(i, v.tolist(), "z", 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rep string, n int, cell int").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.search(df, df.filter(f"vec_id % {step} = 0").select("vec_id"), **options).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits, sizes = 0, []
    for q in range(0, len(x), step):
        found = sorted(got[q])
        s = x.astype(float) @ x[q].astype(float)
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and np.allclose([v for _, _, v in found], s[[i for _, i, _ in found]])
        s[q] = -np.inf
        hits += len({i for _, i, _ in found} & set(np.argsort(-s)[:k].tolist()))
        sizes.append(len(found))
    return hits / (k * len(sizes)), set(sizes)


@pytest.mark.parametrize("clusters", [20, 150])
def test_ann_of_many_more_vectors_than_the_sample_in_small_clusters(spark, clusters):
    """Vectors 30 times the sample, clusters of 5 and of 0.7 %: every query has its 20 rows, and nearly all are right."""
    rng = np.random.default_rng(clusters)
    x = (rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 15_000)] + 0.3 * rng.normal(size=(15_000, 32))).astype(np.float32)
    recall, sizes = ann_recall(spark, x, step=300, sample=500)
    assert sizes == {20} and recall >= 0.9


def test_ann_of_a_hot_vector_and_a_hot_cell(spark, monkeypatch):
    """A third of all rows are one vector, another third lie in one cell, which is dealt over many tasks."""
    monkeypatch.setattr(ann, "SHARE", 100)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[:1000] = x[0]
    x[1000:2000] = x[0] + 0.01 * rng.normal(size=(1000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 100 = 0").select("vec_id")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.score)
    assert set(got) == set(range(0, 3000, 100)) and {len(v) for v in got.values()} == {20}
    right = []
    for q, found in got.items():
        s = np.delete(x.astype(float) @ x[q].astype(float), q)
        right += [v >= np.sort(s)[-20] - 1e-9 for v in found]
    assert np.mean(right) >= 0.9


def test_ann_searches_again_what_the_codes_lost(spark, monkeypatch):
    """Without any slack the bound rules out vectors with poor codes; queries left with too few are searched anew."""
    monkeypatch.setattr(ann, "SLACK", -30.0)
    x = np.random.default_rng(7).normal(size=(2000, 16)).astype(np.float32)
    assert ann_recall(spark, x, step=100)[1] == {20}


def test_ann_recall_with_few_kept(spark):
    """Many more vectors than are kept, without clusters and with a dense one: recall against brute force."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(6000, 32))
    x[1000:3000] = x[0] + 0.25 * rng.normal(size=(2000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(set)
    for r in ann.search(df, df.filter("vec_id % 60 = 0").select("vec_id")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -9
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits >= 0.9 * 2000


def test_mixing(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "de", None]), "s0" if i % 3 == 0 else f"s{rng.randrange(12)}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long")
    slim = mixing.leaves(df).collect()
    total = sum(r.tokens for r in slim)
    plan = mixing.budgets(mixing.leaves(df).groupBy(*mixing.LEVELS).agg(F.sum("tokens").alias("tokens")), 0.9, 2).collect()
    assert all(p.budget <= 2 * p.tokens for p in plan) and 0.9 * total - len(plan) * 3 <= sum(p.budget for p in plan) <= 0.9 * total
    got = collections.defaultdict(list)
    for r in mixing.mix(df, fraction=0.9).collect():
        got[r.domain, r.lang, r.source].append(r)
    largest = max(r.tokens for r in slim)
    for p in plan:
        taken = sum(r.tokens for r in got[p.domain, p.lang, p.source])
        assert taken <= p.budget and (p.budget == 0 or taken > p.budget - largest - 1)
    again = {(r.doc_id, r.epoch) for r in mixing.mix(df.repartition(7), fraction=0.9).collect()}
    assert again == {(r.doc_id, r.epoch) for v in got.values() for r in v}
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df).columns == df.columns


def test_budgets_by_a_water_filling_loop(spark):
    """Each family is filled by hand: children whose cap is within their share are full and leave, until none does."""
    rng = random.Random(31)
    leaves_ = [(f"d{rng.randrange(4)}", rng.choice(["en", "de", "fr", "xx"]), f"s{i}", rng.choice([0, 3, 50, 1000, 20000])) for i in range(60)]
    weights = {"domain": {"d0": 4.0, "d1": 1.0, "d2": 0.0, "d3": -2.0}, "lang": {"en": 3.0}}
    df = spark.createDataFrame(leaves_, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, 0.5, 2, weights).collect()}

    def fill(path, poured):
        if len(path) == 3:
            return {path: poured}
        under = sorted({x[: len(path) + 1] for x in leaves_ if x[: len(path)] == path})
        cap = {c: 2 * sum(x[3] for x in leaves_ if x[: len(c)] == c) for c in under}
        w = {c: max(weights.get(mixing.LEVELS[len(path)], {}).get(c[-1], 1.0), 0.0) for c in under}
        share, active, left = dict.fromkeys(under, 0), [c for c in under if w[c] > 0], poured
        while full := [c for c in active if cap[c] <= left * w[c] / sum(w[x] for x in active)]:
            for c in full:
                share[c] = cap[c]
            left -= sum(cap[c] for c in full)
            active = [c for c in active if c not in full]
        for c in active:
            share[c] = min(cap[c], int(left * w[c] / sum(w[x] for x in active)))
        return {k: v for c in under for k, v in fill(c, share[c]).items()}

    assert got == fill((), int(sum(x[3] for x in leaves_) * 0.5))


def test_prefix_of_a_leaf_by_hand(spark):
    """One leaf, few and many ranges: the same documents as an order by draw and a running sum give."""
    rows = [(i, " ".join(["w"] * (i % 7)), "en", "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    total = sum(i % 7 for i in range(500))
    plan = mixing.budgets(mixing.leaves(df).groupBy(*mixing.LEVELS).agg(F.sum("tokens").alias("tokens")), 0.4).collect()[0]
    place = lambda i: int(hashlib.md5(f"{mixing.SEED}:0:{i}".encode()).hexdigest()[:15], 16)
    want, used = set(), 0
    for i in sorted(range(500), key=lambda i: (place(i), i)):
        used += i % 7
        if used > plan.budget:
            break
        want.add(i)
    slim, per = mixing.leaves(df), spark.createDataFrame([plan])
    for bits in (1, 4, 8):
        assert {r.doc_id for r in mixing.chosen(slim, per, bits=bits).collect()} == want and plan.budget == int(total * 0.4)


def test_pour_gives_siblings_first(spark):
    n = spark.createDataFrame([("d", "a", 10, 1.0, 100), ("d", "b", 500, 1.0, 100), ("d", "c", 500, 2.0, 100), ("e", "a", 5, 0.0, 50)], "domain string, lang string, cap long, w double, poured long")
    got = {(r.domain, r.lang): r.budget for r in mixing._pour(n, ["domain"]).collect()}
    assert got == {("d", "a"): 10, ("d", "b"): 30, ("d", "c"): 60, ("e", "a"): 0}


def brute_bytes(rows, length):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(x[p : p + length] for x in raw.values() for p in range(len(x) - length + 1))
    out = {}
    for i, x in raw.items():
        mark = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(x, mark) if not m)
        out[i] = (len(x), len(x) - len(kept), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [200, 24])
def test_substring(docs, rows, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.dedup(docs, length).collect()}
    assert got == brute_bytes(rows, length)


def test_substring_of_hot_anchors(docs, rows):
    """Anchors with more contexts than one task takes go by windows; the result is the same."""
    by = lambda f: {(r.doc_id, r.lo, r.hi) for r in f.collect()}
    for length in (24, 60):
        want = brute_bytes(rows, length)
        for hot in (0, 3):
            got = collections.defaultdict(list)
            for i, lo, hi in by(substring.repeats(docs, length, hot)):
                got[i].append((lo, hi))
            for i, t in rows:
                raw = (t or "").encode()
                mark = bytearray(len(raw))
                for lo, hi in got[i]:
                    mark[lo:hi] = b"\1" * (hi - lo)
                assert sum(mark) == want[i][1]


def test_anchors_of_long_texts_in_steps(monkeypatch):
    """Steps choose the anchors that one pass would."""
    from lodestone.llm import common

    rng = np.random.default_rng(5)
    h = common.mix(rng.integers(0, 300, 5000).astype(np.uint64))  # many ties
    valid = rng.random(5000 - 9) < 0.9
    whole = common.anchors(h, 10, valid)
    monkeypatch.setattr(common, "STEP", 64)
    assert whole.tolist() == common.anchors(h, 10, valid).tolist()
    buf = rng.integers(97, 123, 9000).astype(np.uint8)
    buf[rng.integers(0, 9000, 900)] = 32
    t = common.Texts(np.array([1, 2]), buf, np.array([0, 4000, 9000]))
    small = common.Words(t).hash
    monkeypatch.setattr(common, "STEP", 1 << 18)
    assert small.tolist() == common.Words(t).hash.tolist()


def test_interval_expansion_of_a_hot_passage():
    """Many contexts that share a middle of varying width."""
    rng = np.random.default_rng(4)
    length, m = 20, 300
    wide = rng.integers(1, 3, (m, 30)).astype(np.uint8)
    wide[:, 10:20] = 7
    full = np.full(m, 10, np.uint16)
    least, most = substring.expand(np.zeros(m, np.uint64), full, full + 10, wide, length)
    for i in range(m):
        ds = [d for d in range(11) if any((wide[i, 10 - d : 30 - d] == wide[j, 10 - d : 30 - d]).all() for j in range(m) if j != i)]
        assert (least[i], most[i]) == ((ds[0], ds[-1]) if ds else (length, -1))


def test_debruijn(docs, rows):
    words, first = {i: WORD.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][p : p + 13]), i)
    want = {}
    for i, w in words.items():
        mark = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                mark[p : p + 13] = [True] * 13
        kept = [x for x, m in zip(w, mark) if not m]
        want[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.dedup(docs).collect()} == want
    spans = debruijn.paths(debruijn.pieces(docs)).cache()
    n = spans.count()
    assert debruijn.verified(spans, docs, 13).count() == n and spans.filter("hi - lo >= 60").count() > 0
    # a span of other words than its source's doesn't survive
    wrong = spans.unionByName(spans.filter("lo > 0 and hi - lo >= 60").withColumn("lo", F.col("lo") - 1).withColumn("hi", F.col("hi") - 1))
    assert wrong.count() > n == debruijn.verified(wrong, docs).count()
    # each edge is in one piece, and neighbours that run in step through one source are one path
    edges = debruijn.pieces(docs).select("doc_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("e"))
    assert edges.count() == edges.distinct().count()
    assert spans.alias("a").join(spans.alias("b"), F.expr("a.doc_id = b.doc_id and a.src_doc = b.src_doc and a.lo - a.src_lo = b.lo - b.src_lo and a.hi - 12 = b.lo")).count() == 0


def test_quality_counts(docs, rows):
    got = {r.doc_id: r for r in quality_rules.judge(docs.unionByName(docs.limit(0)), quality_rules.DEFAULT).collect()}
    for i, t in rows:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        rep = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)
    assert quality_rules.keep(docs, quality_rules.DEFAULT).columns == docs.columns
    assert {r.doc_id for r in quality_rules.keep(docs, quality_rules.DEFAULT).collect()} == {i for i, r in got.items() if r.kept}


def test_viterbi_and_marginals():
    import itertools

    rng = np.random.default_rng(6)
    k = len(quality_rules.FEATURES)
    model = {"emit": rng.normal(size=(2, k)).tolist(), "move": rng.normal(size=(2, 2)).tolist(), "start": [0.3, -0.2]}
    at, xs = [0], []
    for n in (5, 0, 1, 7, 3):
        xs.append(rng.normal(size=(n, k)))
        at.append(at[-1] + n)
    whole = quality_rules.decode_all(np.concatenate(xs), np.array(at), model)
    p, pair = quality_rules.marginals(np.concatenate(xs) @ np.array(model["emit"]).T, np.array(at), model)
    for i, x in enumerate(xs):
        e = x @ np.array(model["emit"]).T
        value = lambda y: sum(e[j, c] for j, c in enumerate(y)) + (model["start"][y[0]] if y else 0) + sum(model["move"][a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        every = list(itertools.product((0, 1), repeat=len(x)))
        best = max(every, key=value)
        assert whole[at[i] : at[i + 1]].tolist() == list(best) == quality_rules.viterbi(x, model).tolist()
        z = sum(np.exp(value(y)) for y in every)
        for j in range(len(x)):
            assert p[at[i] + j, 1] == pytest.approx(sum(np.exp(value(y)) for y in every if y[j] == 1) / z)
            if j:
                assert pair[at[i] + j, 0, 1] == pytest.approx(sum(np.exp(value(y)) for y in every if (y[j - 1], y[j]) == (0, 1)) / z)


def test_line_labels_are_latent():
    """Good documents with boilerplate at their end and bad ones with a clean line: lines get their own labels."""
    rng = np.random.default_rng(8)
    k = len(quality_rules.FEATURES)

    def lines(kinds):
        x = np.zeros((len(kinds), k))
        x[:, 0] = 1
        x[:, 1] = np.where(np.array(kinds) == 1, 0.8, 0.02) + rng.normal(0, 0.02, len(kinds))
        return x, np.full(len(kinds), 50, np.int32)

    got = []
    for _ in range(60):
        got.append((*lines([0] * 8 + [1] * 3), quality_rules.CONTENT))
        got.append((*lines([1] * 7 + [0]), quality_rules.BOILERPLATE))
    model = quality_rules.learn(got)
    assert quality_rules.viterbi(lines([0, 0, 0, 0, 1, 1, 1])[0], model).tolist() == [0, 0, 0, 0, 1, 1, 1]
    assert quality_rules.viterbi(lines([1, 1, 1, 1, 1, 1, 0])[0], model).tolist()[:6] == [1] * 6


def test_quality_verdict_on_documents_that_it_did_not_learn_from(spark):
    """Half of the labelled documents of the given tables teach, the other half tests."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels.filter("doc_id % 2 = 0"))
    assert model["source"] == "fitted"
    got = quality_rules.judge(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    right = {q: [r.kept == bool(q) for r in got if r.quality == q] for q in (0, 1)}
    assert len(right[0]) > 10 and len(right[1]) > 100 and all(np.mean(v) >= 0.95 for v in right.values())


def test_fitting_sees_lines_beyond_any_prefix(spark):
    """The lines that tell good from bad stand after a thousand others."""
    rng = random.Random(19)
    clean = [text_of(rng, 9) + "." for _ in range(40)]
    head = [rng.choice(clean) + str(i) for i in range(1000)]
    rows = [(i, "\n".join(head[:1000] + ([text_of(rng, 9) + "." for _ in range(1500)] if i % 2 else ["### $$$ | | %%%" + str(j) for j in range(1500)]))) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).filter("kept").collect()}
    assert kept == {i for i in range(16) if i % 2}


JUNK = ["###", "word*** this&&& that%%%", "a | b | c | d |", "SHOUT!! LOUD!! MORE!!"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        rows.append((i, "\n".join(text_of(rng, 12) + "." if good else " ".join(rng.choice(JUNK) for _ in range(6)) for _ in range(8))))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_trained_rules_and_classifier(labelled):
    docs, labels = labelled
    kept = {r.doc_id for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).filter("kept").collect()}
    assert kept == {i for i in range(240) if i % 3 > 0}
    model = quality_classifier.train(docs, labels, 200)
    got = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    import zlib

    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(240)) and 0 <= got[900].score <= 1 and got[901].predicted in (0, 1)
    assert sum(got[i].predicted == (i % 3 > 0) for i in held) >= 0.9 * len(held)
    assert quality_classifier.train(docs, labels.limit(0))["w0"] == 0.0


def test_classifier_reads_metadata(spark):
    """Texts alike, but for what their rows state: n_chars is an input of the machine."""
    rng = random.Random(29)
    rows = [(i, text_of(rng, 40), 10 if i % 2 else 9000) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).filter("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95
    blank = quality_classifier.fit([])
    assert {r.score for r in quality_classifier.score(docs.drop("n_chars"), blank).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(9)
    m = 1 << quality_classifier.BITS
    n = len(quality_classifier.STATS)
    model = {"w0": 0.5, "w": rng.normal(size=m + n), "v": rng.normal(size=(m + n, 3))}
    col, val, st = np.array([3, 9, 4]), np.array([0.2, 0.5, 0.9]), rng.normal(size=(2, n))
    got = quality_classifier.raw_scores(np.array([0, 2, 3]), col, val, st, model)
    for d, (a, b) in enumerate(((0, 2), (2, 3))):
        i, x = np.r_[col[a:b], np.arange(m, m + n)], np.r_[val[a:b], st[d]]
        pairs = sum(model["v"][i[p]] @ model["v"][i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert got[d] == pytest.approx(0.5 + model["w"][i] @ x + pairs)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_pii(spark):
    rng = random.Random(11)
    parts = ["a.b@c.d.e", "x@y", "é.q@r.s-", "1.2.3.4.5", "300.1.1.1", "0001.2.3.04", "1.2.3.99999999999999999999", "4111 1111-1111 1111", "4111111111111112", "12--34", "+1 (555) 123-4567", "+12", "+1.2.3.4", " ", "é", "\u0001", "a\u00011", "token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f9\"", "abc", "@", ".", "4111 1111 1111 1111 7", "e@1.2.3.4"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts += [None, "", "1" * 30000, "1 " * 20000, "a@" + "b." * 20000 + "c", "+" + "1-" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(df, pii.DEFAULT).collect()}
    for i, t in enumerate(texts):
        found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert got[i].n_email == sum(k == "email" for k, _, _ in found) and got[i].spans.startswith(listed)
    assert any("secret" in r.spans for r in got.values())
    out = pii.redact(spark.createDataFrame([(1, "mail a@b.co, key", 5), (2, None, 6)], "doc_id long, text string, n long"), pii.DEFAULT).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "mail [EMAIL], key", 5), (2, None, 6)]


def test_pii_is_linear_in_long_texts(spark):
    """A megabyte without a break, in texts with an address somewhere, takes seconds; so do many thousand spans."""
    import time

    n = 1_000_000
    texts = ["a" * n + " x@y.z", "1" * n + " 1.2.3.4 x@y.z", "a.b-c_" * (n // 6) + "@", "x@y.z " * 20_000, '"' + "q" * n, "1.2." * (n // 4), "a1" * (n // 2) + "[at", "+1 (555) 123-4567 " * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r.doc_id: r for r in pii.digests(df, pii.DEFAULT).collect()}
    out = {r.doc_id: r.text for r in pii.redact(df, pii.DEFAULT).collect()}
    assert time.time() - began < 90
    assert [got[i].n_email for i in range(8)] == [1, 1, 0, 20_000, 0, 0, 0, 0] and got[1].n_ip == 1 and got[7].n_phone == 10_000
    assert got[5].n_ip == n // 8
    assert out[0] == "a" * n + " [EMAIL]" and out[3] == "[EMAIL] " * 20_000 and out[7] == "[PHONE] " * 10_000


def test_scan_and_segments(spark):
    rng = random.Random(13)
    rows = [(i, [rng.randrange(-9, 99) for _ in range(i)]) for i in (0, 1, 2, 3, 10, 57, 100)]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    got = {r.i: (r.s, r.m) for r in df.select("i", pii.scan(F.col("v"), lambda a, b: a + b, 0).alias("s"), pii.scan(F.col("v"), lambda a, b: F.greatest(a, b), -50).alias("m")).collect()}
    assert got == {i: ([sum(v[:k]) for k in range(i)], [max([-50, *v[:k]]) for k in range(i)]) for i, v in rows}
    text = "".join(rng.choice("aé漢🙂\n") for _ in range(10_000))
    marks = sorted((a, min(10_000, a + rng.randrange(1, 50)), rng.choice(["x", "y"])) for a in rng.sample(range(10_000), 60)) + [(9_990, 10_000, "z")]
    df = spark.createDataFrame([(text, sorted(marks))], "t string, m array<struct<start:int,end:int,kind:string>>")
    want, at = "", 0
    for a, b, kind in sorted(marks):
        if a >= at:
            want += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    assert df.select(pii._redacted(F.col("t"), F.col("m"))).first()[0] == want + text[at:]


def test_pii_training_with_copies(spark):
    """Copies of a candidate don't change the model, which finds tokens that nothing names."""
    hexed = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'x token = "{hexed(i)}" y = "{"%016d" % (i * 7919)}" end' for i in range(300)]
    first = spark.createDataFrame([(i, hexed(i)) for i in range(300)], "i int, h string").orderBy(F.xxhash64("h")).first().i
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    model = pii.train(frame(texts + [texts[first]] * 3000))
    assert model == pii.train(frame(texts)) and model != pii.DEFAULT
    unseen = [f"plain {hexed(i)} text" for i in range(1000, 1050)] + [f"plain {'%016d' % (i * 7919)} text" for i in range(1000, 1050)]
    got = {r.doc_id: r.spans for r in pii.digests(frame(unseen), model).collect()}
    assert {i for i in got if "secret:6:46" in got[i]} == set(range(50)) and not any("secret" in got[i] for i in range(50, 100))


def test_pii_without_a_precise_threshold(spark):
    """Named and unnamed candidates of one format can't be told apart by it: the default rule takes what is named and assigned."""
    hexed = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'the token = "{hexed(i)}" end' if i % 4 == 0 else f'the thing = "{hexed(i)}" end') for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    assert model == pii.DEFAULT
    assert {r.doc_id for r in pii.digests(df, model).collect() if "secret" in r.spans} == set(range(0, 400, 4))


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    """More candidates than any sample took: all of a half are summed up, and jobs over groups give the driver's model."""
    hexed = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'x token = "{hexed(i)}" end' if i % 2 else f"y {'%016d' % (i * 7919)} end") for i in range(12_000)]
    df, summed, grow = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), [], pii.grow

    def watched(of, edges, trees, rate):
        summed.append(of([]))
        return grow(of, edges, 2, rate)

    monkeypatch.setattr(pii, "grow", watched)
    models = [pii.train(df, weight=1 << 20, at_hand=n) for n in (pii.GROUPS, 0)]
    assert models[0] == models[1] and models[0]["source"] == "fitted" and (summed[0] == summed[1]).all()
    length = slice(0, len(pii.EDGES[0]) + 1)
    assert 4 * summed[0][1].diagonal()[length].sum() / pii.UNIT > 0.49 * 12_000


def test_boosting_learns_and_compiles(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    trees = pii.fit(x, y)
    z = pii.predict(x, trees)
    assert ((z > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in x], "a double, b double, c double")
    got = [r.z for r in df.select(pii.as_column([F.col("a"), F.col("b"), F.col("c")], trees).alias("z")).collect()]
    assert got == pytest.approx(z.tolist())
    cut = pii.threshold(z, y)
    assert y[z >= cut].mean() >= pii.PRECISION


def test_warc_streams_many_and_large_records():
    """A member a record or one for all, records larger than a step, cut anywhere."""
    import zlib

    recs = [warc.record(i, "u", b"\r\n\r\n" * (i * 5000 % 30011), len(b"\r\n\r\n" * (i * 5000 % 30011)), "d", "response", None, None) for i in range(12)]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = deflate.compress(b"".join(recs)) + deflate.flush()
    apart, index = warc.normal(whole)
    for step in (7, 1000, 1 << 16):
        assert list(warc.records(whole, step)) == recs == list(warc.records(apart, step))
    assert len(index) == 12 and [zlib.decompress(apart[o : o + n], 31) for o, n in index] == recs
    with pytest.raises(ValueError):
        list(warc.records(zlib.compress(recs[1][:-9], wbits=31)))


def test_warc(spark, tmp_path):
    big = "ü" * 80
    pages = [(1, "http://a/1\r\n", big), (2, None, big), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u", "\r\n\r\n" + big), (0, "z", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").repartition(2)
    one = warc.write(warc.with_roles(df), archive_bytes=600)
    archives = warc.normalise(one)
    got = {r.page_id: r for r in warc.read(archives).collect()}
    for i, _, h in pages:
        raw = (h or "").encode()
        again = h == big and i != 0
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 0 if again else None)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    for r in archives.collect():
        members = warc.records(bytes(r.raw))
        assert len(list(members)) == len(r["index"])
    assert warc.export(archives, f"file://{tmp_path}/w").agg(F.sum("records")).first()[0] == 7
    assert warc.read(warc.normalise(warc.write(warc.with_roles(df.limit(0))))).count() == 0
