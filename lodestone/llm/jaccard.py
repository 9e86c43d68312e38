"""Exact set-similarity self-join on word shingles, by set relations (skipping in index lists and between answers).

Documents link when 100 * |x & y| >= PERCENT * |x | y| for their sets of distinct shingles.

1. Equal sets become one, represented by the smallest doc_id (``same``).
2. Answers of highly similar sets come first: sets that share several of a few least-hash keys are compared with the
   smallest such set, their leader.  A verified link gives the member its leader and its exact distance
   (1 - similarity) from it, and from then on the pair's link follows from the leader's.
3. Prefix lists: shingles are ordered by the load of their hash bucket in a frequency sketch of all sets (a table of
   2**SKETCH_BITS counts, whatever the input's size), rare first; two sets that link share a shingle among the first
   n - ceil(t n) + 1 of each.  Lists are dealt by shingle.  In a list, entries are ordered by set size and position;
   blocks that are too small for a probe, or whose least position already rules a link out, are skipped whole, and so
   are pairs under one leader.  Lists are counted before: one with more than 1/4096 of all entries is split into groups,
   and a task takes a group or two of them, so that none has the whole list.
4. A pair (x, y) that is left is first lifted to its leaders (a, b).  If these link, x and y are connected already.  If
   not, the distance is a metric: d(x, y) >= d(a, b) - d(a, x) - d(b, y), and a pair ruled out by that is never compared.
   What then remains is compared on the sets themselves.
5. Links are closed to components by repeated minima and pointer jumps, as joins.
6. Links are counted.  Those between clusters (the sets under one leader) whose leaders don't link were compared in 4.
   Within a cluster, and between clusters whose leaders link, blocks of sets meet blocks of sets: a matrix product
   gives the overlaps of each two, of which only each set's number of links is kept.

Steps 1 to 5 are linear in rows or in candidate pairs between different clusters; step 6 compares all pairs of a group
of near copies, a block pair at a time, and no step holds them as rows.  Shingles are 64-bit hashes of all their words.  Defined results: null and blank texts have an empty set, size 0
and their own id; a row without a doc_id has its set's size, links with nothing and has no component; fewer words than k
make one shingle; repeated rows of a doc_id repeat with the same component, and if their texts differ the least of them
stands for all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW_ENTRIES, STEP, Texts, Words, batch, by_bucket, cut, deal, dealt_schema, frequent_counts, gather, having_ids, key_bucket, mix, one_text_an_id, parts, ranges, runs, salted, table, texts, with_groups

K = 5
PERCENT = 75
SKETCH_BITS = 20
KEYS = 6
AGREE = 3
BLOCK = 128
PART = 1 << 14
BLOCK_SETS = 512  # a block of step 6 has about so many sets, and so many shingles
BLOCK_SHINGLES = 1 << 18
COLUMNS = 4096
_SEEDS = mix(np.arange(101, 101 + KEYS, dtype=np.uint64))


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def shingles(t: Texts, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted in each document) and each document's bounds in them."""
    w = Words(t, lower=True)
    counts = w.counts
    g = w.grams(k)
    n = np.where(counts >= k, counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.at[:-1], n)
    h = g[pos]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            at = np.minimum(w.at[short] + i, len(w.hash) - 1)
            one = np.where(has, mix(one * np.uint64(3) + w.hash[at] + np.uint64(i + 1)), one)
        h, doc = np.concatenate([h, one]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))


# ---------------------------------------------------------------- 1. sets, sketch


def profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, digest, keys array<long> of each document's set."""
    schema = {"doc_id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in texts(b):
                h, at = shingles(t, k)
                n = np.diff(at)
                has = np.flatnonzero(n)
                keys = np.zeros((len(n), KEYS), np.uint64)
                for i in range(KEYS):
                    if len(has):
                        keys[has, i] = np.minimum.reduceat(mix(h ^ _SEEDS[i]), at[:-1][has])
                digests = [blake2b(h[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(n))]
                yield batch(schema, doc_id=t.named, n=n, digest=digests, keys=keys.view(np.int64).tolist())

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>")


def sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many (document, shingle) pairs fall into each of 2**bits buckets. Its size is fixed, so it may be collected."""
    block = 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for _, t in texts(b):
                total += np.bincount((shingles(t, k)[0] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        rows = total.reshape(-1, min(block, len(total)))
        full = np.flatnonzero(rows.any(axis=1))
        yield batch({"part": pa.int32(), "load": pa.binary()}, part=full, load=[rows[i].tobytes() for i in full])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, load in zip(b.column("part").to_pylist(), b.column("load")):
                x = np.frombuffer(load.as_buffer(), np.uint32)
                sums[part] = sums[part] + x if part in sums else x.astype(np.uint64)
        yield batch({"part": pa.int32(), "load": pa.binary()}, part=list(sums), load=[v.tobytes() for v in sums.values()])

    out = np.zeros((max(1, (1 << bits) // block), min(block, 1 << bits)), np.uint64)
    summed = docs.mapInArrow(run, "part int, load binary").repartition(max(1, min(parts(docs.sparkSession), 64)), "part").mapInArrow(add, "part int, load binary")
    for r in summed.collect():  # 2**bits counts at most
        out[r.part] += np.frombuffer(r.load, np.uint64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


# ---------------------------------------------------------------- 2. leaders


def compare(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) and the exact sizes: na, nb, both."""
    p = cut(pairs.select("a", "b"))
    ids = p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = having_ids(docs, ids)
    # members first: each of them has few pairs; then the texts of leaders, which may have a third of all pairs
    p = salted(p, "b", "a", some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")))
    p = salted(p, "a", "b", some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")))
    schema = {"a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "both": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.slice(lo, 500)
                sides = []
                for key, col in (("a", "ta"), ("b", "tb")):
                    sets = []
                    for _, t in texts(b, key, col):
                        h, at = shingles(t, k)
                        sets += [h[at[i] : at[i + 1]] for i in range(len(t.ids))]
                    sides.append(sets)
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)]
                yield batch(schema, a=b.column("a"), b=b.column("b"), na=[len(x) for x in sides[0]], nb=[len(x) for x in sides[1]], both=both)

    return p.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, na long, nb long, both long")


def _linked(percent: int) -> F.Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _distance() -> F.Column:
    return 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))


def leaders(sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a (leader), b (member), d: verified links of sets to a set that shares AGREE of the KEYS least hashes."""
    keyed = sets.select("doc_id", F.posexplode("keys").alias("i", "key"))
    first = cut(keyed.groupBy("i", "key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    near = with_groups(keyed, first, ["i", "key"]).filter("a <> doc_id").groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("m")).filter(F.col("m") >= AGREE)
    one = near.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a"))
    return compare(one, docs, k).filter(_linked(percent)).select("a", "b", _distance().alias("d"))


# ---------------------------------------------------------------- 3. lists


def _heads(batches: Iterator[pa.RecordBatch], k: int, percent: int, loads: np.ndarray, bits: int) -> Iterator[list[np.ndarray]]:
    """Of a stretch of text's prefixes: shingle, document, leader (as a difference), set size, position."""
    for b in batches:
        lead = b.column("leader").to_numpy(zero_copy_only=False)
        for lo, t in texts(b):
            h, at = shingles(t, k)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, loads[(h >> np.uint64(64 - bits)).astype(np.int64)], doc))
            pos = np.arange(len(h)) - np.repeat(at[:-1], n)
            head = pos < (n - -(-percent * n // 100) + 1)[doc]
            h, doc, pos = h[order][head], doc[head], pos[head]
            ids = t.ids[doc]
            yield [h, ids, lead[lo : lo + len(n)][doc] - ids, n[doc].astype(np.int32), pos.astype(np.int32)]


def _counted(k: int, percent: int, load, bits: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for cols in _heads(batches, k, percent, load.value, bits):
            yield cols[0]

    return keys


def celled(cols: list[np.ndarray], ways: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Entries dealt to the cells of their lists, with a side: a list of w ways is split by document into w groups, and a cell takes
    one group (side 0) or two (sides 1 and 2, of which only pairs of both count).  Any two entries of a list are in one cell, whose
    name stands for the shingle.  So many entries at a time as fill a step."""
    i = 0
    while i < len(ways):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(ways[i:]), STEP, "right")))
        w = ways[i:j]
        own, other = np.repeat(np.arange(i, j), w), ranges(np.zeros(j - i, np.int64), w)
        tok, *rest = (c[own] for c in cols)
        group = (mix(rest[0].view(np.uint64)) % np.repeat(w, w).astype(np.uint64)).astype(np.int64)
        lo, hi = np.minimum(group, other), np.maximum(group, other)
        cell = mix(tok ^ mix((lo << 32 | hi).astype(np.uint64) + np.uint64(1)))
        yield [np.where(np.repeat(w, w) > 1, cell, tok), *rest, np.where(lo == hi, 0, np.where(group == lo, 1, 2)).astype(np.uint8)]
        i = j


def _postings(k: int, percent: int, n_buckets: int, load, bits: int, often: dict[int, int], part: int):
    at = np.array(sorted(often), np.int64)
    split = np.array([-(-often[i] // part) for i in at.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _heads(batches, k, percent, load.value, bits):
            ways = np.ones(len(cols[0]), np.int64)
            if len(at):
                bucket = key_bucket(cols[0])
                place = np.minimum(np.searchsorted(at, bucket), len(at) - 1)
                ways = np.where(at[place] == bucket, split[place], 1)
            for some in celled(cols, ways):
                yield deal((some[0] % np.uint64(n_buckets)).astype(np.int64), n_buckets, some)

    return run


def _maybe(x: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries i and j of one list (size of i <= size of j) can still link and aren't settled by a leader."""
    na, nb = x["n"][i], x["n"][j]
    indexed = x["pos"][i] < na - -(-2 * percent * na // (100 + percent)) + 1
    upper = 1 + np.minimum(na - x["pos"][i], nb - x["pos"][j]) - 1
    a, b, la, lb = x["id"][i], x["id"][j], x["lead"][i], x["lead"][j]
    return indexed & (100 * na >= percent * nb) & (upper >= need(na, nb, percent)) & (la != lb) & (la != b) & (lb != a) & (a != b)


def list_pairs(x: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of the same shingle that may link. x: tok, id, lead, n, pos, ordered by tok, n, pos."""
    start, size = runs(x["tok"])
    end = start + size
    # short lists: each entry with the s-th after it, for all lists at once; an entry is done once sizes are too far off
    short = size <= BLOCK
    stop = np.repeat(end[short], size[short])
    i = ranges(start[short], size[short])
    s = 1
    while len(i):
        live = i + s < stop
        i, stop = i[live], stop[live]
        j = i + s
        live = 100 * x["n"][i] >= percent * x["n"][j]
        i, stop, j = i[live], stop[live], j[live]
        hit = _maybe(x, i, j, percent)
        yield i[hit], j[hit]
        s += 1
    # long lists: block against block, skipping by size, by least position and by common leader
    for a, b in zip(start[~short].tolist(), end[~short].tolist()):
        cuts = np.arange(a, b, BLOCK)
        ends = np.minimum(cuts + BLOCK, b)
        lo_n, hi_n = x["n"][cuts], x["n"][ends - 1]
        least = np.minimum.reduceat(x["pos"][a:b], cuts - a)
        lead_lo, lead_hi = np.minimum.reduceat(x["lead"][a:b], cuts - a), np.maximum.reduceat(x["lead"][a:b], cuts - a)
        for p in range(len(cuts)):
            q = np.arange(p, len(cuts))
            best = np.minimum(hi_n[p] - least[p], hi_n[q] - least[q])
            ok = (100 * hi_n[p] >= percent * lo_n[q]) & (best >= need(lo_n[p], lo_n[q], percent))
            ok &= ~((lead_lo[p] == lead_hi[p]) & (lead_lo[q] == lead_hi[q]) & (lead_lo[p] == lead_lo[q]))
            for r in q[ok]:
                i, j = np.meshgrid(np.arange(cuts[p], ends[p]), np.arange(cuts[r], ends[r]), indexing="ij")
                i, j = i.ravel(), j.ravel()
                if r == p:
                    i, j = i[i < j], j[i < j]
                hit = _maybe(x, i, j, percent)
                yield i[hit], j[hit]


def _pairs(percent: int):
    schema = {"a": pa.int64(), "b": pa.int64(), "la": pa.int64(), "lb": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, [np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint8])
        if got is None:
            return
        tok = got[0]
        order = np.argsort(tok, kind="stable")
        s = tok[order]
        twin = np.zeros(len(s), bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]
        x = dict(zip(("tok", "id", "lead", "n", "pos", "side"), (c[order] for c in got)))
        order = np.lexsort((x["id"], x["pos"], x["n"], x["tok"]))
        x = {k: v[order] for k, v in x.items()}
        x["lead"] = x["lead"] + x["id"]
        x["n"], x["pos"] = x["n"].astype(np.int64), x["pos"].astype(np.int64)
        pool, held = [], 0

        def out():
            i, j = (np.concatenate(c) for c in zip(*pool))
            swap = x["id"][i] > x["id"][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((x["id"][j], x["id"][i]))
            i, j = i[order], j[order]
            new = np.r_[True, (x["id"][i][1:] != x["id"][i][:-1]) | (x["id"][j][1:] != x["id"][j][:-1])]
            i, j = i[new], j[new]
            return batch(schema, a=x["id"][i], b=x["id"][j], la=x["lead"][i], lb=x["lead"][j])

        for i, j in list_pairs(x, percent):
            across = (x["side"][i] == 0) | (x["side"][i] != x["side"][j])
            i, j = i[across], j[across]
            if len(i):
                pool.append((i, j))
                held += len(i)
            if held > 1_000_000:
                yield out()
                pool, held = [], 0
        if pool:
            yield out()

    return run


# ---------------------------------------------------------------- 4. and 5.


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that is reachable over edges (a, b)."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.count("*").alias("n")).select("id", F.least("id", "m").alias("component"), "n"))
    total = both.count()
    while True:
        from_next = with_groups(both, label.withColumnRenamed("id", "b"), ["b"], total).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(from_next, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"), "n")
        up = label.select(F.col("id").alias("c"), F.col("component").alias("jump"))
        step = cut(step.join(up, "c", "left").select("id", "old", F.least("c", "jump").alias("component"), "n"))
        changed = step.filter("component <> old").limit(1).count()
        label = step.select("id", "component", "n")
        if not changed:
            return label.select("id", "component")


# ---------------------------------------------------------------- 6. numbers of links


def overlaps(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The overlap of each set of x with each of y; sets lie one after another, nx and ny are their sizes."""
    out = np.zeros((len(nx), len(ny)), np.float32)
    shared = np.intersect1d(x, y)
    sides = []
    for h, n in ((x, nx), (y, ny)):
        row, col = np.repeat(np.arange(len(n)), n), np.searchsorted(shared, h)
        has = np.flatnonzero(col < len(shared))
        has = has[shared[col[has]] == h[has]]
        has = has[np.argsort(col[has], kind="stable")]
        sides.append((len(n), row[has], col[has]))
    for lo in range(0, len(shared), COLUMNS):
        width, m = min(COLUMNS, len(shared) - lo), []
        for size, row, col in sides:
            i, j = np.searchsorted(col, [lo, lo + width])
            m.append(np.zeros((size, width), np.float32))
            m[-1][row[i:j], col[i:j] - lo] = 1
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _count_links(percent: int):
    keys = ("la", "ba", "lb", "bb")
    schema = {"id": pa.int64(), "n_links": pa.int64()}

    def counted(key: tuple, rows: list) -> pa.RecordBatch:
        side, ids, sets = zip(*rows)
        side, ids = np.array(side), np.array(ids, np.int64)
        half = []
        for s in (0, 1):
            i = np.flatnonzero(side == s)
            i = i[np.unique(ids[i], return_index=True)[1]]  # a repeated row counts once
            got = [np.frombuffer(sets[j], np.uint64) for j in i]
            half.append((ids[i], np.concatenate(got) if got else np.zeros(0, np.uint64), np.array([len(g) for g in got], np.int64)))
        (a, x, nx), (b, y, ny) = half
        same = key[:2] == key[2:]
        if same:
            b, y, ny = a, x, nx
        both = overlaps(x, nx, y, ny)
        linked = 100 * both >= percent * (nx[:, None] + ny[None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
            return batch(schema, id=a, n_links=linked.sum(axis=1))
        return batch(schema, id=np.r_[a, b], n_links=np.r_[linked.sum(axis=1), linked.sum(axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], 1)
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(k) else []
            for lo, hi in zip(starts, [*starts[1:], len(k)]):
                key = tuple(k[lo].tolist())
                if key != now and held:
                    yield counted(now, held)
                    held = []
                now = key
                part = b.slice(lo, hi - lo)
                held += zip(part.column("side").to_pylist(), part.column("id").to_pylist(), part.column("set").to_pylist())
        if held:
            yield counted(now, held)

    return run


def _sets(k: int):
    schema = {"id": pa.int64(), "set": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in texts(b):
                h, at = shingles(t, k)
                yield batch(schema, id=t.ids, set=[h[at[i] : at[i + 1]].tobytes() for i in range(len(t.ids))])

    return run


def link_counts(docs: DataFrame, info: DataFrame, led: DataFrame, linked: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """id, n_links of each set that links: with how many others.

    A linked pair is of one cluster, of two clusters whose leaders link (``linked`` has them, or one leads the other),
    or in ``found``; each pair is of one of these kinds only.
    """
    spark = docs.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    clusters = info.groupBy("leader").agg(F.count("*").alias("m"), blocks.alias("q"), F.min(F.col("doc_id") == F.col("leader")).alias("own"))
    clusters = cut(clusters.withColumn("alone", F.expr("m = 1 and own")))
    above = led.select(F.col("b").alias("a"), F.col("a").alias("top"))
    chains = led.select("a").distinct().join(above, "a").select(F.least("a", "top"), F.greatest("a", "top"))
    units = linked.union(chains).toDF("la", "lb").union(clusters.filter("m > 1").select("leader", "leader")).distinct()
    for side in ("a", "b"):
        units = units.join(clusters.select(F.col("leader").alias(f"l{side}"), F.col("q").alias(f"q{side}"), F.col("alone").alias(f"alone_{side}")), f"l{side}")
    units = cut(units)
    # two leaders without members: that they link is known already
    plain = units.filter("alone_a and alone_b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    to = units.filter("not (alone_a and alone_b)").withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("qa") - 1)))
    to = to.withColumn("bb", F.explode(F.sequence(F.when(F.col("la") == F.col("lb"), F.col("ba")).otherwise(0), F.col("qb") - 1))).select("la", "ba", "lb", "bb")
    wanted = units.filter("not (alone_a and alone_b)").select(F.explode(F.array("la", "lb")).alias("leader")).distinct()
    at = info.join(wanted, "leader", "left_semi").join(clusters.select("leader", "q"), "leader")
    at = cut(at.select(F.col("doc_id").alias("id"), "leader", F.pmod(F.xxhash64("doc_id"), F.col("q").cast("long")).cast("int").alias("block")))
    sets = having_ids(docs.filter("doc_id is not null"), at.select(F.col("id").alias("doc_id"))).mapInArrow(_sets(k), "id long, set binary")
    sets = sets.join(at.hint("shuffle_hash"), "id")
    left = to.join(sets.select(F.col("leader").alias("la"), F.col("block").alias("ba"), "id", "set"), ["la", "ba"]).withColumn("side", F.lit(0))
    right = to.filter("la <> lb or ba <> bb").join(sets.select(F.col("leader").alias("lb"), F.col("block").alias("bb"), "id", "set"), ["lb", "bb"]).withColumn("side", F.lit(1))
    keys = ["la", "ba", "lb", "bb"]
    met = left.select(*keys, "side", "id", "set").unionByName(right.select(*keys, "side", "id", "set"))
    counted = met.repartition(parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_count_links(percent), "id long, n_links long")
    ends = plain.union(found).select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n_links"))
    return cut(counted.unionByName(ends).groupBy("id").agg(F.sum("n_links").alias("n_links")))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, bits: int = SKETCH_BITS, links: bool = True, part: int = PART, few: int = FEW_ENTRIES) -> DataFrame:
    """doc_id, n_shingles, component_id, rep_id (the document with the same set) and n_links.

    part: a frequent shingle's list is split into groups of about so many entries; few: a list of fewer is never split.

    n_links is the number of other distinct sets that the document's set links with; without ``links`` it isn't counted.
    """
    spark = docs.sparkSession
    docs = one_text_an_id(docs)
    prof = cut(profile(docs, k))
    filled = prof.filter("n > 0 and doc_id is not null").withColumnRenamed("n", "size")
    reps = cut(filled.groupBy("size", "digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    member = cut(with_groups(filled.select("doc_id", "size", "digest"), reps, ["size", "digest"]).select("doc_id", F.col("size").alias("n"), "rep"))
    sets = prof.join(member.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    led = cut(leaders(sets, docs, k, percent))
    load = spark.sparkContext.broadcast(sketch(docs, k, bits))
    info = member.filter("doc_id = rep").select("doc_id", "n").join(led.select(F.col("b").alias("doc_id"), F.col("a").alias("leader")), "doc_id", "left")
    info = info.select("doc_id", "n", F.coalesce("leader", "doc_id").alias("leader"))
    n = parts(spark)
    # counted where the texts lie, copies of a set too: at most too many ways, without a shuffle
    often = frequent_counts(docs.select("doc_id", "text", F.lit(0).cast("long").alias("leader")), _counted(k, percent, load, bits), few)
    lists = docs.join(info.drop("n").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "leader").mapInArrow(_postings(k, percent, n, load, bits, often, part), dealt_schema(6))
    cand = cut(by_bucket(lists, n).mapInArrow(_pairs(percent), "a long, b long, la long, lb long").distinct())
    load.destroy()
    # what the leaders' distance settles
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    heads = compare(cand.select(*ordered("la", "lb")).distinct(), docs, k)
    heads = cut(heads.select(F.col("a").alias("ha"), F.col("b").alias("hb"), _linked(percent).alias("linked"), _distance().alias("d")))
    dist = led.select(F.col("b").alias("id"), F.col("d").alias("own"))
    rest = cand.filter("a <> la or b <> lb").withColumns({"ha": F.least("la", "lb"), "hb": F.greatest("la", "lb")})
    rest = rest.join(heads.filter("not linked"), ["ha", "hb"])
    for side in ("a", "b"):
        rest = rest.join(dist.select(F.col("id").alias(side), F.col("own").alias(f"d{side}")), side, "left")
    slack = F.col("d") - F.coalesce("da", F.lit(0.0)) - F.coalesce("db", F.lit(0.0))
    rest = cut(rest.filter(slack <= 1 - percent / 100 + 1e-9).select(*ordered("a", "b")).distinct())
    found = cut(compare(rest, docs, k).filter(_linked(percent)).select("a", "b").distinct())
    edges = cut(led.select("a", "b").union(heads.filter("linked").select("ha", "hb")).union(found).distinct())
    comp = components(edges)
    if links:
        degree = link_counts(docs, info, led, heads.filter("linked").select("ha", "hb"), found, k, percent)
    else:
        degree = comp.select("id", F.lit(None).cast("long").alias("n_links"))
    at = comp.join(degree, "id", "left").withColumnRenamed("id", "rep")
    at = cut(at.join(reps.select("rep", F.col("n").alias("many")), "rep").withColumnRenamed("many", "n"))  # sets that link
    linked = with_groups(member.withColumnRenamed("n", "size"), at, ["rep"]).select("doc_id", "size", "component", "rep", "n_links")
    alone = member.join(at, "rep", "left_anti").select("doc_id", F.col("n").alias("size"), F.lit(None).cast("long").alias("component"), "rep", F.lit(0).cast("long").alias("n_links"))
    linked = linked.unionByName(alone).withColumnRenamed("size", "n").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("rep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = prof.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(empty).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose document is the smallest id of its component; one row of a doc_id.

    Of several rows of a doc_id the one with the least text stays, of these the one whose columns have the least hash.
    Rows without a doc_id are in no component and all stay.
    """
    keep = join(docs.select("doc_id", "text"), links=False, **options).filter("doc_id = component_id").select("doc_id").distinct()
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")), F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    kept = docs.filter("doc_id is not null").join(keep, "doc_id", "left_semi")
    one = kept.select(F.struct("*").alias("row"), "doc_id", F.row_number().over(order).alias("nth")).filter("nth = 1").select("row.*")
    return one.unionAll(docs.filter("doc_id is null"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
