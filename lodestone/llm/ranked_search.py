"""Ranked lexical search: each item's best documents by branch and bound in FP-trees of documents.

A document's score sums w * ((1000000000 * tf) div (1000 * tf + 12 * m)) over the item's terms, m growing with the
document's length and w falling with the term's document frequency; it rises with tf and falls with m.

1. The items' terms are collected (``BLOCK_TERMS`` of them at a time; more items are more rounds over step 3 and later).
2. One pass over the texts leaves each document's restricted vector: its asked terms, their tf, and its number of terms.
   These are written once; no text and no other term goes on.
3. Counts over all documents (N, L, each term's df) are sums of what each task has counted.
4. Each task builds trees of ``TREE_DOCS`` documents: their terms, most frequent first, are paths from the root, so that
   documents that begin alike share them; unbranched paths are one node, and a subtree of ``LEAF`` documents is a leaf.
   A node keeps the greatest tf of each term and the least m below it.  With these in place of a document's own it bounds
   every score below the node.
5. A tree is searched depth first, for many items at once: a subtree is entered for those items whose bound there reaches
   their k-th best score so far.  Documents of a leaf that is reached are scored by a matrix product; all numbers are
   integers below 2**53, so it is exact.  The scores found so far hold on in the task's next trees, and start with the
   k-th best of a sample of the documents, which is a lower bound of that of all.
6. A task passes on k documents an item at most; the best k of these are the result.

Nothing is capped: a skipped subtree can't hold a better document.  Terms are told apart by 64-bit hashes.  Defined
results: null texts and texts without terms have none and aren't counted; each row is a document, so rows that repeat a
doc_id repeat; rows without a doc_id, and items without an item_id, are left out; of several texts of one item_id the
least counts; ties go to the smaller doc_id; an item without terms has no rows; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, batch, cut, table, texts

K = 20
TREE_DOCS = 8192
TREE_TERMS = 1 << 22  # entries of a tree's vectors
LEAF = 8
BLOCK_TERMS = 1 << 17  # of items that are searched in one round, repeats included
GROUP_ITEMS, GROUP_TERMS = 256, 1 << 14  # of items that go through a tree together
SAMPLE = 8192  # documents whose k-th best score is the floor of the search

#: Bytes that stand between terms: all but digits, letters and those of other than ASCII characters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def length_factor(n, total_docs: int, total_terms: int):
    """m of documents of n terms."""
    return 100 - 25 + (25 * n * total_docs) // total_terms


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, total_docs: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- vectors


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: hashes of the item's terms, repeats included; one row an item."""
    one = items.filter("item_id is not null").groupBy("item_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    schema = {"item_id": pa.int64(), "terms": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in texts(b, "item_id"):
                w = Words(t, lower=True, space=_BETWEEN)
                h = w.hash.view(np.int64)
                yield batch(schema, item_id=t.ids, terms=[h[w.at[i] : w.at[i + 1]] for i in range(len(t.ids))])

    return one.mapInArrow(run, "item_id long, terms array<long>")


def vectors(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, n, ids, tfs: a document's number of terms, and the places in known (sorted hashes) of those that it has."""
    schema = {"doc_id": pa.int64(), "n": pa.int64(), "ids": pa.binary(), "tfs": pa.binary()}
    shared = docs.sparkSession.sparkContext.broadcast(known)  # a block's terms, at most BLOCK_TERMS or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for _, t in texts(b):
                w = Words(t, lower=True, space=_BETWEEN)
                at = np.searchsorted(known, w.hash)
                has = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == w.hash) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(w.at, has, "right") - 1
                pair, tf = np.unique(doc * max(len(known), 1) + at[has], return_counts=True)
                doc, ids = np.divmod(pair, max(len(known), 1))
                cuts = np.searchsorted(doc, np.arange(len(t.ids) + 1))
                raw = lambda a: [a[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(t.ids))]
                yield batch(schema, doc_id=t.ids, n=w.counts, ids=raw(ids.astype(np.int32)), tfs=raw(tf.astype(np.int32)))

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, tfs binary")


def _joined(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of packed arrays, and each row's number of them."""
    parts = [x.as_py() for x in col]
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) // width for p in parts], np.int64)


def counts(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the df of each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            n = b.column("n").to_numpy()
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
            df += np.bincount(_joined(b.column("ids"), np.int32)[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield batch({"term": pa.int32(), "n": pa.int64()}, term=np.r_[-2, -1, some], n=np.r_[docs, terms, df[some]])

    out = np.zeros(n_terms + 2, np.int64)
    for r in found.select("n", "ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term asked for
        out[r.term + 2] = r.n
    return int(out[0]), int(out[1]), out[2:]


# ---------------------------------------------------------------- trees


class Tree:
    """An FP-tree of some documents: docs in order of their paths, nodes in preorder with the documents below each.

    term holds ranks by falling frequency, rising within a document; at are the documents' bounds in term and tf.
    """

    def __init__(self, at: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, doc_id: np.ndarray, leaf: int = LEAF):
        raw, size = term.astype(">u4").tobytes(), np.diff(at)
        path = [raw[4 * at[i] : 4 * at[i + 1]] for i in range(len(size))]
        order = np.array(sorted(range(len(size)), key=path.__getitem__), np.int64)
        take = np.repeat(at[order] - np.r_[0, np.cumsum(size[order])[:-1]], size[order]) + np.arange(len(term))
        self.at = np.r_[0, np.cumsum(size[order])]
        self.term, self.tf, self.m, self.doc_id = term[take], tf[take], m[order], doc_id[order]
        self.lo, self.hi, self.below = [], [], []  # below: a node's children, none for a leaf
        self._grow(leaf)

    def _grow(self, leaf: int) -> None:
        todo = [(0, len(self.m), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            me = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.below.append([])
            if parent >= 0:
                self.below[parent].append(me)
            first, last = (self.term[self.at[i] + depth : self.at[i + 1]] for i in (lo, hi - 1))
            k = min(len(first), len(last))
            apart = np.flatnonzero(first[:k] != last[:k])
            depth += int(apart[0]) if len(apart) else k  # documents in order share what the first and the last share
            if hi - lo <= leaf or (not len(apart) and len(first) == len(last)):
                continue
            place = self.at[lo:hi] + depth
            ends = place >= self.at[lo + 1 : hi + 1]
            nxt = np.where(ends, -1, self.term[np.minimum(place, len(self.term) - 1)])
            starts = np.r_[np.flatnonzero(np.r_[True, nxt[1:] != nxt[:-1]]), hi - lo] + lo
            begin = lo
            for s, e in zip(starts[:-1], starts[1:]):  # small siblings share a leaf
                if e - begin > leaf and begin < s:
                    todo.append((begin, int(s), depth, me))
                    begin = int(s)
            todo.append((begin, hi, depth, me))

    def dense(self, lo: int, hi: int, column: np.ndarray, width: int) -> np.ndarray:
        """tf of documents lo to hi by column; column says which a term has (-1: none)."""
        out = np.zeros((hi - lo, width), np.int32)
        span = slice(self.at[lo], self.at[hi])
        c = column[self.term[span]]
        has = c >= 0
        out[np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))[has], c[has]] = self.tf[span][has]
        return out

    def maxima(self, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the greatest tf of each column and the least m below it."""
        tf, m = np.zeros((len(self.lo), width), np.int32), np.zeros(len(self.lo), np.int64)
        for i in reversed(range(len(self.lo))):  # children come after their parents
            if self.below[i]:
                tf[i], m[i] = tf[self.below[i]].max(axis=0), m[self.below[i]].min()
            else:
                for lo in range(self.lo[i], self.hi[i], 64):
                    np.maximum(tf[i], self.dense(lo, min(lo + 64, self.hi[i]), column, width).max(axis=0), out=tf[i])
                m[i] = self.m[self.lo[i] : self.hi[i]].min()
        return tf, m


def _gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """gain of each entry as a double, zero where tf is."""
    out = np.zeros(tf.shape)
    i, j = np.nonzero(tf)
    out[i, j] = gain(tf[i, j].astype(np.int64), m[i])
    return out


class Best:
    """The k best documents of each item so far, and what a document must score to be one of them."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.astype(float)
        self.top = np.full((len(floor), k), -1.0)
        self.found, self.n = [], 0

    def offer(self, items: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        """score: documents x items."""
        i, j = np.nonzero(score.T >= self.floor[items][:, None])
        if not len(i):
            return
        self.found.append((items[i], doc_id[j], score.T[i, j].astype(np.int64)))
        self.n += len(i)
        some = np.unique(i)
        both = np.concatenate([self.top[items[some]], score.T[some]], axis=1)
        top = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        self.top[items[some]] = top
        self.floor[items[some]] = np.maximum(self.floor[items[some]], top.min(axis=1))
        if self.n > 1 << 18:
            self.found = [self.rows()]
            self.n = len(self.found[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, doc_id, score of each item's k best, ties to smaller ids."""
        if not self.found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        item, doc, score = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.k
        return item[keep], doc[keep], score[keep]


def branch_and_bound(tree: Tree, items: np.ndarray, column: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offers best every document of the tree that may be one of the items' best; how many scores were worked out.

    weights: columns x items.
    """
    width, scored = len(weights), 0
    tf, m = tree.maxima(column, width)
    bound = np.concatenate([_gains(tf[lo : lo + 64], m[lo : lo + 64]) @ weights for lo in range(0, len(m), 64)])
    order = bound.sum(axis=1)
    todo = [(0, np.arange(len(items)))]
    while todo:
        node, active = todo.pop()
        active = active[bound[node, active] >= best.floor[items[active]]]
        if not len(active):
            continue
        if tree.below[node]:
            todo += [(c, active) for c in sorted(tree.below[node], key=order.__getitem__)]  # the most promising is next
            continue
        for lo in range(tree.lo[node], tree.hi[node], 64):
            hi = min(lo + 64, tree.hi[node])
            score = _gains(tree.dense(lo, hi, column, width), tree.m[lo:hi]) @ weights[:, active]
            scored += score.size
            best.offer(items[active], tree.doc_id[lo:hi], score)
    return scored


def _groups(item_at: np.ndarray, item_term: np.ndarray, item_weight: np.ndarray, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items that go through a tree together: their places, the column of each term, and weights as columns x items."""
    lo = 0
    while lo < len(item_at) - 1:
        hi = lo + 1
        while hi < len(item_at) - 1 and hi - lo < GROUP_ITEMS and item_at[hi + 1] - item_at[lo] <= GROUP_TERMS:
            hi += 1
        span = slice(item_at[lo], item_at[hi])
        terms, col = np.unique(item_term[span], return_inverse=True)
        column = np.full(n_terms, -1, np.int32)
        column[terms] = np.arange(len(terms))
        w = np.zeros((len(terms), hi - lo))
        np.add.at(w, (col, np.repeat(np.arange(hi - lo), np.diff(item_at[lo : hi + 1]))), item_weight[span])
        yield np.arange(lo, hi), column, w
        lo = hi


def _searched(model, k: int):
    """item (place), doc_id, score: the best of a task's documents for each item."""
    schema = {"item": pa.int32(), "doc_id": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        groups = list(_groups(q["at"], q["term"], q["weight"], len(q["rank"])))
        best, held, n, size = Best(q["floor"], k), [], 0, 0

        def search() -> None:
            doc, terms, count, tf, per = (np.concatenate(c) for c in zip(*held))
            term = q["rank"][terms]
            order = np.lexsort((term, np.repeat(np.arange(len(per)), per)))
            tree = Tree(np.r_[0, np.cumsum(per)], term[order], tf[order], length_factor(count, q["n"], q["l"]), doc)
            for group in groups:
                branch_and_bound(tree, *group, best)

        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                terms, per = _joined(part.column("ids"), np.int32)
                tf, _ = _joined(part.column("tfs"), np.int32)
                some = per > 0
                held.append((part.column("doc_id").to_numpy()[some], terms, part.column("n").to_numpy()[some], tf, per[some]))
                n, size = n + int(some.sum()), size + len(terms)
                if n >= TREE_DOCS or size >= TREE_TERMS:
                    search()
                    held, n, size = [], 0, 0
        if n:
            search()
        item, doc, score = best.rows()
        yield batch(schema, item=item, doc_id=doc, score=score)

    return run


def _round(docs: DataFrame, items: DataFrame, k: int, sample: int) -> DataFrame | None:
    """The result for the items (item_id, terms) of one block; None if they have no terms."""
    spark = docs.sparkSession
    rows = sorted(((r.item_id, r.terms) for r in items.filter(F.size("terms") > 0).collect()), key=lambda r: r[0])  # a block
    if not rows:
        return None
    ids = np.array([r[0] for r in rows], np.int64)
    every = np.concatenate([np.array(r[1], np.int64).view(np.uint64) for r in rows])
    known, term = np.unique(every, return_inverse=True)
    found = cut(vectors(docs, known))
    n, total, df = counts(found, len(known))
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((np.arange(len(known)), -df))] = np.arange(len(known))
    w = np.array([weight(int(x), n) for x in df], np.int64)
    model = {"at": np.r_[0, np.cumsum([len(r[1]) for r in rows])], "term": rank[term], "weight": w[term], "rank": rank, "floor": np.ones(len(ids), np.int64), "n": n, "l": max(total, 1)}
    last = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")

    def best(some: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)  # a block's terms and items
        near = some.mapInArrow(_searched(shared, k), "item int, doc_id long, score long")
        return near.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)

    if n > 4 * sample:  # a lower bound of each item's k-th best score
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n)
        floor = model["floor"].copy()
        for r in best(found.filter(share)).filter(F.col("rank") == k).select("item", "score").collect():  # a row an item
            floor[r.item] = max(r.score, 1)
        model = model | {"floor": floor}
    named = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "item int, item_id long"))  # a block
    return best(found).join(named, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, sample: int = SAMPLE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each of items (item_id, text)."""
    asked = cut(asked_terms(items.select("item_id", "text")))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    out = None
    for b in range(blocks):
        part = _round(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, sample)
        out = part if out is None or part is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH t AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, nd),
m AS (SELECT doc_id, 100 - 25 + ((25 * len(ts) * nd) // l) AS m FROM t, c),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {K}"""
