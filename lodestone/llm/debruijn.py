"""Removal of repeated word windows by compacting a De Bruijn graph of token k-mers.

A window of k = 13 words is an edge between its first and last twelve words.  A word goes if an edge that covers it also
starts in a document with a smaller doc_id.  Counting edges one by one would shuffle one hash for each word of the corpus;
instead edges travel in unbranching pieces:

1. The m-word gram of least hash in each window (m = 7) is the window's anchor; consecutive edges of a text with the same
   anchor are one piece.  Pieces meet at their anchor, dealt by hash; equal ones of one stretch of text are settled before.
2. Equal pieces are one path without a branch: all its edges lie in the same documents, so each document but the
   smallest loses them all.  Pieces whose anchor lies in one document only are done.  Anchors are counted before: a
   frequent one (a passage of very many documents, in other surroundings each) is dealt by its pieces.
3. Where an anchor has several different pieces the path branches inside them.  The pieces of the smallest document of
   each such path go on, with a hash for each edge, and meet at the anchor again; each edge finds its smallest document.
   Where more than ``hot`` pieces branch at one anchor their edges are dealt one by one, equal ones settled before as in 1.
4. Found pieces carry their source's coordinates (document and word), and each edge is in one piece.  Pieces compact to
   paths by a join: a piece's first edge meets the edge after another's last, where both run in step through one source;
   what meets nothing is a path's head or tail, and the next tail after a head ends its path (``paths``).
5. A long path's words and its source's, at their coordinates, are compared by 128-bit digests; a path whose words differ
   (a collision of 64-bit hashes) is dropped (``verified``).  What is left is removed.

Defined results: null, blank and texts under 13 words lose nothing; rows that repeat a doc_id count as that document (if
their texts differ, the least of them stands for all); a row without a doc_id is matched with nothing and keeps its text;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW_ENTRIES, Words, anchor_runs, batch, by_bucket, combined, covered, cut, deal, dealt_schema, frequent, gather, having_ids, key_bucket, mix, nested, one_text_an_id, parts, ranges, runs, salted, table, texts, with_ranges

K = 13
M = 7


def _valid(w: Words, k: int) -> np.ndarray:
    """Which words start a window of k words of their document."""
    n = len(w.start)
    ok = np.ones(max(0, n - k + 1), bool)
    ends = w.at[1:]
    first = np.maximum(ends - k + 1, 0)
    ok[ranges(first, np.minimum(ends, len(ok)) - first)] = False
    return ok


_OPEN, _DONE = 0, 1  # an entry that travels, or one of a later document that is settled within its stretch of text
_APART = 2  # added to the state of entries whose anchor is frequent: they are dealt by piece
HOT = 1 << 14  # pieces that branch at one anchor and that one task takes
_ENTRY = [np.uint64, np.uint64, np.int64, np.int32, np.uint8, np.uint8, np.uint8]  # anchor, piece, document, first edge, place of the anchor, edges, state


def _entries(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a stretch of text's pieces: anchor, piece, document, first edge, place of the anchor, edges, and the entry that stands for it."""
    reach = k - m
    for b in batches:
        for _, t in texts(b):
            w = Words(t)
            if len(w.start) < k:
                continue
            h = w.grams(m)
            a, u, v = anchor_runs(h, reach + 1, _valid(w, k))
            doc = np.searchsorted(w.at, a, "right") - 1
            piece = mix((v - u).astype(np.uint64) << np.uint64(8) | (a - u).astype(np.uint64))
            for i in range(k + reach):
                at = u + i
                piece = np.where(at < v + k - 1, mix(piece ^ w.hash[np.minimum(at, len(w.hash) - 1)]), piece)
            ids = t.ids[doc]
            yield h[a], piece, ids, (u - w.at[doc]).astype(np.int32), (a - u).astype(np.uint8), (v - u).astype(np.uint8), combined([h[a], piece], ids)[0]


def _counted(k: int, m: int):
    """The anchors of the entries that travel."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for h, _, ids, _, _, _, rep in _entries(batches, k, m):
            yield h[ids == ids[rep]]

    return keys


def _find_pieces(k: int, m: int, n_buckets: int, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, piece, ids, first, left, n, rep in _entries(batches, k, m):
            done, apart = ids != ids[rep], np.isin(key_bucket(h), often)
            key = np.where(done, mix(ids.view(np.uint64)), np.where(apart, mix(h ^ mix(piece)), h))
            # a settled entry has its source's document and edge in place of the hashes
            x, y = np.where(done, ids[rep].view(np.uint64), h), np.where(done, first[rep].astype(np.uint64), piece)
            state = np.where(done, _DONE, np.where(apart, _OPEN + _APART, _OPEN)).astype(np.uint8)
            yield deal((key % np.uint64(n_buckets)).astype(np.int64), n_buckets, [x, y, ids, first, left, n, state])

    return run


_FOUND = {"doc_id": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "src_doc": pa.int64(), "src_lo": pa.int32(), "anchor": pa.int64(), "pos": pa.int32()}
_FOUND_DDL = "doc_id long, lo int, hi int, src_doc long, src_lo int, anchor long, pos int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents after the first that holds them (anchor null), and the first's where its anchor branches; lo, hi are edges.

    Of a frequent anchor the first's go on in any case, as its other pieces are in other tasks.
    """
    got = gather(batches, _ENTRY)
    if got is None:
        return
    apart, got[6] = got[6] >= _APART, got[6] % np.uint8(_APART)
    i = np.flatnonzero(got[6] == _DONE)
    if len(i):
        src, at, doc, lo, n = (got[c][i] for c in (0, 1, 2, 3, 5))
        yield batch(_FOUND, doc_id=doc, lo=lo, hi=lo + n, src_doc=src.view(np.int64), src_lo=at.astype(np.int32), anchor=pa.nulls(len(i), pa.int64()), pos=lo)
    order = np.flatnonzero(got[6] == _OPEN)
    order = order[np.argsort(got[0][order], kind="stable")]
    s = got[0][order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    twin |= apart[order]
    order = order[twin]
    order = order[np.lexsort((got[3][order], got[2][order], got[1][order], got[0][order]))]
    h, piece, doc, lo, left, n, _ = (c[order] for c in got)
    if not len(h):
        return
    new_h = np.r_[True, h[1:] != h[:-1]]
    new = new_h | np.r_[True, piece[1:] != piece[:-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(h)])
    src = np.repeat(start, size)  # first by document, then by place
    later = doc != doc[src]
    h_start = np.flatnonzero(new_h)
    h_size = np.diff(np.r_[h_start, len(h)])
    branches = np.repeat(np.add.reduceat(new, h_start) > 1, h_size)
    several = np.repeat(np.minimum.reduceat(doc, h_start) != np.maximum.reduceat(doc, h_start), h_size)
    i = np.concatenate([np.flatnonzero(later), np.flatnonzero(~later & (branches & several | apart[order]))])
    ask = np.arange(len(i)) >= later.sum()
    yield batch(_FOUND, doc_id=doc[i], lo=lo[i], hi=(lo + n)[i], src_doc=doc[src[i]], src_lo=lo[src[i]], anchor=pa.array(h.view(np.int64)[i], mask=~ask), pos=(lo + left)[i])


def _asked(batches: Iterator[pa.RecordBatch], k: int, m: int, hot: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a stretch of text's asked pieces: anchor, document, place of the anchor, and a hash of each edge that can reach it (0: none)."""
    reach = k - m
    for b in batches:
        at, (lo, hi, anchor, pos, busy) = nested(b, "asked", ["lo", "hi", "anchor", "pos", "hot"])
        for row, t in texts(b):
            n = np.diff(at)[row : row + len(t.ids)]
            i = np.arange(at[row], at[row + len(n)])
            some = busy[i].astype(bool) == hot
            if not some.any():
                continue
            w = Words(t)
            g = w.grams(k)
            i, base, ids = i[some], np.repeat(w.at[:-1], n)[some], np.repeat(t.ids, n)[some]
            p = pos[i].astype(np.int64)
            hashes = np.zeros((len(i), reach + 1), np.uint64)
            for j in range(reach + 1):
                first = p - reach + j
                ok = (first >= lo[i]) & (first < hi[i])
                hashes[ok, j] = g[(base + first)[ok]] | np.uint64(1)
            yield np.ascontiguousarray(anchor[i]).astype(np.int64).view(np.uint64), ids, pos[i].astype(np.int32), hashes


def _edges(k: int, m: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _asked(batches, k, m, False):
            yield deal((cols[0] % np.uint64(n_buckets)).astype(np.int64), n_buckets, list(cols))

    return run


_LONE = [np.uint64, np.int64, np.int32, np.int64, np.int32, np.uint8]  # edge, document, place, source's document and place, state


def _lone_edges(k: int, m: int, n_buckets: int):
    """Each edge of the pieces whose anchor has very many, dealt by a hash of anchor, place in the piece and edge."""
    reach = k - m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, ids, pos, hashes in _asked(batches, k, m, True):
            i, j = np.nonzero(hashes)
            first = (pos[i] - reach + j).astype(np.int32)
            o = np.lexsort((first, ids[i]))
            i, j, first = i[o], j[o], first[o]
            edge, doc = mix(hashes[i, j] ^ mix(h[i] + j.astype(np.uint64))), ids[i]
            rep, _ = combined([edge], doc)
            done = doc != doc[rep]
            bucket = (np.where(done, mix(doc.view(np.uint64) + i.astype(np.uint64)), edge) % np.uint64(n_buckets)).astype(np.int64)
            yield deal(bucket, n_buckets, [edge, doc, first, doc[rep], first[rep], np.where(done, _DONE, _OPEN).astype(np.uint8)])

    return run


def _lone_branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of documents after the first that holds them, each a piece of its own."""
    got = gather(batches, _LONE)
    if got is None:
        return
    edge, doc, first, src_doc, src_lo, state = got
    src_doc, src_lo, later = src_doc.copy(), src_lo.copy(), state == _DONE
    i = np.flatnonzero(~later)
    i = i[np.lexsort((first[i], doc[i], edge[i]))]
    start, size = runs(edge[i])
    src = i[np.repeat(start, size)]
    src_doc[i], src_lo[i], later[i] = doc[src], first[src], doc[i] != doc[src]
    kinds = {x: _FOUND[x] for x in ("doc_id", "lo", "hi", "src_doc", "src_lo")}
    yield batch(kinds, doc_id=doc[later], lo=first[later], hi=first[later] + 1, src_doc=src_doc[later], src_lo=src_lo[later])


def _branched(k: int, m: int):
    reach = k - m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, [np.uint64, np.int64, np.int32, np.uint64])
        if got is None:
            return
        h, doc, pos, hashes = got
        hashes = hashes.reshape(-1, reach + 1)
        src_doc, src_pos = np.full(hashes.shape, -1, np.int64), np.zeros(hashes.shape, np.int32)
        marked = np.zeros(hashes.shape, bool)
        for j in range(reach + 1):
            i = np.flatnonzero(hashes[:, j])
            i = i[np.lexsort((pos[i], doc[i], hashes[i, j], h[i]))]
            if not len(i):
                continue
            new = np.r_[True, (h[i][1:] != h[i][:-1]) | (hashes[i, j][1:] != hashes[i, j][:-1])]
            start = np.flatnonzero(new)
            first = i[np.repeat(start, np.diff(np.r_[start, len(i)]))]
            src_doc[i, j], src_pos[i, j] = doc[first], pos[first]
            marked[i, j] = doc[i] != doc[first]
        # consecutive edges with one source are one piece
        same = np.zeros(hashes.shape, bool)
        same[:, 1:] = marked[:, 1:] & marked[:, :-1] & (src_doc[:, 1:] == src_doc[:, :-1]) & (src_pos[:, 1:] == src_pos[:, :-1])
        begins, ends = marked & ~same, marked.copy()
        ends[:, :-1] &= ~same[:, 1:]
        (i, j), (_, e) = np.nonzero(begins), np.nonzero(ends)
        kinds = {x: _FOUND[x] for x in ("doc_id", "lo", "hi", "src_doc", "src_lo")}
        yield batch(kinds, doc_id=doc[i], lo=pos[i] - reach + j, hi=pos[i] - reach + e + 1, src_doc=src_doc[i, j], src_lo=src_pos[i, j] - reach + j)

    return run


def pieces(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, few: int = FEW_ENTRIES) -> DataFrame:
    """doc_id, lo, hi (edges, by their first word), src_doc, src_lo: edges of a document that an earlier one holds; each is in one piece.

    few: entries of an anchor that are never dealt apart.
    """
    docs, n = docs.select("doc_id", "text").filter("doc_id is not null"), parts(docs.sparkSession)
    often = frequent(docs, _counted(k, m), few)
    met = by_bucket(docs.mapInArrow(_find_pieces(k, m, n, often), dealt_schema(len(_ENTRY))), n)
    found = cut(met.mapInArrow(_settle, _FOUND_DDL))
    open_ = found.filter("anchor is not null")
    busy = cut(open_.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")))
    open_ = open_.join(busy, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = cut(open_.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "anchor", "pos", "hot")).alias("asked")))
    met, ddl = having_ids(docs, asked).join(asked, "doc_id"), "doc_id long, lo int, hi int, src_doc long, src_lo int"
    more = by_bucket(met.mapInArrow(_edges(k, m, n), dealt_schema(4)), n).mapInArrow(_branched(k, m), ddl)
    if busy.take(1):
        more = more.unionByName(by_bucket(met.mapInArrow(_lone_edges(k, m, n), dealt_schema(len(_LONE))), n).mapInArrow(_lone_branched, ddl))
    cols = ["doc_id", "lo", "hi", "src_doc", "src_lo"]
    return found.filter("anchor is null").select(*cols).unionByName(more)


def paths(found: DataFrame, k: int = K) -> DataFrame:
    """doc_id, lo, hi (words), src_doc, src_lo of the paths that pieces compact to, by joins of each piece with its neighbour."""
    line = ["doc_id", "src_doc", "shift"]
    found = found.withColumn("shift", F.col("lo") - F.col("src_lo"))
    starts = found.select(*line, F.col("lo").alias("at"), F.lit(True).alias("starts"))
    ends = found.select(*line, F.col("hi").alias("at"), F.lit(True).alias("ends"))
    bare = cut(starts.join(ends, [*line, "at"], "full_outer").filter("starts is null or ends is null").distinct())
    nth = F.row_number().over(Window.partitionBy(*line).orderBy("at"))
    heads = bare.filter("ends is null").select(*line, F.col("at").alias("lo"), nth.alias("nth"))
    tails = bare.filter("starts is null").select(*line, F.col("at").alias("last"), nth.alias("nth"))
    out = heads.join(tails, [*line, "nth"])
    return out.select("doc_id", "lo", (F.col("last") + k - 1).alias("hi"), "src_doc", (F.col("lo") - F.col("shift")).alias("src_lo"))


RANGES = 4096  # of one document, digested by one row


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"at_doc": pa.int64(), "at_lo": pa.int32(), "at_hi": pa.int32(), "digest": pa.binary()}
    for b in batches:
        at, (lo, hi) = nested(b, "asked", ["lo", "hi"])
        for row, t in texts(b):
            rows = {x: [] for x in kinds}
            for i, doc_id in enumerate(t.ids.tolist()):
                words = t.text(i).split()
                for x, y in zip(lo[at[row + i] : at[row + i + 1]].tolist(), hi[at[row + i] : at[row + i + 1]].tolist()):
                    for c, v in zip(kinds, (doc_id, x, y, blake2b(b" ".join(words[x:y]), digest_size=16).digest())):
                        rows[c].append(v)
            yield batch(kinds, **rows)


def verified(spans: DataFrame, docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The spans without those of at least min_words whose words differ from their source's."""
    spans = cut(spans)
    long = spans.filter(F.col("hi") - F.col("lo") >= min_words).withColumn("src_hi", F.col("src_lo") + F.col("hi") - F.col("lo"))
    ends = long.select("doc_id", "lo", "hi").union(long.select("src_doc", "src_lo", "src_hi")).distinct()
    # a source of very many copies may have very many ranges: so many as a row takes, each with the text
    ends = ends.withColumn("part", F.pmod(F.xxhash64("lo", "hi"), F.ceil(F.count("*").over(Window.partitionBy("doc_id")) / RANGES)))
    asked = cut(ends.groupBy("doc_id", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("asked")).drop("part"))
    texts_ = having_ids(docs.filter("doc_id is not null"), asked).dropDuplicates(["doc_id"])
    digest = cut(asked.join(texts_, "doc_id").mapInArrow(_digests, "at_doc long, at_lo int, at_hi int, digest binary"))
    at = lambda d, lo, hi, name: digest.select(F.struct(F.col("at_doc").alias(d), F.col("at_lo").alias(lo), F.col("at_hi").alias(hi)).alias(f"k{name}"), F.col("digest").alias(name))
    both = long.withColumn("kx", F.struct("doc_id", "lo", "hi")).join(at("doc_id", "lo", "hi", "x"), "kx")
    both = salted(cut(both.withColumn("ky", F.struct("src_doc", "src_lo", "src_hi"))), "ky", "doc_id", at("src_doc", "src_lo", "src_hi", "y"))
    cols = ["doc_id", "lo", "hi", "src_doc", "src_lo"]
    return spans.filter(F.col("hi") - F.col("lo") < min_words).select(*cols).unionByName(both.filter("x = y").select(*cols))


_OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}


def _drop_words(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, (lo, hi) = nested(b, "ranges", ["lo", "hi"])
            for row, t in texts(b):
                w = Words(t, hashes=False)
                rows = {k: [] for k in _OUT}
                for i, doc_id in enumerate(t.named.to_pylist()):
                    raw = t.text(i).split()  # the white space of bytes.split is the six characters of the contract
                    n = len(raw)
                    s, e = covered(lo[at[row + i] : at[row + i + 1]], hi[at[row + i] : at[row + i + 1]])
                    bounds = [0, *np.stack([s, e], 1).ravel().tolist(), n]
                    kept = [x for j in range(0, len(bounds), 2) for x in raw[bounds[j] : bounds[j + 1]]] if len(s) else raw
                    text = b" ".join(kept)
                    for k, v in zip(_OUT, (doc_id, n, n - len(kept), sha256(text).hexdigest() if digest else None, None if digest else text.decode())):
                        rows[k].append(v)
                assert int(w.at[-1]) == sum(rows["n_words"])
                kinds = {k: v for k, v in _OUT.items() if k != ("kept" if digest else "kept_sha256")}
                yield batch(kinds, **{k: rows[k] for k in kinds})

    return run


def dedup(docs: DataFrame, k: int = K, m: int = M, digest: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (digest) or kept: the words that stay, joined by one space."""
    docs = one_text_an_id(docs)
    spans = verified(paths(pieces(docs, k, m), k), docs)
    out = with_ranges(docs, spans)
    return out.mapInArrow(_drop_words(digest), "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string"))


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
