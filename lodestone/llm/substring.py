"""Removal of repeated byte strings by threshold-bounded interval expansion.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  Equal strings are found as on a
Burrows-Wheeler transform: suffixes in order, intervals of those that share a prefix, extended backwards breadth first,
the common prefixes' lengths taken in order until the least length decides.  To spread that over a cluster:

1. In each window of ``length`` bytes the k-gram of least hash (k = length / 2) is its anchor.  Equal windows have equal
   anchors at the same place, so everything that can repeat meets at its anchor.  Anchors are dealt by hash, each with a
   hash of its context: the bytes that windows with this anchor can reach.
2. Occurrences of an anchor with equal contexts are settled at once: all windows of that context repeat.  Those of one
   piece of text are settled before the shuffle, so a third of all rows with one text are an entry a piece.  One of each
   distinct context of an anchor goes on, if there are several; anchors that occur once are done.  Anchors are counted
   before: a frequent one (a licence line of very many documents, each with other surroundings) is dealt by its contexts.
3. The contexts that go on are dealt by anchor with their bytes.  In each anchor's interval the suffixes from the anchor
   on are sorted; neighbours' common prefixes are known.  Then the interval is extended backwards byte by byte: each
   step splits intervals by the preceding byte (the transform's column), keeps the order within, and takes the common
   prefix of new neighbours as the least between them.  At depth d a window repeats if a neighbour in its interval
   shares length - d bytes or more.  Intervals of one suffix leave the queue.
4. An anchor with more than ``hot`` distinct contexts (a passage of very many documents, in other surroundings each) would
   be one task's; there each window is dealt by a hash of its own, repeated ones being settled before the shuffle as in 2.

All steps are linear in the text or in the contexts that go on; working memory is a fixed step of a text.
Contexts and hot windows are compared by 64-bit hashes next to the 64-bit hash of their anchor: a false match among m
different contexts of one anchor has a chance of about m**2 / 2**65.
Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; rows that repeat a
doc_id are matched as documents of their own (if their texts differ, the least of them stands for all); a row without a doc_id is matched with nothing and keeps its text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, CHUNK_BYTES, FEW_ENTRIES, STEP, Texts, anchors, batch, by_bucket, combined, covered, cut, deal, dealt_schema, frequent, gather, having_ids, key_bucket, mix, nested, one_text_an_id, parts, powers, ranges, runs, sums, table, texts, with_ranges

LENGTH = 200
HOT = 1 << 14  # contexts of one anchor that one task expands; beyond it windows are dealt one by one


_ENTRY = [np.uint64, np.uint64, np.int64, np.int32, np.uint16, np.uint16, np.uint8]  # anchor, context, document, place, left, right, state
_OPEN, _TWICE, _DONE = 0, 1, 2  # an entry is alone in its piece of text, stands for several of it, or is one of these others
_APART = 4  # added to the state of entries whose anchor is frequent: they are dealt by context


def _entries(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a piece of text's anchors: hash, context, document, place, bytes before and after."""
    k = length // 2
    w = length - k + 1

    def of(t: Texts) -> list[np.ndarray]:
        """Anchors of the windows, STEP windows at a time: hash, hash of the context, place in t, bytes before and after."""
        n = len(t.buf)
        valid = np.ones(n - length + 1, bool)
        first = np.maximum(t.at[1:] - length + 1, 0)
        valid[ranges(first, np.minimum(t.at[1:], len(valid)) - first)] = False
        found, last = [], -1
        for lo in range(0, len(valid), STEP):
            hi = min(lo + STEP, len(valid))
            base, m = max(0, lo - w + 1), hi - lo + w - 1
            s = sums(t.buf[base : hi + w - 1 + length])
            inv, i = powers(len(s))[1], lo - base
            h = mix((s[i + k : i + k + m] - s[i : i + m]) * inv[i : i + m])
            a = anchors(h, w, valid[lo:hi]) + lo
            a = a[a > last]
            if len(a):
                last = int(a[-1])
                doc = np.searchsorted(t.at, a, "right") - 1
                x, y = np.maximum(t.at[doc], a - (w - 1)), np.minimum(t.at[doc + 1], a + length)
                left, right = (a - x).astype(np.uint16), (y - a).astype(np.uint16)
                x, y = x - base, y - base
                ctx = mix((s[y] - s[x]) * inv[x] ^ mix(left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)))
                found.append([h[a - lo], ctx, a, left, right])
        return [np.concatenate(c) for c in zip(*found)]

    for b in batches:
        for _, t in texts(b, limit=4 * CHUNK_BYTES):
            got = of(t) if len(t.buf) >= length else []
            if got:
                h, ctx, a, left, right = got
                doc = np.searchsorted(t.at, a, "right") - 1
                yield h, ctx, t.ids[doc], (a - t.at[doc]).astype(np.int32), left, right


def _counted(length: int):
    """The anchors of the entries that travel."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for h, ctx, *_ in _entries(batches, length):
            yield h[combined([h, ctx])[0] == np.arange(len(h))]

    return keys


def _find_anchors(length: int, n_buckets: int, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, ctx, doc, *rest in _entries(batches, length):
            apart = np.isin(key_bucket(h), often)
            bucket, state = _spread([h, ctx], doc, n_buckets, apart)
            yield deal(bucket, n_buckets, [h, ctx, doc, *rest, state | apart.astype(np.uint8) * np.uint8(_APART)])

    return run


def _spread(keys: list[np.ndarray], doc: np.ndarray, n_buckets: int, apart: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's bucket and state: one of equal entries goes where its first key is dealt (apart: all its keys), the others anywhere."""
    first, many = combined(keys)
    own = first == np.arange(len(first))
    state = np.where(~own, _DONE, np.where(many > 1, _TWICE, _OPEN)).astype(np.uint8)
    key = np.where(apart, mix(keys[0] ^ mix(keys[-1])), keys[0])
    key = np.where(own, key, mix(doc.view(np.uint64) + np.arange(len(doc), dtype=np.uint64)))
    return (key % np.uint64(n_buckets)).astype(np.int64), state


_FOUND = {"doc_id": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "anchor": pa.int64(), "pos": pa.int32()}
_FOUND_DDL = "doc_id long, lo int, hi int, anchor long, pos int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of contexts that occur twice or more (anchor null), and one of each other context of an anchor.

    Of a frequent anchor one of each context goes on in any case, as the others are in other tasks.
    """
    got = gather(batches, _ENTRY)
    if got is None:
        return
    apart, got[6] = got[6] >= _APART, got[6] % np.uint8(_APART)
    done = got[6] == _DONE
    if done.any():
        doc, p, le, ri = (got[c][done] for c in (2, 3, 4, 5))
        yield batch(_FOUND, doc_id=doc, lo=p - le.astype(np.int32), hi=p + ri.astype(np.int32), anchor=pa.nulls(len(doc), pa.int64()), pos=p)
    order = np.flatnonzero(~done)
    order = order[np.argsort(got[0][order], kind="stable")]
    s = got[0][order]
    twin = (got[6][order] == _TWICE) | apart[order]
    if len(s):
        twin[1:] |= s[1:] == s[:-1]
        twin[:-1] |= s[1:] == s[:-1]
    order = order[twin]
    order = order[np.lexsort((got[1][order], got[0][order]))]
    h, ctx, doc, pos, left, right, state = (c[order] for c in got)
    if not len(h):
        return
    new_ctx = np.r_[True, (ctx[1:] != ctx[:-1]) | (h[1:] != h[:-1])]
    start = np.flatnonzero(new_ctx)
    size = np.diff(np.r_[start, len(h)])
    several = np.repeat((size > 1) | (np.maximum.reduceat(state, start) == _TWICE), size)
    _, per_anchor = runs(h[start])
    first = start[np.repeat(per_anchor > 1, per_anchor) | apart[order][start]]
    i = np.concatenate([np.flatnonzero(several), first])
    ask = np.arange(len(i)) >= several.sum()
    p, le, ri = pos[i], left[i].astype(np.int32), right[i].astype(np.int32)
    yield batch(_FOUND, doc_id=doc[i], lo=p - le, hi=p + ri, anchor=pa.array(h.view(np.int64)[i], mask=~ask), pos=p)


def _asked(batches: Iterator[pa.RecordBatch], length: int, hot: bool, size: int = 4096):
    """The asked contexts of texts, some at a time: anchor, document, place, bytes before and after, and the bytes themselves."""
    back = length - length // 2
    for b in batches:
        at, (lo, hi, anchor, pos, busy) = nested(b, "asked", ["lo", "hi", "anchor", "pos", "hot"])
        h, busy = np.ascontiguousarray(anchor).astype(np.int64).view(np.uint64), busy.astype(bool)
        for row, t in texts(b):
            n = np.diff(at)[row : row + len(t.ids)]
            doc = np.repeat(np.arange(len(n)), n)
            every = np.flatnonzero(busy[at[row] : at[row + len(n)]] == hot)
            for j in range(0, len(every), size):
                some = every[j : j + size]
                i, d = at[row] + some, doc[some]
                left, right = (pos[i] - lo[i]).astype(np.uint16), (hi[i] - pos[i]).astype(np.uint16)
                wide = np.zeros((len(i), back + length), np.uint8)
                wholes = (hi[i] - lo[i]).astype(np.int64)
                to = ranges(np.arange(len(i)) * (back + length) + back - left.astype(np.int64), wholes)
                wide.ravel()[to] = t.buf[ranges(t.at[d] + lo[i], wholes)] + np.uint8(1)  # UTF-8 has no 0xFF, so 0 is no byte's
                yield h[i], t.ids[d], pos[i].astype(np.int32), left, right, wide


def _contexts(length: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _asked(batches, length, False):
            yield deal((cols[0] % np.uint64(n_buckets)).astype(np.int64), n_buckets, list(cols))

    return run


def _windows(length: int, n_buckets: int):
    """Each window of a context whose anchor has very many contexts, dealt by a hash of anchor, depth and bytes."""
    back = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, pos, left, right, wide in _asked(batches, length, True, 1024):
            pw, inv = powers(back + length + 1)
            s = np.zeros((len(h), back + length + 1), np.uint64)
            np.cumsum(BYTE[wide] * pw[: back + length], axis=1, out=s[:, 1:])
            i, j = np.nonzero((np.arange(back + 1) >= back - left.astype(np.int64)[:, None]) & (np.arange(back + 1) + length <= back + right.astype(np.int64)[:, None]))
            key = mix((s[i, j + length] - s[i, j]) * inv[j] ^ mix(h[i] + j.astype(np.uint64)))
            bucket, state = _spread([key], doc[i], n_buckets)
            yield deal(bucket, n_buckets, [key, doc[i], (pos[i] - back + j).astype(np.int32), state])

    return run


def _twice(length: int):
    """The windows that occur twice or more, merged where they are of one document and touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, [np.uint64, np.int64, np.int32, np.uint8])
        if got is None:
            return
        key, doc, lo, state = got
        again = state != _OPEN
        i = np.flatnonzero(state != _DONE)
        i = i[np.argsort(key[i], kind="stable")]
        start, size = runs(key[i])
        again[i] |= np.repeat(size > 1, size)
        i = np.flatnonzero(again)
        i = i[np.lexsort((lo[i], doc[i]))]
        if len(i):
            opens = np.flatnonzero(np.r_[True, (doc[i][1:] != doc[i][:-1]) | (lo[i][1:] > lo[i][:-1] + length)])
            last = np.r_[opens[1:] - 1, len(i) - 1]
            yield batch({"doc_id": pa.int64(), "lo": pa.int32(), "hi": pa.int32()}, doc_id=doc[i][opens], lo=lo[i][opens], hi=lo[i][last] + length)

    return run


def expand(h: np.ndarray, left: np.ndarray, right: np.ndarray, wide: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest depth at which each context's window repeats; greatest -1 if it never does.

    wide: bytes (plus one) before and after the anchor's start, which is column ``back``; 0 where the text ends.
    """
    back = wide.shape[1] - length
    key = np.empty((len(h), 8 + length), np.uint8)
    key[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8:] = wide[:, back:]
    order = np.argsort(key.view(f"S{8 + length}").ravel(), kind="stable")
    least, most = np.full(len(h), length, np.int32), np.full(len(h), -1, np.int32)
    lcp = np.zeros(len(h), np.int32)
    for lo in range(1, len(h), 1 << 16):
        x, y = order[lo - 1 : lo - 1 + (1 << 16)], order[lo : lo + (1 << 16)]
        x = x[: len(y)]
        differ = key[x, 8:] != key[y, 8:]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        lcp[lo : lo + len(y)] = np.minimum(np.minimum(first, right[x]), right[y])
    group = np.cumsum(np.r_[True, h[order][1:] != h[order][:-1]]) - 1
    for d in range(back + 1):
        if d:
            keep = left[order] >= d
            byte = wide[order, back - d].astype(np.int64)
            part = group * 256 + byte
            at = np.flatnonzero(keep)
            at = at[np.argsort(part[at], kind="stable")]
            part = part[at]
            same = np.zeros(len(at), bool)
            same[1:] = part[1:] == part[:-1]
            lone = ~same
            lone[:-1] &= ~same[1:]
            at, part, same = at[~lone], part[~lone], same[~lone]
            if not len(at):
                break
            new = np.zeros(len(at), np.int32)
            t = np.flatnonzero(same)
            if len(t):
                span = np.empty(2 * len(t), np.int64)
                span[::2], span[1::2] = at[t - 1] + 1, at[t] + 1
                new[t] = np.minimum.reduceat(np.r_[lcp, np.int32(0)], span)[::2]
            lcp, order, group = new, order[at], np.cumsum(~same) - 1
            together = same
        else:
            together = np.r_[False, group[1:] == group[:-1]]
        hit = together & (lcp >= length - d)
        hit[:-1] |= hit[1:]
        i = order[hit]
        least[i] = np.minimum(least[i], d)
        most[i] = d
    return least, most


def _expanded(length: int):
    back = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, [np.uint64, np.int64, np.int32, np.uint16, np.uint16, np.uint8])
        if got is None:
            return
        h, doc, pos, left, right, wide = got
        wide = wide.reshape(-1, back + length)
        turn = (h >> np.uint64(20)) % np.uint64(max(1, len(h) // 200_000))  # whole anchors, some at a time
        for r in range(int(turn.max()) + 1):
            i = np.flatnonzero(turn == r)
            if len(i):
                least, most = expand(h[i], left[i], right[i], wide[i], length)
                i, least, most = i[most >= 0], least[most >= 0], most[most >= 0]
                yield batch({"doc_id": pa.int64(), "lo": pa.int32(), "hi": pa.int32()}, doc_id=doc[i], lo=pos[i] - most, hi=pos[i] - least + length)

    return run


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, few: int = FEW_ENTRIES) -> DataFrame:
    """doc_id, lo, hi: byte ranges whose every byte is in a repeated string; they may overlap. few: entries of an anchor that are never dealt apart."""
    docs, n = docs.select("doc_id", "text").filter("doc_id is not null"), parts(docs.sparkSession)
    often = frequent(docs, _counted(length), few)
    met = by_bucket(docs.mapInArrow(_find_anchors(length, n, often), dealt_schema(len(_ENTRY))), n)
    found = cut(met.mapInArrow(_settle, _FOUND_DDL))
    open_ = found.filter("anchor is not null")
    busy = cut(open_.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")))
    open_ = open_.join(busy, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = cut(open_.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "anchor", "pos", "hot")).alias("asked")))
    met = having_ids(docs, asked).join(asked, "doc_id")
    ranges_ddl = "doc_id long, lo int, hi int"
    more = by_bucket(met.mapInArrow(_contexts(length, n), dealt_schema(6)), n).mapInArrow(_expanded(length), ranges_ddl)
    if busy.take(1):
        more = more.unionByName(by_bucket(met.mapInArrow(_windows(length, n), dealt_schema(4)), n).mapInArrow(_twice(length), ranges_ddl))
    return found.filter("anchor is null").select("doc_id", "lo", "hi").unionByName(more)


_OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _cut_out(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, (lo, hi) = nested(b, "ranges", ["lo", "hi"])
            for row, t in texts(b):
                rows = {k: [] for k in _OUT}
                for i, doc_id in enumerate(t.named.to_pylist()):
                    raw = t.text(i)
                    s, e = covered(lo[at[row + i] : at[row + i + 1]], hi[at[row + i] : at[row + i + 1]])
                    bounds = [0, *np.stack([s, e], 1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[bounds[j] : bounds[j + 1]] for j in range(0, len(bounds), 2)) if len(s) else raw
                    for k, v in zip(_OUT, (doc_id, len(raw), len(raw) - len(kept), len(s), sha256(kept).hexdigest() if digest else None, None if digest else kept)):
                        rows[k].append(v)
                kinds = {k: v for k, v in _OUT.items() if k != ("kept" if digest else "kept_sha256")}
                yield batch(kinds, **{k: rows[k] for k in kinds})

    return run


def dedup(docs: DataFrame, length: int = LENGTH, digest: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (digest) or kept binary: what is left of each text."""
    docs = one_text_an_id(docs)
    out = with_ranges(docs, repeats(docs, length))
    return out.mapInArrow(_cut_out(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
