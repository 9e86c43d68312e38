"""What the operators share: tables, cut lineage, id filters of fixed size, and arrays dealt to partitions.

Many operators move millions of 64-bit hashes.  A hash per row costs far more in row overhead than in bytes, so map
tasks pack the entries of one bucket into binary columns (``deal``), Spark shuffles those few rows by bucket, and the
receiving task joins the arrays again (``gather``).  The number of buckets is the session's shuffle partitions, so a
bucket's size stays the same as the input and that setting grow together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, parts, shared_dir, table  # noqa: F401  (the operators' modules take them from here)

#: Bits of an id filter: at most 2**20 rows are ever broadcast (about 16 MB).
FILTER_BITS = 20
#: Text bytes that a task works on at a time, and values of an array that a sliding step works on.
CHUNK_BYTES = 1 << 20
STEP = 1 << 18


def id_bucket(col) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(1 << FILTER_BITS))


def having_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key may be in ids.key: a filter before a shuffle, never wrong for a row that is in.

    What is broadcast are hash buckets of ids, at most 2**FILTER_BITS longs whatever the input's size.
    """
    buckets = ids.select(id_bucket(key).alias("_b")).distinct()
    return docs.join(F.broadcast(buckets), id_bucket(key) == F.col("_b"), "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The other rows than those of having_ids."""
    buckets = ids.select(id_bucket(key).alias("_b")).distinct()
    return docs.join(F.broadcast(buckets), id_bucket(key) == F.col("_b"), "left_anti")


#: A key is hot if it holds more than 1 / HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 4096


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], total: int | None = None) -> DataFrame:
    """rows joined with groups, which have one row a key and its number of rows, n.

    Groups of hot keys (fewer than HOT_SHARE rows, without texts) are broadcast, so that their rows stay where they are;
    the others meet by a shuffle in which no key has more than 1 / HOT_SHARE of the rows.
    """
    total = (groups.agg(F.sum("n")).first()[0] or 0) if total is None else total
    hot = F.col("n") * HOT_SHARE > total
    big = F.broadcast(groups.filter(hot))
    rest = rows.join(F.broadcast(groups.filter(hot).select(*key)), key, "left_anti")
    return rows.join(big, key).unionByName(rest.join(groups.filter(~hot), key))


def salted(pairs: DataFrame, key: str, other: str, rows: DataFrame) -> DataFrame:
    """pairs joined with rows (one row a key): a hot key's pairs are dealt over several tasks, its row goes to each of them."""
    counts = pairs.groupBy(key).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    hot = counts.join(total).filter(F.col("n") * HOT_SHARE > F.col("total")).select(key, F.ceil(F.col("n") * HOT_SHARE / F.col("total")).alias("ways"))
    hot = F.broadcast(cut(hot))  # fewer than HOT_SHARE rows, of fewer than 2 * HOT_SHARE ways together
    ways = F.coalesce("ways", F.lit(1).cast("long"))
    left = pairs.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(other), ways)).drop("ways")
    right = rows.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))).drop("ways")
    return left.join(right, [key, "salt"]).drop("salt")


# ---------------------------------------------------------------- arrays in binary columns


def deal(bucket: np.ndarray, n: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each non-empty bucket: bucket int, then each column's entries as bytes, in their given order."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(bounds))
    arrays = [pa.array(full.astype(np.int32))]
    for c in cols:
        c = np.ascontiguousarray(c[order])
        raw, width = c.tobytes(), c.dtype.itemsize * (c.shape[1] if c.ndim == 2 else 1)
        arrays.append(pa.array([raw[bounds[i] * width : bounds[i + 1] * width] for i in full], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket"] + [f"c{i}" for i in range(len(cols))])


def dealt_schema(n: int) -> str:
    return "bucket int" + "".join(f", c{i} binary" for i in range(n))


def gather(batches: Iterator[pa.RecordBatch], dtypes: list) -> list[np.ndarray] | None:
    """All entries that reached this task; None if there are none."""
    got = [[] for _ in dtypes]
    for b in batches:
        for i in range(len(dtypes)):
            got[i] += [x.as_py() for x in b.column(f"c{i}") if x.is_valid]
    if not got[0]:
        return None
    return [np.frombuffer(b"".join(x), t) for x, t in zip(got, dtypes)]


#: Entries under one key that a task takes in any case.
FEW_ENTRIES = 1 << 12


def key_bucket(h: np.ndarray) -> np.ndarray:
    """Mixed first, as anchors are the least hashes of their windows."""
    return (mix(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def frequent(docs: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int = FEW_ENTRIES, share: int = 2 * HOT_SHARE) -> np.ndarray:
    """The hash buckets of ``frequent_counts``, in order."""
    return np.array(sorted(frequent_counts(docs, keys, least, share)), np.int64)


def frequent_counts(docs: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int = FEW_ENTRIES, share: int = 2 * HOT_SHARE) -> dict[int, int]:
    """The hash buckets (2**FILTER_BITS of them) in which a key of more than 2 / share of all keys, and of more than 2 * least, can be,
    and at most how many keys each of them holds.

    A task tells of the buckets that hold more than 1 / share of its own keys, so fewer than share.  What the tasks leave out
    of a bucket is at most 1 / share of all keys, so no such key is missed.  Fewer than share buckets reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(1 << FILTER_BITS, np.int64)
        for h in keys(batches):
            load += np.bincount(key_bucket(h), minlength=len(load))
        total = int(load.sum())
        if total:
            big = np.flatnonzero(load * share > total)
            yield batch({"at": pa.int64(), "n": pa.int64()}, at=np.r_[-1, big], n=np.r_[total, load[big]])

    sums = cut(docs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")))
    total = sums.filter("at = -1").first()
    if total is None:
        return {}
    left_out = total["n"] // share
    return {r["at"]: r["n"] + left_out for r in sums.filter((F.col("at") >= 0) & (F.col("n") > max(left_out, least))).collect()}


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket")


def batch(schema: dict, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in schema.items()], names=list(schema))


# ---------------------------------------------------------------- texts as bytes


class Texts:
    """Some documents' texts as one byte array: ids, buf, and each document's bounds at [i], [i + 1]. Null is empty.

    ``named`` are the ids as they came, with nulls; in ``ids`` a null is 0.
    """

    def __init__(self, ids: np.ndarray, buf: np.ndarray, at: np.ndarray, named: pa.Array | None = None):
        self.ids, self.buf, self.at = ids, buf, at
        self.named = pa.array(ids, pa.int64()) if named is None else named

    def text(self, i: int) -> bytes:
        return self.buf[self.at[i] : self.at[i + 1]].tobytes()


def _column(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column."""
    a = b.column(name)
    a = a.cast(pa.large_binary() if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else pa.binary())
    if a.null_count:
        a = a.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    _, off, data = a.buffers()
    at = np.frombuffer(off, wide)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def texts(b: pa.RecordBatch, key: str = "doc_id", col: str = "text", limit: int = 0) -> Iterator[tuple[int, Texts]]:
    """The batch in pieces of about CHUNK_BYTES (whole documents), each with the row at which it starts."""
    limit = limit or CHUNK_BYTES
    named = b.column(key)
    ids = (named.fill_null(0) if named.null_count else named).to_numpy(zero_copy_only=False)
    buf, at = _column(b, col)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, Texts(ids[i:j], buf[at[i] : at[j]], at[i : j + 1] - at[i], named.slice(i, j - i))
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, kept for the worker's next pieces."""
    if not _POW or len(_POW[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[:] = out
    return _POW[0], _POW[1]


def sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of buf[i:j] is (s[j] - s[i]) * inverse_power[i]."""
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=s[1:])
    return s


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each of buf[start:end], spans in order and apart; so many at a time as fill a step of the text."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # running sums of a whole long text would be 16 times its size
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + STEP, "right")))
        lo, hi = start[i:j] - base, end[i:j] - base
        s = sums(buf[base : base + int(hi[-1])])
        out[i:j] = mix((s[hi] - s[lo]) * powers(len(s))[1][lo])
        i = j
    return out


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of Texts: start, end (bytes), hash, and each document's bounds in them.

    space: which bytes stand between words, if others than white space do.
    """

    def __init__(self, t: Texts, lower: bool = False, hashes: bool = True, space: np.ndarray = _SPACE):
        buf = _LOWER[t.buf] if lower else t.buf
        n = len(buf)
        gap = np.ones(n + 1, bool)  # gap[i]: byte i - 1 can't belong to the word of byte i
        solid = ~space[buf]
        first = np.zeros(n + 1, bool)
        first[t.at] = True
        gap[1:n] = ~solid[:-1] if n else gap[1:n]
        gap |= first
        self.start = np.flatnonzero(solid & gap[:n])
        after = np.ones(n, bool)
        if n:
            after[:-1] = ~solid[1:]
            after |= first[1:]
        self.end = np.flatnonzero(solid & after) + 1
        self.at = np.searchsorted(self.start, t.at)
        if hashes:
            self.hash = span_hashes(buf, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def grams(self, k: int) -> np.ndarray:
        """A hash at each word for it and the k - 1 after it (those that cross a document's end are meaningless)."""
        h, n = self.hash, len(self.hash)
        g = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            g = g * np.uint64(_BASE) + h[i : n - k + 1 + i] if n >= k else g
        return mix(g)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values (block prefixes and suffixes, so linear for any w)."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    b = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] values, then those of the next range, and so on."""
    keep = length > 0
    start, length = start[keep], length[keep]
    if not len(start):
        return np.zeros(0, np.int64)
    step = np.ones(int(length.sum()), np.int64)
    step[0] = start[0]
    step[np.cumsum(length[:-1])] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(step)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return start, np.diff(np.r_[start, len(sorted_keys)])


def covered(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, end) as maximal runs; runs that touch are one."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, reach = start[o], np.maximum.accumulate(end[o])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def anchor_runs(h: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and of each the first window that has it and the one after the last.

    The anchor of a valid window of w consecutive hashes is the place of the least, the leftmost if there are several.  The
    choice depends on a window's content alone, so equal windows have the same anchor at the same place in them.
    Windows are taken STEP at a time, so working memory doesn't grow with a text.
    """
    low, out = np.uint64((1 << 24) - 1), []
    for lo in range(0, len(h) - w + 1, STEP):
        part = h[lo : lo + STEP + w - 1]
        least = slide_min((part & ~low) | np.arange(len(part), dtype=np.uint64), w)
        at = np.flatnonzero(valid[lo : lo + len(least)])
        a = (least[at] & low).astype(np.int64) + lo
        first, size = runs(a)  # anchors of successive windows never go back
        if len(first):
            out.append((a[first], at[first] + lo, at[first + size - 1] + lo + 1))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    a, u, v = (np.concatenate(c) for c in zip(*out))
    first, size = runs(a)
    return a[first], u[first], v[first + size - 1]


def anchors(h: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    return anchor_runs(h, w, valid)[0]


def combined(keys: list[np.ndarray], prefer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For entries with equal keys: each entry's representative (the first by ``prefer``, then by place) and how many share it.

    Before a shuffle this leaves a group that fills a third of a task's rows one entry; the others are settled on the spot.
    """
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((*([] if prefer is None else [prefer]), *keys))
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    first, many = np.empty(n, np.int64), np.empty(n, np.int64)
    first[order], many[order] = np.repeat(order[start], size), np.repeat(size, size)
    return first, many


def one_text_an_id(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the rows of a doc_id that comes with several texts all have the least of them (null is empty)."""
    docs, text = docs.select("doc_id", "text"), F.coalesce("text", F.lit(""))
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("x"), F.max(F.xxhash64(text)).alias("y"))
    several = cut(several.filter("x <> y").select("doc_id"))
    if not several.take(1):
        return docs
    rows = docs.join(several, "doc_id", "left_semi")
    least = rows.groupBy("doc_id").agg(F.min(text).alias("text"))
    return cut(docs.join(several, "doc_id", "left_anti").unionByName(rows.select("doc_id").join(least, "doc_id")))


def with_ranges(docs: DataFrame, found: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """docs (doc_id, text) and ranges array<struct<lo, hi>>: found's rows of that document, null if there are none.

    Only documents that may have ranges are shuffled with their texts.
    """
    per = cut(found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"))).alias("ranges")))
    hit = having_ids(docs, per).join(per, "doc_id", "left")
    kind = "array<struct<lo:int,hi:int>>"
    return hit.select("doc_id", "text", F.col("ranges").cast(kind)).unionByName(without_ids(docs, per).select("doc_id", "text", F.lit(None).cast(kind).alias("ranges")))


def nested(b: pa.RecordBatch, col: str, fields: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds and fields of a column of arrays of structs; null is empty."""
    a = b.column(col)
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = a.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]
