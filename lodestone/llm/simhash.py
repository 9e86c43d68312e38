"""Near-duplicates by SimHash fingerprints, linked through tables of distances to many reference fingerprints.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have it.  Two fingerprints link if
they differ in ``FAR`` bits or fewer.

1. Equal fingerprints become one, represented by the smallest doc_id.
2. Each gets a row of a pivot table: its Hamming distances to ``REFERENCES``, which are the empty fingerprint and, in each
   byte, the seven patterns of a Walsh system.  By the triangle inequality linked fingerprints differ by FAR at most in
   every coordinate.  A byte's seven distances, less the distance to the empty one, depend on that byte alone, so two
   fingerprints that differ in two bits agree in all but two bytes' coordinates.
3. The table is dealt by coordinates: of its four pairs of neighbouring bytes two at least agree, which makes six keys.
   Fingerprints that share a key meet.  A key of more than ``BIG`` fingerprints is dealt anew by the coordinates of its
   four other bytes, two of which agree again, so that its fingerprints are in no task together; as all are different, at
   most 2**16 of them share such a key whatever the input.
4. Within a key rows are in order of their first coordinate; pairs are discarded while the largest difference of their
   coordinates is over FAR, and those that survive are verified bit by bit.  A key passes on a star for each group that
   is connected in it, so no more links than fingerprints.
5. Links are closed to components as in the Jaccard join, and the groups are given back to the documents.

No link is lost, as step 3 holds for every pair, and nothing is capped.  Defined results: null and blank texts have
fingerprint zero and link like any other; fewer words than k are one shingle; a row without a doc_id has its fingerprint,
links with nothing and has no component; rows that repeat a doc_id repeat, and if their texts differ the least of them
stands for all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import CHUNK_BYTES, batch, cut, mix, one_text_an_id, parts, ranges, table, with_groups
from .jaccard import components

K = 3
SEED = 42
FAR = 2
BIG = 1024  # fingerprints of a key that are compared without dealing them anew
GROUPED = 1 << 16  # rows that are compared at a time

_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: The Walsh patterns of a byte: bit i of pattern j is set if i & j has an even number of bits.
_WALSH = [sum(1 << i for i in range(8) if (i & j).bit_count() % 2 == 0) for j in range(1, 8)]
REFERENCES = np.array([0] + [w << (8 * b) for b in range(8) for w in _WALSH], np.uint64)
_TWO_OF_FOUR = list(combinations(range(4), 2))
_LANES = np.uint64(0x0001000100010001)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- fingerprints


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The text's words, lower-cased, of about size bytes at a time."""
    lo = 0
    while lo < len(text):
        gap = _GAP.search(text, lo + size)
        hi = gap.start() if gap else len(text)
        yield text[lo:hi].lower().split()
        lo = hi


def hashes(text: bytes, k: int = K, size: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included; working memory doesn't grow with the text."""
    held, some = [], False
    for words in _pieces(text, size):
        held += words
        n = len(held) - k + 1
        if n > 0:
            yield np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(held[i:] for i in range(k)))), repeat(SEED)), np.uint64, n)
            held, some = held[n:], True
    if held and not some:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def _bits(h: np.ndarray, doc: np.ndarray, size: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts (documents x 64) how often each bit is set in runs of h, which have these documents and sizes.

    Four bits are counted at once in lanes of 16 bits, so a run is taken in stretches of less than 2**16 values.
    """
    most = (1 << 16) - 1
    many = -(-size // most)
    doc = np.repeat(doc, many)
    step = ranges(np.zeros(len(many), np.int64), many) * most
    start = np.repeat(np.cumsum(size) - size, many) + step
    for b in range(16):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, start)
        for lane in range(4):
            np.add.at(counts[:, b + 16 * lane], doc, ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))


def fingerprints_of(texts: list[bytes | None], k: int = K, step: int = 1 << 18) -> np.ndarray:
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, doc, n = [], [], 0

    def flush() -> None:
        nonlocal held, doc, n
        if held:
            _bits(np.concatenate(held), np.array(doc), np.array([len(h) for h in held]), counts)
        held, doc, n = [], [], 0

    for i, text in enumerate(texts):
        for h in hashes(text or b"", k):
            held.append(h)
            doc.append(i)
            total[i] += len(h)
            n += len(h)
            if n >= step:
                flush()
    flush()
    over = 2 * counts > total[:, None]
    return (over.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fp long: the fingerprint's 64 bits."""
    schema = {"doc_id": pa.int64(), "fp": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                raw = part.column("text").to_pylist()
                yield batch(schema, doc_id=part.column("doc_id"), fp=fingerprints_of(raw, k).view(np.int64))

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- links by the pivot table


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances to REFERENCES for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None])


def _byte_codes(fp: np.ndarray) -> np.ndarray:
    """(n, 8): each byte's coordinates, less the first one, as one number."""
    d = distances(fp).astype(np.int64)
    own = (d[:, 1:] - d[:, :1]).reshape(len(fp), 8, len(_WALSH)) + 8
    return (own << (np.arange(len(_WALSH)) * 5)).sum(axis=2).astype(np.uint64)


def _hash(*cols) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        h = mix((h + np.uint64(1)) * _ODD ^ c)
    return h


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, key, fp, rep: six rows a fingerprint, one for each two of its four pairs of bytes."""
    schema = {"pair": pa.int32(), "key": pa.int64(), "fp": pa.int64(), "rep": pa.int64()}
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        code = _byte_codes(fp)
        for no, (i, j) in enumerate(_TWO_OF_FOUR):
            key = _hash(np.full(len(fp), no, np.uint64), *(code[:, c] for c in (2 * i, 2 * i + 1, 2 * j, 2 * j + 1)))
            yield batch(schema, pair=np.full(len(fp), no, np.int32), key=key.view(np.int64), fp=b.column("fp"), rep=b.column("rep"))


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, fp, rep: six rows for each row of a key of many, one for each two of the four bytes that the key leaves open."""
    schema = {"key": pa.int64(), "fp": pa.int64(), "rep": pa.int64()}
    for b in batches:
        fp, pair = b.column("fp").to_numpy().view(np.uint64), b.column("pair").to_numpy()
        code, key = _byte_codes(fp), b.column("key").to_numpy().view(np.uint64)
        left = np.array([[x for q in range(4) if q not in two for x in (2 * q, 2 * q + 1)] for two in _TWO_OF_FOUR])[pair]
        own = np.take_along_axis(code, left, axis=1)
        for no, (i, j) in enumerate(_TWO_OF_FOUR):
            finer = _hash(key, np.full(len(fp), no, np.uint64), own[:, i], own[:, j])
            yield batch(schema, key=finer.view(np.int64), fp=b.column("fp"), rep=b.column("rep"))


def near_pairs(key: np.ndarray, fp: np.ndarray, far: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one key that differ in far bits or fewer; rows lie in order of key and first coordinate."""
    d = distances(fp).astype(np.int8)
    out = []
    i, lag = np.arange(len(fp)), 0
    while len(i):
        lag += 1
        i = i[i + lag < len(fp)]
        i = i[(key[i] == key[i + lag]) & (d[i + lag, 0] - d[i, 0] <= far)]  # later rows are farther still
        near = i[(np.abs(d[i] - d[i + lag]) <= far).all(axis=1)]  # the pivot table's bound
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= far]
        out.append((near, near + lag))
    return tuple(np.concatenate([p[s] for p in out]) if out else np.zeros(0, np.int64) for s in (0, 1))


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n places the least one that it is connected with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        for side in (i, j, root[i], root[j]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _met(far: int):
    schema = {"a": pa.int64(), "b": pa.int64()}

    def linked(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((np.bitwise_count(fp.view(np.uint64)), key))
        key, fp, rep = key[order], fp[order].view(np.uint64), rep[order]
        root = _stars(len(fp), *near_pairs(key, fp, far))
        at = np.flatnonzero(root != np.arange(len(fp)))
        return batch(schema, a=rep[root[at]], b=rep[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("key", "fp", "rep")])
            n += len(b)
            if n >= GROUPED:  # all but the last key are whole
                cols = [np.concatenate(c) for c in zip(*held)]
                at = int(np.searchsorted(cols[0], cols[0][-1]))
                if at:
                    yield linked(*(c[:at] for c in cols))
                held, n = [[c[at:] for c in cols]], n - at
        if n:
            yield linked(*(np.concatenate(c) for c in zip(*held)))

    return run


def links(distinct: DataFrame, far: int = FAR, big: int = BIG) -> DataFrame:
    """a, b (rep) of fingerprints (fp, rep, all different) such that near ones are connected, and only by near ones."""
    if far > 2:
        raise ValueError("two of four pairs of bytes agree only up to two differing bits")
    keyed = cut(distinct.select("fp", "rep").mapInArrow(_keys, "pair int, key long, fp long, rep long"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    total = keyed.count()
    several = with_groups(keyed, shared, ["key"], total)
    again = several.filter(F.col("n") > big).select("pair", "key", "fp", "rep").mapInArrow(_finer, "key long, fp long, rep long")
    met = several.filter(F.col("n") <= big).select("key", "fp", "rep").unionByName(again)
    dealt = met.repartition(parts(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_met(far), "a long, b long").distinct()


def join(docs: DataFrame, k: int = K, far: int = FAR, big: int = BIG) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_same, the number of documents with the same fingerprint."""
    found = cut(fingerprints(one_text_an_id(docs), k))
    named = found.filter("doc_id is not null")
    groups = cut(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    at = components(cut(links(groups, far, big)))
    groups = groups.join(at, F.col("rep") == F.col("id"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    every = with_groups(named, cut(groups), ["fp"])
    none = found.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"), F.lit(1).cast("long").alias("n"))
    every = every.select("doc_id", "fp", "component_id", "n").unionByName(none)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("n_same"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
