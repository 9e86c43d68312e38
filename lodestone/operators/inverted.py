"""The stored inverted index: postings by shard and term in blocks, and top-k search that skips blocks.

places: shard, place, chunk_id, okey, terms.  A chunk's shard is a hash of its id; its place is its number there in corpus order.
postings: shard, term, n, top, first, last, entries, rows in order of shard and term.  A row is a block of at most BLOCK
    places of a term in a shard; top is the greatest impact there, first and last are its ends, entries are packed
    (place, tf, dl).  An impact is a posting's part of a BM25 score without idf.
terms: term, df, top, kth.  kth is an impact that TOP chunks have at least, so a question with this term has TOP chunks of
    idf * kth or more: a lower bound that all shards share before any is read.

A search reads the blocks of asked terms only.  Shards are searched apart, each by a task that takes its questions' terms by
falling bounds: while the terms that are left could make a new chunk one of the best, their lists are added whole; then only
chunks that can still be among the best are looked for, in blocks that hold some.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import text as X
from ..plans.tables import parts
from .retrieve import B, CANDIDATES, K1, search_text, with_terms

SHARD = 16_384  # chunks
SHARD_TERMS = 1 << 20  # of a shard's chunks together, about: what a task that builds its lists holds
BLOCK = 128
TOP = CANDIDATES
GROUP_BYTES = 4 << 20  # of a Parquet row group: what a pushed-down term filter reads at least
#: Asked pairs of question and term that go to every task at once; more are searched in rounds.
PAIRS = 200_000
EACH_TERM, SOME_TERMS = 64, 1024  # terms that are pushed down one by one, and as a list
NEAR = 1e-8  # scores are ranked at nine decimals


def impact(tf, dl, avgdl: float, k1: float = K1, b: float = B):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def placed(chunks: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """places of chunks (chunk_id, okey, and terms or a text to take them from)."""
    terms = F.size("terms") if "terms" in chunks.columns else F.length(search_text()) / 6  # texts aren't split for this
    n = F.broadcast(chunks.agg(F.greatest(F.ceil(F.count("*") / per_shard), F.ceil(F.sum(terms) / SHARD_TERMS), F.lit(1)).alias("shards")))  # one row
    rows = with_terms(chunks, ["chunk_id", "okey"]).join(n)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.col("shards")).cast("int")).drop("shards")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("okey", "chunk_id")) - 1)


_POSTINGS = "shard int, term string, n int, top double, first int, last int, kth double, entries binary"


def blocks(places: DataFrame, avgdl: float, top: int = TOP, size: int = BLOCK) -> DataFrame:
    """postings (with kth, the term's top-th best impact in the shard), built where the places lie, without a shuffle."""

    def built(shard: int, place: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
        dl = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        names = words.dictionary.take(pc.sort_indices(words.dictionary))
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(names))
        code = rank[words.indices.to_numpy(zero_copy_only=False)] * len(dl)
        code += np.repeat(np.arange(len(dl)), dl)
        del words
        code.sort()
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[head, len(code)]).astype(np.int32)
        term, row = (x.astype(np.int32) for x in np.divmod(code[head], max(len(dl), 1)))
        del code, head
        part = impact(tf, dl[row], avgdl)
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        long = np.diff(np.r_[begin, len(term)])
        nth = np.arange(len(term)) - np.repeat(begin, long)
        start = np.flatnonzero(nth % size == 0)
        end = np.r_[start[1:], len(term)] if len(start) else start
        kth = np.zeros(len(long))
        for i in np.flatnonzero(long >= top):  # terms of at least top chunks
            kth[i] = np.partition(part[begin[i] : begin[i] + long[i]], -top)[-top]
        raw = np.empty((len(row), 3), np.int32)
        raw[:, 0], raw[:, 1], raw[:, 2] = place[row], tf, dl[row]
        cols = [
            pa.array(np.full(len(start), shard, np.int32)), names.take(pa.array(term[start])), pa.array((end - start).astype(np.int32)),
            pa.array(np.maximum.reduceat(part, start) if len(start) else np.zeros(0)), pa.array(raw[start, 0]), pa.array(raw[end - 1, 0] if len(start) else raw[start, 0]),
            pa.array(np.repeat(kth, -(-long // size))), pa.array([raw[i:j].tobytes() for i, j in zip(start, end)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "term", "n", "top", "first", "last", "kth", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, lists = None, [], []

        def out() -> pa.RecordBatch:
            return built(now, np.concatenate(place), pa.concat_arrays(lists))

        for b in batches:
            shard = b.column("shard").to_numpy()
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(b) else []
            for lo, hi in zip(edges, [*edges[1:], len(b)]):
                if shard[lo] != now and place:
                    yield out()
                    place, lists = [], []
                now, part = shard[lo], b.slice(lo, hi - lo)
                place.append(part.column("place").to_numpy())
                lists.append(part.column("terms"))
        if place:
            yield out()

    return places.select("shard", "place", "terms").mapInArrow(run, _POSTINGS)


def write(at: str, chunks: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """Writes places, postings and terms below at; n and avgdl in one row."""
    spark = chunks.sparkSession
    placed(chunks, per_shard).write.parquet(f"{at}/places")
    places = spark.read.parquet(f"{at}/places")
    stats = places.select(F.size("terms").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    blocks(places, stats.first().avgdl or 1.0).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{at}/postings")
    every = spark.read.parquet(f"{at}/postings")
    terms = every.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.max("kth").alias("kth"))
    terms.sortWithinPartitions("term").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{at}/terms")
    return stats


def read(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{at}/{t}") for t in ("places", "postings", "terms")}


def only(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of these terms; few terms are pushed down to the row groups that may hold them."""
    if not terms:
        return rows.limit(0)
    if len(terms) <= EACH_TERM:
        return rows.filter(reduce(lambda a, b: a | b, [F.col("term") == t for t in terms]))
    if len(terms) <= SOME_TERMS:
        return rows.filter(F.col("term").isin(terms))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")  # at most PAIRS


# ---------------------------------------------------------------- one shard


class Lists:
    """Of one shard each term's blocks: their ends, greatest impacts and entries."""

    def __init__(self, term: list[str], top: np.ndarray, first: np.ndarray, last: np.ndarray, entries: list[bytes]):
        self.of: dict[str, list[int]] = {}
        for i in sorted(range(len(term)), key=lambda i: first[i]):
            self.of.setdefault(term[i], []).append(i)
        self.top, self.first, self.last, self.entries = top, first, last, entries
        self.size = int(last.max()) + 1 if len(last) else 0
        self.n = sum(len(e) for e in entries) // 12

    def read(self, some: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(self.entries[i] for i in some), np.int32).reshape(-1, 3)


def best_of(lists: Lists, asked: list[tuple[str, float]], floor: float, avgdl: float, k: int, k1: float = K1, b: float = B) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores that may be among the k best, and how many postings were scored; floor: what the k-th best has at least."""
    held = [(idf, lists.of[t]) for t, idf in asked if t in lists.of]
    bound = np.array([idf * lists.top[i].max() for idf, i in held])
    order = np.argsort(-bound, kind="stable")
    held, bound = [held[i] for i in order], bound[order]
    left = np.r_[np.cumsum(bound[::-1])[::-1], 0.0]  # what the terms from here on can add
    score, scored, at = np.zeros(lists.size), 0, 0
    while at < len(held) and left[at] >= floor - NEAR:  # a chunk of these terms alone may still do
        idf, i = held[at]
        e = lists.read(i)
        score[e[:, 0]] += idf * impact(e[:, 1], e[:, 2], avgdl, k1, b)
        scored, at = scored + len(e), at + 1
        if len(score) > k:
            floor = max(floor, np.partition(score, -k)[-k])
    some = np.flatnonzero((score > 0) & (score + left[at] >= floor - NEAR))
    for j in range(at, len(held)):
        idf, i = held[j]
        i = np.array(i)
        lo, hi = np.searchsorted(some, lists.first[i]), np.searchsorted(some, lists.last[i], "right")
        # blocks that hold a place whose score may, with the block's best impact, still be among the best
        own = np.maximum.reduceat(np.r_[score[some], -np.inf], np.stack([lo, hi], 1).ravel())[::2] if len(some) else np.full(len(i), -np.inf)
        i = i[(hi > lo) & (own + idf * lists.top[i] + left[j + 1] >= floor - NEAR)]
        if len(i):
            e = lists.read(i.tolist())
            e = e[np.isin(e[:, 0], some, assume_unique=True)]
            score[e[:, 0]] += idf * impact(e[:, 1], e[:, 2], avgdl, k1, b)
            scored += len(e)
            if len(some) > k:
                floor = max(floor, np.partition(score[some], -k)[-k])
        some = some[score[some] + left[j + 1] >= floor - NEAR]
    some = some[score[some] >= floor - NEAR]
    if len(some) > k:
        least = np.partition(score[some].round(9), -k)[-k]
        some = some[score[some].round(9) >= least]
    return some, score[some], scored


def _searched(questions: dict, avgdl: float, k: int, kind: DataType):
    """qid, shard, place, score, scored of each shard's best; postings come in order of shard."""
    schema, arrow = f"qid {kind.simpleString()}, shard int, place int, score double, scored long", to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            term, top, first, last, entries = (list(c) for c in zip(*rows))
            lists = Lists(term, np.array(top), np.array(first), np.array(last), entries)
            for qid, (asked, floor) in questions.items():
                place, score, scored = best_of(lists, asked, floor, avgdl, k)
                if len(place):
                    yield pa.RecordBatch.from_pydict({"qid": pa.array([qid] * len(place), arrow), "shard": pa.array([now] * len(place), pa.int32()), "place": pa.array(place.astype(np.int32)), "score": score, "scored": [scored] * len(place)})

        for b in batches:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "term", "top", "first", "last", "entries"))):
                if shard != now and rows:
                    yield from out()
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield from out()

    return run, schema


def search(stored: dict[str, DataFrame], questions: DataFrame, n: int, avgdl: float, k: int = CANDIDATES) -> DataFrame:
    """qid, chunk_id, okey, score, rank: as ``retrieve.bm25`` over the stored chunks, without reading texts.

    stored: what ``read`` gives; n and avgdl: the statistics kept with it.  k above TOP is searched without a shared bound.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(X.search_terms(F.col("question")))).alias("term")).distinct()
    rounds = max(1, -(-asked.count() // PAIRS))
    found = None
    for r in range(rounds):
        some = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r) if rounds > 1 else asked
        part = _round(stored, some, n, avgdl, k)
        found = part if found is None else found.unionByName(part)
    at = F.round("score", 9)
    close = found.withColumn("_r", F.rank().over(Window.partitionBy("qid").orderBy(at.desc()))).filter(F.col("_r") <= k).drop("_r", "scored")
    named = close.join(stored["places"].select("shard", "place", "chunk_id", "okey"), ["shard", "place"])
    order = Window.partitionBy("qid").orderBy(at.desc(), "okey", "chunk_id")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "chunk_id", "okey", "score", "rank")


def _round(stored: dict[str, DataFrame], asked: DataFrame, n: int, avgdl: float, k: int) -> DataFrame:
    names = [r.term for r in asked.select("term").distinct().collect()]  # at most PAIRS
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = only(stored["terms"], names).select("term", idf.alias("idf"), F.when(F.lit(k <= TOP), F.col("kth")).otherwise(0.0).alias("kth"))
    questions: dict = {}
    for r in asked.join(known, "term").select("qid", "term", "idf", "kth").orderBy("qid", "term").collect():  # at most PAIRS
        terms, floor = questions.get(r.qid, ([], 0.0))
        questions[r.qid] = ([*terms, (r.term, r.idf)], max(floor, r.idf * r.kth))
    run, schema = _searched(questions, avgdl, k, asked.schema["qid"].dataType)
    spark = asked.sparkSession
    lists = only(stored["postings"].select("shard", "term", "top", "first", "last", "entries"), names)
    return lists.repartition(parts(spark), "shard").sortWithinPartitions("shard").mapInArrow(run, schema)
