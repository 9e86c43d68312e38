"""Approximate nearest neighbours by largest inner product: anisotropic 4-bit product quantisation and exact reranking.

Vectors are cut into pairs of components; each pair has a codebook of 16 centres, so a vector of 64 floats is 16 bytes.
For inner products the error along a vector matters more than that across it, so codes and centres minimise
|r|^2 + (eta - 1) (r . x / |x|)^2, eta = (d - 1) T^2 / (1 - T^2), by coordinate descent (``quantise``).  Codebooks are
fitted on at most ``SAMPLE`` vectors, the first by a hash of their id; every vector is indexed.

What is coded is a vector's offset from the nearest of the coarse centres, brought to unit length (its length is kept), so
that the codes tell vectors of a dense cluster apart as well as others.  There is a centre for every ``CELL`` vectors,
from ``COARSE[0]`` to ``COARSE[1]`` of them (so that they can be sent to every task).

Cells are searched in two rounds.  First each query scans its ``FIRST`` most promising cells; the best of these are scored
exactly, and the k-th of these scores (or of the sample's, if higher) is a lower bound of what its k-th neighbour scores.
Then it scans every other cell whose best score, about q . c + Z s |q| (s: the spread of the cell's offsets along a
direction), reaches that bound, and passes on only what comes within ``SLACK`` standard errors of it and is above the
``KEPT``-th best coded score of the first round.  Both are scores that so many rows have, never estimates, so they can't
rise above what there is to find.  A query that still has fewer than k
rows is searched again in all cells without a bound.  How much the bound prunes depends on the data: little if vectors
have no clusters, most of it if they do.

A scan adds, for each query, table entries instead of products: one table of 16 x 16 sums for each byte of two codes.
Codes and the queries that probe their cell meet by a join on the cell, both in blocks, so a row of the join stands for
hundreds of queries and codes.  The codes of a large cell are dealt over several tasks (``SHARE`` each) and its queries
sent to each of these.  What scans pass on is cut to the best ``KEPT`` a query by a ranked window, whose limit Spark
applies before the shuffle as well, and reranked in double precision on the original vectors, so returned scores are
exact.  Equal vectors are indexed once and put back at the end with their smallest ids, so copies can't crowd out others.

Defined results: a vector that is null, zero, of another length than the commonest, or holds null or non-finite
components takes no part; rows that repeat a vec_id count once, with their least vector; rows without a vec_id are
dropped; an empty table gives no rows; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, cut, parts, table

SAMPLE = 20_000
CENTRES = 16
FIT = 4096  # of the sample, for the codebooks
CELL = 256
COARSE = (64, 4096)
KEPT = 256
T = 0.2
Z = 4.0
SLACK = 2.0  # standard errors of a coded score that a candidate may fall below the bound
CODE_BLOCK = 2048
QUERY_BLOCK = 256
FIRST = 16  # cells of the first round
SHARE = 16_384  # codes of a cell that are one task's


def sound(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    good = rows.filter("vec_id is not null").filter(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = good.agg(F.mode(F.size("embedding"), True).alias("_size"))  # one row
    return good.join(F.broadcast(size), F.size("embedding") == F.col("_size")).drop("_size")


def coarse(x: np.ndarray, n: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Centres of x, at most n, by k-means."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        for i in range(x.shape[1]):
            c[:, i] = np.where(size > 0, np.bincount(near, x[:, i], len(c)) / np.maximum(size, 1), c[:, i])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1)[None] / 2
    return np.concatenate([(half - x[i : i + 2048] @ c.T).argmin(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def offsets(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's centre, the length of its offset from it and the offset at unit length."""
    near = nearest(x, c)
    r = x - c[near]
    size = np.linalg.norm(r, axis=1)
    return near, size, r / np.maximum(size, 1e-30)[:, None]


def fit(r: np.ndarray, u: np.ndarray, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Centres, (pairs, 16, 2), that lower the anisotropic loss of r, along the directions u."""
    n, pairs = len(r), r.shape[1] // 2
    rng = np.random.default_rng(seed)
    books = np.stack([r[rng.integers(0, n, CENTRES)].reshape(CENTRES, pairs, 2)[:, m] for m in range(pairs)])
    books = books + rng.normal(0, 1e-3, books.shape)
    for i in range(rounds):
        weight = eta(r.shape[1]) if i >= 3 else 1.0
        _update(r, u, quantise(r, u, books, weight, sweeps=1), books, weight)
    return books


def eta(d: int, t: float = T) -> float:
    return max(1.0, (d - 1) * t * t / (1 - t * t))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def quantise(x: np.ndarray, u: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, pairs): each pair in turn takes the centre with the least loss, given the others'."""
    n, pairs = len(x), len(books)
    u, xs = u.reshape(n, pairs, 2), x.reshape(n, pairs, 2)
    codes = np.zeros((n, pairs), np.uint8)
    along = np.zeros((n, pairs))
    for sweep in range(sweeps + 1):
        total = along.sum(1)
        for m in range(pairs):
            r = xs[:, m, None, :] - books[m]
            loss = (r * r).sum(2)
            part = (r * u[:, m, None, :]).sum(2)
            if sweep and weight > 1:
                loss += (weight - 1) * ((total - along[:, m])[:, None] + part) ** 2
            best = loss.argmin(1)
            codes[:, m] = best
            p = part[np.arange(n), best]
            total += p - along[:, m]
            along[:, m] = p
        if weight <= 1:
            break
    return codes


def _update(x: np.ndarray, u: np.ndarray, codes: np.ndarray, books: np.ndarray, weight: float) -> None:
    """Each pair's centres by least squares, given the others'; centres without vectors stay."""
    n, pairs = len(x), len(books)
    u, xs = u.reshape(n, pairs, 2), x.reshape(n, pairs, 2)
    along = np.stack([((xs[:, m] - books[m][codes[:, m]]) * u[:, m]).sum(1) for m in range(pairs)], 1)
    total = along.sum(1)
    for m in range(pairs):
        c, v, w = codes[:, m], u[:, m], weight - 1
        other = total - along[:, m]
        size = np.bincount(c, minlength=CENTRES).astype(float)
        put = lambda y: np.bincount(c, y, CENTRES)
        a = np.zeros((CENTRES, 2, 2))
        b = np.zeros((CENTRES, 2))
        target = other + (xs[:, m] * v).sum(1)
        for i in range(2):
            b[:, i] = put(xs[:, m, i]) + w * put(v[:, i] * target)
            for j in range(2):
                a[:, i, j] = (size if i == j else 0) + w * put(v[:, i] * v[:, j])
        full = size > 0
        books[m][full] = np.linalg.solve(a[full], b[full][:, :, None])[:, :, 0]
        p = ((xs[:, m] - books[m][c]) * v).sum(1)
        total += p - along[:, m]
        along[:, m] = p


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column, with a zero column if d is odd."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), d)
    return np.pad(x, ((0, 0), (0, d % 2)))


def train(distinct: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Length of the vectors (d), coarse centres, the spread of offsets about each, codebooks, the sample itself and the
    standard error of a coded score; None without vectors.  All of it has a size that the sample and COARSE bound."""
    rows = distinct.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()  # bounded: the sample
    if not rows.num_rows:
        return None
    col = rows.column("embedding").combine_chunks()
    d = len(col[0])
    x = _matrix(col, d)
    many = distinct.count()
    centres = coarse(x, min(max(many // CELL, COARSE[0]), COARSE[1]))
    near, length, r = offsets(x, centres)
    books = fit(r[:FIT], _unit(x[:FIT]))
    size = np.bincount(near, minlength=len(centres))
    of_all = np.sqrt((length**2).mean() / d)  # a centre that few of the sample have takes at least the common spread
    spread = np.maximum(np.sqrt(np.bincount(near, length**2, len(centres)) / np.maximum(size, 1) / d), of_all * (size < 8))
    some = x[:1024]
    codes = quantise(r[:1024], _unit(some), books, eta(d))
    coded = centres[near[:1024]] + length[:1024, None] * np.concatenate([books[m][codes[:, m]] for m in range(len(books))], axis=1)
    error = float((some @ (coded - some).T / np.maximum(np.linalg.norm(some, axis=1), 1e-30)[:, None]).std())
    return {"d": d, "centres": centres, "spread": spread, "books": books, "sample": x.astype(np.float32), "error": error, "n": many}


_CODE = {"cell": pa.int32(), "id": pa.int64(), "data": pa.binary()}
_PROBE = {"cell": pa.int32(), "salt": pa.int32(), "id": pa.int64(), "data": pa.binary()}


def _codes(model):
    """cell, rep and data (length of the offset, codes of two to a byte) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.slice(lo, 4096)
                x = _matrix(part.column("embedding"), m["d"])
                near, length, r = offsets(x, m["centres"])
                c = quantise(r, _unit(x), m["books"], eta(m["d"]))
                c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
                raw = np.concatenate([length.astype(np.float32).view(np.uint8).reshape(-1, 4), c[:, ::2] << np.uint8(4) | c[:, 1::2]], axis=1)
                yield batch(_CODE, cell=near.astype(np.int32), id=part.column("key"), data=[r.tobytes() for r in raw])

    return run


def _probes(model, ways: np.ndarray, k: int, which: str):
    """cell, salt, query and data (floor, vector) of the cells that a query probes, and each share of their codes.

    which: "first" (the most promising ones), "rest" (others that reach the bound of the row, which also holds a least
    coded score, least) or "all", without a floor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                x, ids = _matrix(part.column("embedding"), m["d"]), part.column("key").to_numpy(zero_copy_only=False)
                size = np.linalg.norm(x, axis=1)
                bound, least = np.full(len(x), -np.inf), np.full(len(x), -np.inf)
                reach = x @ m["centres"].T + Z * size[:, None] * m["spread"][None]
                wanted = np.ones(reach.shape, bool)
                if which != "all":
                    best = np.argsort(-reach, axis=1, kind="stable")[:, :FIRST]
                    np.put_along_axis(wanted, best, False, axis=1)
                    known = np.sort(x.astype(np.float32) @ m["sample"].T, axis=1)[:, ::-1]
                    if known.shape[1] > k:  # the query itself may be in the sample, so one more
                        bound = known[:, k].astype(float)
                    if which == "first":
                        wanted = ~wanted
                    else:
                        bound = np.fmax(bound, part.column("bound").to_numpy(zero_copy_only=False))
                        least = np.fmax(least, part.column("least").to_numpy(zero_copy_only=False))
                        wanted &= reach >= bound[:, None]
                i, cell = np.nonzero(wanted & (ways > 0)[None])
                many = ways[cell]
                salt = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i, cell = np.repeat(i, many), np.repeat(cell, many)
                floor = np.maximum(bound - SLACK * m["error"] * size, least).astype(np.float32)
                raw = np.concatenate([floor[:, None], x.astype(np.float32)], axis=1)
                data = [r.tobytes() for r in raw]
                yield batch(_PROBE, cell=cell.astype(np.int32), salt=salt.astype(np.int32), id=ids[i], data=[data[j] for j in i])

    return run


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """cell, salt, ids, data: rows of a cell and salt in blocks of at most size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, data = None, [], []
        kinds = {"cell": pa.int32(), "salt": pa.int32(), "ids": pa.binary(), "data": pa.binary()}
        block = lambda: batch(kinds, cell=[now[0]], salt=[now[1]], ids=[np.array(ids, np.int64).tobytes()], data=[b"".join(data)])
        for b in batches:
            for c, s, i, x in zip(*(b.column(n).to_pylist() for n in ("cell", "salt", "id", "data"))):
                if (c, s) != now or len(ids) == size:
                    if ids:
                        yield block()
                    now, ids, data = (c, s), [], []
                ids.append(i)
                data.append(x)
        if ids:
            yield block()

    dealt = rows.repartition(parts(rows.sparkSession), "cell", "salt").sortWithinPartitions("cell", "salt")
    return dealt.mapInArrow(run, "cell int, salt int, ids binary, data binary")


def _scan(model, kept: int):
    """The best of a block of codes for each query of a block, by sums of table entries; those near the query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = model.value["centres"], model.value["books"]
        pairs = len(books)
        tables = np.zeros((pairs + pairs % 2, CENTRES, 2), np.float32)
        tables[:pairs] = books
        for b in batches:
            for cell, q_ids, q, c_ids, c in zip(b.column("cell").to_pylist(), *(b.column(x) for x in ("q_ids", "q_data", "c_ids", "c_data"))):
                q_ids, c_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (q_ids, c_ids))
                q = np.frombuffer(q.as_buffer(), np.float32).reshape(len(q_ids), -1)
                floor, q = q[:, 0], q[:, 1:]
                at_centre = (q @ centres[cell].astype(np.float32))[:, None]
                if pairs % 2:
                    q = np.pad(q, ((0, 0), (0, 2)))
                raw = np.frombuffer(c.as_buffer(), np.uint8).reshape(len(c_ids), -1)
                length, codes = np.ascontiguousarray(raw[:, :4]).view(np.float32)[:, 0], raw[:, 4:]
                score = np.zeros((len(c_ids), len(q_ids)), np.float32)
                for m in range(codes.shape[1]):
                    hi, lo = tables[2 * m] @ q[:, 4 * m : 4 * m + 2].T, tables[2 * m + 1] @ q[:, 4 * m + 2 : 4 * m + 4].T
                    score += (hi[:, None] + lo[None]).reshape(CENTRES * CENTRES, -1)[codes[:, m]]
                score = np.ascontiguousarray((score * length[:, None]).T) + at_centre
                if kept < score.shape[1]:
                    least = np.partition(score, -kept, axis=1)[:, -kept]
                    floor = np.maximum(floor, least)
                i, j = np.nonzero(score >= floor[:, None])
                yield batch({"query_id": pa.int64(), "rep": pa.int64(), "s": pa.float32()}, query_id=q_ids[i], rep=c_ids[j], s=score[i, j])

    return run


def _exact(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = (_matrix(b.column("qv"), d) * _matrix(b.column("embedding"), d)).sum(1)
            yield batch({"query_id": pa.int64(), "rep": pa.int64(), "score": pa.float64()}, query_id=b.column("query_id"), rep=b.column("rep"), score=score)

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 20, kept: int = KEPT, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each of queries (ids of rows), without the query's own row."""
    spark = rows.sparkSession
    good = cut(sound(rows.select("vec_id", "embedding")))
    # of equal vectors no query needs more than the k + 1 smallest ids: its own and k others
    same = Window.partitionBy("embedding").orderBy("vec_id")
    members = good.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    members = cut(members.withColumn("rep", F.min("vec_id").over(Window.partitionBy("embedding"))))
    distinct = members.filter("n = 1").select("rep", "embedding")
    fitted = train(distinct, sample)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(fitted)  # at most the sample, COARSE[1] centres and the codebooks
    asked = cut(good.join(queries.select(F.col("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")))
    coded = cut(distinct.select(F.col("rep").alias("key"), "embedding").mapInArrow(_codes(model), "cell int, id long, data binary"))
    ways = np.zeros(len(fitted["centres"]), np.int64)
    for r in coded.groupBy("cell").count().collect():  # a row a cell, COARSE[1] at most
        ways[r.cell] = -(-r["count"] // SHARE)
    of = F.broadcast(spark.createDataFrame([(int(c), int(w)) for c, w in enumerate(ways) if w], "cell int, ways int"))
    codes = coded.join(of, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("ways").cast("long")).cast("int").alias("salt"), "id", "data")
    codes = cut(_packed(codes, CODE_BLOCK).withColumnsRenamed({"ids": "c_ids", "data": "c_data"}))

    def scan(some: DataFrame, which: str) -> DataFrame:
        """query_id, rep, n of the best kept codes of some of the queries (query_id, qv, bound, least), and their scores s."""
        keyed = some.select(F.col("query_id").alias("key"), F.col("qv").alias("embedding"), "bound", "least")
        sought = _packed(keyed.mapInArrow(_probes(model, ways, k, which), "cell int, salt int, id long, data binary"), QUERY_BLOCK).withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
        met = codes.join(sought, ["cell", "salt"]).select("cell", "q_ids", "q_data", "c_ids", "c_data").mapInArrow(_scan(model, kept), "query_id long, rep long, s float")
        first = Window.partitionBy("query_id").orderBy(F.desc("s"), "rep")
        return met.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= kept).select("query_id", "rep", "n", "s")

    def scored(pairs: DataFrame) -> DataFrame:
        """query_id, rep, score of a query's k + 1 best of pairs."""
        both = pairs.select("query_id", "rep").join(asked, "query_id").join(distinct, "rep").select("query_id", "qv", "rep", "embedding")
        exact = both.mapInArrow(_exact(fitted["d"]), "query_id long, rep long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
        return exact.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)

    def answers(near: DataFrame) -> DataFrame:
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        every = near.join(members.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
        return every.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    none = [F.lit(None).cast("double").alias(c) for c in ("bound", "least")]
    coarsely = cut(scan(asked.select("*", *none), "first"))
    near = cut(scored(coarsely))
    bound = near.filter(F.col("n") == k + 1).select("query_id", F.col("score").alias("bound"))
    bound = bound.join(coarsely.filter(F.col("n") == kept).select("query_id", F.col("s").cast("double").alias("least")), "query_id", "full_outer")
    rest = scored(scan(asked.join(bound, "query_id", "left"), "rest"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    both = near.drop("n").unionByName(rest.drop("n")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    found = cut(answers(both))
    # a query with fewer than k rows, though there are others, lost them to the codes' errors: it is searched without a bound
    possible = min(k, max(good.limit(k + 1).count() - 1, 0))
    full = found.groupBy("query_id").count().filter(F.col("count") >= possible)
    short = cut(asked.join(full, "query_id", "left_anti"))
    if not possible or not short.take(1):
        return found
    again = answers(scored(scan(short.select("*", *none), "all")))
    return found.join(short, "query_id", "left_anti").unionByName(again)


def op3_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 20 = 0").select("vec_id"))
