"""Whitening of embeddings by shifted CholeskyQR: orthonormal factors of the centred rows from distributed Gram passes.

Entries c become x = floor(SCALE * c).  The rows to fit on are the distinct x-vectors, centred: the matrix A, n x d.

1. A pass over the rows sums Q'Q, Q being A R^-1 by triangular solves in each task and R the product of the factors so far
   (none at first).  Each task adds up its rows and passes on one d x d matrix; Spark adds these.
2. The driver factors the sum, a d x d matrix, plus a shift that keeps a matrix of deficient rank positive, by Cholesky,
   and multiplies the factor to R.  The first pass is always shifted, as the shift bounds the condition of what is left; a
   later one only if it must be.
3. Passes go on until Q'Q is the identity to rounding, at most ``PASSES`` times.  Then A = Q R, and the singular value
   decomposition of (Q'Q)^(1/2) R (of R alone where Q'Q is the identity) gives the components and the eigenvalues,
   s^2 / n.  The root takes up what directions without any spread leave of Q'Q.
4. Rows are centred and projected where they lie; one more pass over the fit list sums the covariance of the result.

What the driver holds are matrices of d x d, whatever the number of rows.  Sums of x are exact (integers).

Defined results: a row whose vector is null, holds null or non-finite entries, is empty, or has another length than the
commonest (the longest of equally common ones) is dropped; rows with equal vectors, and rows that repeat a vec_id, count
once in the fit list and keep a row each; a null vec_id stays null; a component whose eigenvalue is zero to rounding
(below d * EPSILON of the trace) has whitened null and takes no part in identity_error; deviation is exact, and null where
it doesn't fit a long; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, table

SCALE = 256
COMPONENTS = 4
PASSES = 6
EPSILON = float(np.finfo(float).eps)
ROWS = 4096  # that a task turns at a time


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x array<bigint> of the rows that take part."""
    e = F.col("embedding")
    fine = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.select("vec_id", "embedding").filter(F.coalesce(fine, F.lit(False)))
    sizes = good.groupBy(F.size("embedding").alias("d")).count()
    size = F.broadcast(sizes.agg(F.max_by("d", F.struct("count", "d")).alias("_d")))  # one row
    x = F.transform(e, lambda c: F.floor(c.cast("double") * scale))
    return good.join(size, F.size(e) == F.col("_d")).select("vec_id", x.alias("x"))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for lo in range(0, len(b), ROWS):
        part = b.slice(lo, ROWS)
        yield part, _matrix(part.column("x"))


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""
    exact = lambda i: F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}")
    n, *sums = fit.agg(F.count("*"), *[exact(i) for i in range(d)]).first()
    return n, [int(v) for v in sums]


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for an upper triangular r, column by column."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, turn, d: int) -> np.ndarray:
    """The sum over fit's rows x of y'y, y being turn(x): d x d, of which each task passes on its share's."""
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for b in batches:
            for _, x in _blocks(b):
                y = turn(x)
                g += y.T @ y
        yield batch({"i": pa.int32(), "j": pa.int32(), "g": pa.float64()}, i=i, j=j, g=g[i, j])

    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # d (d + 1) / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.g
    return out


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular r with r'r = g, plus a shift if one is asked for or g is not positive to rounding."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * EPSILON / 2 * np.trace(g)
    for s in ([] if shifted else [0.0]) + [shift * 4**i for i in range(30)]:
        try:
            r = np.linalg.cholesky(g + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(r).all() and (np.diag(r) > 0).all():
            return r
    raise np.linalg.LinAlgError("no shift makes the matrix positive")


def model(fit: DataFrame, passes: int = PASSES) -> dict | None:
    """n, sums, components (rows, by falling eigenvalue), eigenvalues and the trace of the covariance; None without rows."""
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    n, sums = totals(fit, d)
    mean = np.array([s / n for s in sums])
    r, g = None, np.zeros((d, d))
    for p in range(passes + 1):
        turn = (lambda x: x - mean) if r is None else (lambda x, r=r: solved(x - mean, r))
        g = gram(fit, turn, d)
        if r is None:
            trace = np.trace(g) / n
            if trace == 0:
                return {"n": n, "sums": sums, "mean": mean, "components": np.eye(d), "values": np.zeros(d), "trace": 0.0}
        elif p == passes or np.abs(g @ g - g).max() <= 64 * EPSILON * d:  # orthonormal, where there is any spread
            break
        step = factor(g, n, r is None)
        r = step if r is None else step @ r
    if np.abs(g - np.eye(d)).max() > 64 * EPSILON * d:
        e, u = np.linalg.eigh(g)
        r = (u * np.sqrt(np.maximum(e, 0))) @ u.T @ r
    _, s, v = np.linalg.svd(r)
    sign = np.sign(v[np.arange(d), np.abs(v).argmax(axis=1)])
    return {"n": n, "sums": sums, "mean": mean, "components": v * sign[:, None], "values": s * s / n, "trace": trace}


def _projector(m: dict, most: int) -> np.ndarray:
    """d x most: a centred row times this is whitened; NaN for components without spread."""
    e = m["values"][:most]
    flat = e <= len(m["mean"]) * EPSILON * m["trace"]
    return m["components"][:most].T / np.sqrt(np.where(flat, np.nan, e))


def identity_error(fit: DataFrame, m: dict, most: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of fit's whitened rows, less the identity; 0 without spread."""
    p = _projector(m, most)
    p = p[:, ~np.isnan(p[0])]
    if not p.shape[1]:
        return 0.0
    c = gram(fit, lambda x, mean=m["mean"], p=p: (x - mean) @ p, p.shape[1]) / m["n"]
    return float(np.abs(c - np.eye(len(c))).max())


def whiten(rows: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    x = integers(rows, scale)
    fit = cut(x.select("x").distinct())
    m = model(fit)
    ddl = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = rows.schema["vec_id"].dataType.simpleString()
    if m is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {ddl}")
    error = identity_error(fit, m, most)
    p, k = _projector(m, most), min(most, len(m["mean"]))
    explained = m["values"][:k] / m["trace"] if m["trace"] else np.zeros(k)
    n, mean = m["n"], m["mean"]
    low = lambda v: np.array([int(i) & ((1 << 64) - 1) for i in v], np.uint64).view(np.int64)
    sums, times = low(m["sums"]), low([n])[0]
    total = np.array([float(s) for s in m["sums"]])
    fields = {"component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _blocks(b):
                with np.errstate(over="ignore"):  # modulo 2**64, so exact wherever the sum fits
                    away = times * x - sums
                    exact = (away * away).sum(axis=1)
                about = ((float(n) * x - total) ** 2).sum(axis=1)
                dev = pa.array(exact, pa.int64(), mask=about > 9.2e18)
                w = (x - mean) @ p
                at = pa.array(np.repeat(np.arange(len(x)), k))
                out = [part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), n)), dev.take(at)]
                out += [pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(explained, len(x))), pa.array(np.full(k * len(x), error))]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", *fields])

    return x.mapInArrow(run, f"vec_id {kind}, {ddl}")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
