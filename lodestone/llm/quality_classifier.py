"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the frequencies of its hashed words (``2**BITS`` columns, scaled to unit length), structure
statistics and metadata (``STATS``): the n_chars that its row states, and how far it is from the text's own length.  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2 ]

which is linear in the number of words.  It is fitted by AdaGrad on the driver on at most ``SAMPLE`` labelled rows
(features only, no texts), the first by a hash of the id among rows whose crc32(doc_id) mod 3 is not 1; labels, lang,
source and doc_id are never inputs of a score.

Defined results: null and empty texts have no words and get the score of their statistics; without both labels in the
sample every score is 0.5; a row without n_chars, or a table without that column, counts as stating the text's length; a document labelled twice counts with its smallest label; repeated rows repeat;
a row without a doc_id is scored like others and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, Words, batch, table, texts

BITS = 14
SAMPLE = 4000
FACTORS = 4
STATS = ("words", "word_length", "symbols", "capitals", "digits", "stops", "lines", "repeats", "wide", "size", "n_chars", "misstated")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&|<>!"]] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[ord(c) for c in ".,;:?"]] = 4
_CLASS[0x0A] = 5
_CLASS[0x80:] = 6


def stats(t: Texts, w: Words, stated: np.ndarray) -> np.ndarray:
    """STATS of each text; stated: the n_chars of its row, negative if it states none."""
    begins = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
    chars = begins[t.at[1:]] - begins[t.at[:-1]]
    stated = np.where(stated < 0, chars, stated)
    n, size = np.maximum(w.counts, 1), np.maximum(np.diff(t.at), 1)
    kinds = _CLASS[t.buf]
    per = []
    for k in range(1, 7):
        c = np.concatenate([[0], np.cumsum(kinds == k)])
        per.append((c[t.at[1:]] - c[t.at[:-1]]) / size)
    same = np.zeros(len(w.start) + 1, np.int64)
    if len(w.start):
        same[1:] = np.cumsum(np.r_[False, w.hash[1:] == w.hash[:-1]])
    letters = np.concatenate([[0], np.cumsum(w.end - w.start)])
    out = [
        np.log1p(w.counts) / 8, (letters[w.at[1:]] - letters[w.at[:-1]]) / n / 8, 5 * per[0], 2 * per[1], 5 * per[2], 10 * per[3],
        20 * per[4], (same[w.at[1:]] - same[w.at[:-1]]) / n, per[5], np.log1p(np.diff(t.at)) / 10,
        np.log1p(stated) / 10, np.abs(np.log1p(stated) - np.log1p(chars)),
    ]
    return np.minimum(np.stack(out, axis=1), 4)


def features(t: Texts, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each document (their bounds, columns and values) and its statistics."""
    w = Words(t, lower=True)
    col = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    n = len(t.ids)
    doc = np.repeat(np.arange(n), w.counts)
    key, count = np.unique(doc << BITS | col, return_counts=True)
    d = key >> BITS
    at = np.searchsorted(d, np.arange(n + 1))
    norm = np.sqrt(np.bincount(d, count.astype(float) ** 2, n))
    return at, key & ((1 << BITS) - 1), count / np.maximum(norm[d], 1e-9), stats(t, w, stated)


def raw_scores(at, col, val, st, model: dict) -> np.ndarray:
    """The machine's value by the sum-of-squares identity."""
    n, m = len(at) - 1, 1 << BITS
    w, v = model["w"], model["v"]
    doc = np.repeat(np.arange(n), np.diff(at))
    linear = model["w0"] + np.bincount(doc, w[col] * val, n) + st @ w[m:]
    pair = np.zeros(n)
    for f in range(v.shape[1]):
        a = v[col, f] * val
        s = np.bincount(doc, a, n) + st @ v[m:, f]
        q = np.bincount(doc, a * a, n) + (st**2) @ (v[m:, f] ** 2)
        pair += s * s - q
    return linear + pair / 2


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, seed: int = 7) -> dict:
    """rows: columns, values, statistics, label. Classes weigh the same in sum."""
    m = 1 << BITS
    model = {"w0": 0.0, "w": np.zeros(m + len(STATS)), "v": np.zeros((m + len(STATS), factors))}
    good = sum(r[3] for r in rows)
    if not 0 < good < len(rows):
        return model
    rng = np.random.default_rng(seed)
    w, v = model["w"], rng.normal(0, 0.02, model["v"].shape)
    gw, gv, g0, w0 = np.full(w.shape, 1e-2), np.full(v.shape, 1e-2), 1e-2, 0.0
    weight = {1: len(rows) / 2 / good, 0: len(rows) / 2 / (len(rows) - good)}
    data = [(np.r_[c, np.arange(m, m + len(STATS))], np.r_[x, s], y) for c, x, s, y in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            i, x, y = data[k]
            vx = v[i] * x[:, None]
            s = vx.sum(0)
            z = w0 + w[i] @ x + 0.5 * (s @ s - (vx * vx).sum())
            e = weight[y] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            d = e * x + 1e-4 * w[i]
            gw[i] += d * d
            w[i] -= rate * d / np.sqrt(gw[i])
            d = e * (x[:, None] * s - vx * x[:, None]) + 1e-4 * v[i]
            gv[i] += d * d
            v[i] -= rate * 0.5 * d / np.sqrt(gv[i])
            g0 += e * e
            w0 -= rate * e / np.sqrt(g0)
    return {"w0": w0, "w": w, "v": v}


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, stated: the n_chars of each row, -1 where there is none."""
    stated = F.coalesce(F.col("n_chars").try_cast("long"), F.lit(-1).cast("long")) if "n_chars" in docs.columns else F.lit(-1).cast("long")
    return docs.select("doc_id", "text", F.greatest(stated, F.lit(-1).cast("long")).alias("stated"))


def held_out(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The machine of at most ``sample`` labelled rows outside the held-out third, half of each label if there are."""
    per = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~held_out())
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [per.filter(F.col("quality") == q).orderBy(*order).limit(sample // 2) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, stated = b.column("quality").to_pylist(), b.column("stated").to_numpy(zero_copy_only=False)
            for lo, t in texts(b):
                at, col, val, st = features(t, stated[lo : lo + len(t.ids)])
                cut = lambda a: [a[at[i] : at[i + 1]].tobytes() for i in range(len(t.ids))]
                kinds = {"doc_id": pa.int64(), "quality": pa.int32(), "col": pa.binary(), "val": pa.binary(), "st": pa.binary()}
                yield batch(kinds, doc_id=t.ids, quality=q[lo : lo + len(t.ids)], col=cut(col.astype(np.uint16)), val=cut(val.astype(np.float32)), st=[r.tobytes() for r in st])

    rows = _rows(docs).join(chosen, "doc_id").mapInArrow(run, "doc_id long, quality int, col binary, val binary, st binary")
    rows = rows.orderBy("doc_id", "col").limit(sample).collect()  # bounded: the sample's features
    return fit([(np.frombuffer(r.col, np.uint16).astype(np.int64), np.frombuffer(r.val, np.float32).astype(float), np.frombuffer(r.st), r.quality) for r in rows])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, in one pass without a shuffle."""
    schema = {"doc_id": pa.int64(), "score": pa.float64()}
    # the machine has a fixed size: 2**BITS rows of FACTORS + 1 numbers
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            stated = b.column("stated").to_numpy(zero_copy_only=False)
            for lo, t in texts(b):
                z = raw_scores(*features(t, stated[lo : lo + len(t.ids)]), m)
                yield batch(schema, doc_id=t.named, score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    out = _rows(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
