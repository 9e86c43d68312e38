"""Quality rules by line labelling: a linear-chain CRF marks lines as content or boilerplate, Viterbi decodes them.

Each line has a few format features (shares of symbols, separators, capitals, digits, marks; repeats, length, a sentence's
end).  The CRF has one weight a feature and label, transition weights and start weights.  It is fitted on a bounded
sample of labelled documents (``SAMPLE_DOCS``; of one with more than ``WINDOW`` lines a stretch of that many, from a
place that a hash chooses), in which every document weighs the same.  Labels of lines are latent: they start as their
document's label, and after each fit lines that the model is sure of change sides, as long as a good document stays content
by the greater part and a bad one boilerplate (``relabel``).  So both labels and the moves between them occur in texts.
A document is kept if characters in content lines make at least ``min_content`` of those in all its lines and no base
rule fails.

Defined results: a text without words (null, empty, blank) has zero counts and fails the base rule; without documents of
both labels texts are decoded by default weights, the model says so (``source``) and ``train`` warns; repeated rows give
repeated rows and rows without a doc_id keep that null; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, Words, batch, combined, span_hashes, table, texts

SAMPLE_DOCS = 1500
WINDOW = 2048
ROUNDS = 3
SURE = 0.7
MIN_CONTENT = 0.5
MIN_WORDS = 50
CONTENT, BOILERPLATE = 0, 1
FEATURES = ("bias", "symbols", "separators", "capitals", "digits", "marks", "repeats", "short", "copied", "sentence")


def _bytes(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


_SYMBOL = _bytes("#*$%&|<>")
_SEPARATOR = _bytes("|/\\>~_=+^{}[]")
_UPPER = _bytes(range(0x41, 0x5B))
_ALPHA = _bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGIT = _bytes(range(0x30, 0x3A))
_MARK = _bytes("!?")
_STOP = _bytes(".!?:;\"')")

#: Weights before any fit: a line is content unless its format speaks against it.
DEFAULT = {
    "emit": [[1.0, -3, -2, -1.5, -1, -1, -2, -0.3, -0.5, 0.5], [-1.0, 3, 2, 1.5, 1, 1, 2, 0.3, 0.5, -0.5]],
    "move": [[0.5, -0.5], [-0.5, 0.5]],
    "start": [0.0, 0.0],
    "source": "default weights",
}
_WEIGHTS = ("emit", "move", "start")


def _counter(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


class Lines:
    """The lines with a word of Texts: bounds in bytes, document, copied, features; and each document's bounds in them."""

    def __init__(self, t: Texts, w: Words):
        buf, n = t.buf, len(t.buf)
        breaks = np.flatnonzero(buf == 0x0A)
        start = np.unique(np.concatenate([t.at[:-1], breaks + 1]))
        start = start[start < n]
        end = np.minimum(np.r_[start[1:], n], np.r_[breaks, n][np.searchsorted(breaks, start)])
        doc_end = t.at[np.searchsorted(t.at, start, "right")] if len(start) else start
        end = np.minimum(end, doc_end)
        lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        has = hi > lo
        self.start, self.end, self.lo, self.hi = start[has], end[has], lo[has], hi[has]
        self.doc = np.searchsorted(t.at, self.start, "right") - 1
        self.at = np.searchsorted(self.start, t.at)
        self.at[-1] = len(self.start)
        self.copied = self._copies(buf)
        self.x = self._features(buf, w)

    def _copies(self, buf: np.ndarray) -> np.ndarray:
        """Lines that equal an earlier one of their document: found by hash, then compared."""
        first, many = combined([span_hashes(buf, self.start, self.end), self.doc])
        copied = np.zeros(len(first), bool)
        again = np.flatnonzero((many > 1) & (first != np.arange(len(first))))
        for i, j in zip(again.tolist(), first[again].tolist()):
            copied[i] = np.array_equal(buf[self.start[i] : self.end[i]], buf[self.start[j] : self.end[j]])
        return copied

    def _features(self, buf: np.ndarray, w: Words) -> np.ndarray:
        a, b = self.start, self.end
        size = np.maximum(b - a, 1)
        share = lambda mask: (lambda c: (c[b] - c[a]))(_counter(mask))
        alpha = np.maximum(share(_ALPHA[buf]), 1)
        words = np.maximum(self.hi - self.lo, 1)
        same = np.zeros(len(w.start), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        c = _counter(same)
        last = w.end[self.hi - 1] - 1  # of the line's last word
        x = np.stack(
            [
                np.ones(len(a)),
                np.minimum(1, 5 * share(_SYMBOL[buf]) / size),
                np.minimum(1, 2 * share(_SEPARATOR[buf]) / words),
                share(_UPPER[buf]) / alpha,
                np.minimum(1, 3 * share(_DIGIT[buf]) / size),
                np.minimum(1, share(_MARK[buf]) / words),
                (c[self.hi] - c[self.lo]) / words,
                words < 4,
                self.copied,
                _STOP[buf[last]],
            ],
            axis=1,
        )
        return x.astype(np.float64)


def viterbi(x: np.ndarray, model: dict) -> np.ndarray:
    """The likeliest labels of one document's lines."""
    e = x @ np.asarray(model["emit"]).T
    t, best = np.asarray(model["move"]), np.asarray(model["start"]) + e[:1].sum(0)
    back = np.zeros(e.shape, np.int8)
    for i in range(1, len(e)):
        via = best[:, None] + t
        back[i] = via.argmax(0)
        best = via.max(0) + e[i]
    out = np.zeros(len(e), np.int8)
    if len(e):
        out[-1] = best.argmax()
        for i in range(len(e) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
    return out


def decode_all(x: np.ndarray, at: np.ndarray, model: dict) -> np.ndarray:
    """viterbi() of many documents at once: step i of all documents that are longer than i together."""
    e, move = x @ np.asarray(model["emit"]).T, np.asarray(model["move"])
    n = np.diff(at)
    out, back = np.zeros(len(x), np.int8), np.zeros((len(x), 2), np.int8)
    order = np.argsort(-n, kind="stable")
    first, n = at[:-1][order], n[order]
    live = int((n > 0).sum())
    best = np.zeros((len(n), 2))
    best[:live] = np.asarray(model["start"]) + e[first[:live]]
    longest = int(n[0]) if len(n) else 0
    lives = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    for i in range(1, longest):
        k = lives[i]
        via = best[:k, :, None] + move
        back[first[:k] + i] = via.argmax(1)
        best[:k] = via.max(1) + e[first[:k] + i]
    if live:
        out[first[:live] + n[:live] - 1] = best[:live].argmax(1)
    for i in range(longest - 1, 0, -1):
        at_i = first[: lives[i]] + i
        out[at_i - 1] = back[at_i, out[at_i]]
    return out


def _log_z(e: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Label and pair probabilities of one document (forward and backward passes)."""
    move, n = np.asarray(model["move"]), len(e)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = np.asarray(model["start"]) + e[0]
    for i in range(1, n):
        f[i] = np.logaddexp.reduce(f[i - 1][:, None] + move, axis=0) + e[i]
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp.reduce(move + e[i + 1] + b[i + 1], axis=1)
    z = np.logaddexp.reduce(f[-1])
    pair = np.exp(f[:-1, :, None] + move + (e[1:] + b[1:])[:, None, :] - z)
    return np.exp(f + b - z), pair


def fit(documents: list[tuple[np.ndarray, np.ndarray]], steps: int = 40, rate: float = 0.5, decay: float = 1e-3, apart: bool = False) -> dict:
    """Weights that make the labels of each document's lines likely; full gradients, every document weighs the same.

    apart: lines are judged one by one, without start and move weights.
    """
    model = {k: np.array(DEFAULT[k], float) for k in _WEIGHTS}
    if apart:
        model |= {"move": np.zeros((2, 2)), "start": np.zeros(2)}
    prior = {k: v.copy() for k, v in model.items()}
    at = np.concatenate([[0], np.cumsum([len(x) for x, _ in documents])])
    x, y = np.concatenate([x for x, _ in documents]), np.concatenate([y for _, y in documents])
    n = np.diff(at)
    weight = np.repeat(1 / (n * len(n)), n)
    want = np.eye(2)[y]
    inside = np.ones(len(x), bool)
    inside[at[:-1]] = False
    to = np.flatnonzero(inside)
    seen = np.einsum("i,ia,ib->ab", weight[to], want[to - 1], want[to])
    for _ in range(steps):
        p, pair = marginals(x @ model["emit"].T, at, model)
        g = {
            "emit": ((want - p) * weight[:, None]).T @ x,
            "start": ((want[at[:-1]] - p[at[:-1]]) * weight[at[:-1]][:, None]).sum(0),
            "move": seen - np.einsum("i,iab->ab", weight[to], pair[to]),
        }
        for k in ("emit",) if apart else model:
            model[k] += rate * 4 * (g[k] - decay * (model[k] - prior[k]))
    return {k: v.round(9).tolist() for k, v in model.items()} | {"source": "fitted"}


def marginals(e: np.ndarray, at: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each line's label probabilities, and those of its label and the one before, by forward and backward passes.

    Step i of all documents that are longer than i is taken together.
    """
    move, start = np.asarray(model["move"]), np.asarray(model["start"])
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, n = at[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    lives = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    f, b = np.zeros(e.shape), np.zeros(e.shape)
    live = int((n > 0).sum())
    f[first[:live]] = start + e[first[:live]]
    for i in range(1, longest):
        k = first[: lives[i]] + i
        f[k] = np.logaddexp.reduce(f[k - 1][:, :, None] + move, axis=1) + e[k]
    for i in range(longest - 1, 0, -1):
        k = first[: lives[i]] + i
        b[k - 1] = np.logaddexp.reduce(move + (e[k] + b[k])[:, None, :], axis=2)
    z = np.logaddexp.reduce(f + b, axis=1)
    pair = np.zeros((len(e), 2, 2))
    inside = np.ones(len(e), bool)
    inside[first[:live]] = False  # a document's first line has none before it
    k = np.flatnonzero(inside)
    pair[k] = np.exp(f[k - 1][:, :, None] + move + (e[k] + b[k])[:, None, :] - z[k][:, None, None])
    return np.exp(f + b - z[:, None]), pair


def relabel(p: np.ndarray, size: np.ndarray, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of lines: their document's, but for those that p is SURE are of the other kind, the surest first, as long as
    these make less than half of the document's characters."""
    doc = np.repeat(np.arange(len(label)), np.diff(at))
    other = p[np.arange(len(p)), 1 - label[doc]]
    order = np.lexsort((-other, doc))
    taken = np.cumsum(np.where(other > SURE, size, 0)[order])
    base = np.concatenate([[0], taken])[at[:-1]]
    whole = np.maximum(np.add.reduceat(size, at[:-1]), 1)
    out = label[doc].copy()
    turn = order[(other[order] > SURE) & (2 * (taken - base[doc[order]]) < whole[doc[order]])]
    out[turn] = 1 - out[turn]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> dict:
    """A CRF from at most ``sample`` labelled documents, half of each label, the first by a hash of the id."""
    per = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [per.filter(F.col("quality") == q).orderBy(*order).limit(sample // 2) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most `sample` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("quality").to_pylist()
            for lo, t in texts(b):
                lines = Lines(t, Words(t))
                rows = {"doc_id": t.ids, "quality": q[lo : lo + len(t.ids)], "x": [], "size": []}
                for i in range(len(t.ids)):
                    u, v = int(lines.at[i]), int(lines.at[i + 1])
                    if v - u > WINDOW:
                        u += int(lines.end[v - 1] - lines.start[u]) * 2654435761 % (v - u - WINDOW + 1)
                        v = u + WINDOW
                    rows["x"].append(lines.x[u:v].astype(np.float32).tobytes())
                    rows["size"].append((lines.end[u:v] - lines.start[u:v]).astype(np.int32).tobytes())
                yield batch({"doc_id": pa.int64(), "quality": pa.int32(), "x": pa.binary(), "size": pa.binary()}, **rows)

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(features, "doc_id long, quality int, x binary, size binary")
    rows = rows.orderBy("doc_id", "x").limit(2 * sample).collect()  # bounded: the sample's features
    got = [(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).astype(float), np.frombuffer(r.size, np.int32), CONTENT if r.quality == 1 else BOILERPLATE) for r in rows if r.x]
    if len({y for _, _, y in got}) < 2:
        warnings.warn("no labelled documents of both kinds with a line; lines are judged by default weights", stacklevel=2)
        return DEFAULT
    return learn(got, rounds)


def learn(got: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS) -> dict:
    """The CRF of documents (features and sizes of their lines, label): fits and relabels in turn."""
    at = np.concatenate([[0], np.cumsum([len(x) for x, _, _ in got])])
    x, size, label = np.concatenate([x for x, _, _ in got]), np.concatenate([s for _, s, _ in got]), np.array([y for _, _, y in got])
    y = np.repeat(label, np.diff(at))
    # documents of the rarer label come as often as the others
    rare = int((label == BOILERPLATE).sum() < (label == CONTENT).sum())
    times = np.where(label == rare, max(1, round((label != rare).sum() / max(1, (label == rare).sum()))), 1)
    model = DEFAULT
    for i in range(rounds):
        # the first labels don't change within a document, so the first fit looks at lines one by one
        model = fit([(x[at[d] : at[d + 1]], y[at[d] : at[d + 1]]) for d in np.repeat(np.arange(len(label)), times)], apart=i == 0)
        y = relabel(marginals(x @ np.asarray(model["emit"]).T, at, model)[0], size, at, label)
    return model


def _repeated(w: Words) -> np.ndarray:
    """Words of each document in 3-word windows that its text holds twice or more."""
    n_docs = len(w.at) - 1
    g = w.grams(3)
    if not len(g):
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), w.counts)
    inside = doc[: len(g)] == doc[2:]
    at = np.flatnonzero(inside)
    key, d = g[at], doc[at]
    order = np.lexsort((key, d))
    k, d = key[order], d[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(k)])
    hit = at[order[np.repeat(size > 1, size)]]
    mark = np.zeros(len(w.start) + 3, bool)
    for i in range(3):
        mark[hit + i] = True
    return _per_doc(mark[: len(w.start)], w.at)


def _per_doc(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = _counter(mask)
    return c[at[1:]] - c[at[:-1]]


SCHEMA = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "content_share": pa.float64(), "kept": pa.bool_(),
}
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _judge(t: Texts, model: dict, min_content: float, min_words: int = MIN_WORDS) -> dict:
    w = Words(t)
    lines = Lines(t, w)
    chars = _counter((t.buf & 0xC0) != 0x80)
    word_chars = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    labels = decode_all(lines.x, lines.at, model)
    size = chars[lines.end] - chars[lines.start]
    content = np.concatenate([[0], np.cumsum(size * (labels == CONTENT))])
    whole = np.concatenate([[0], np.cumsum(size)])
    share = (content[lines.at[1:]] - content[lines.at[:-1]]) / np.maximum(whole[lines.at[1:]] - whole[lines.at[:-1]], 1)
    n, rep = w.counts, _repeated(w)
    failed = (n < min_words) | (100 * rep > 50 * n)
    return {
        "doc_id": t.named, "n_words": n, "word_chars": word_chars[w.at[1:]] - word_chars[w.at[:-1]], "n_symbols": _per_doc(_SYMBOL[t.buf], t.at),
        "n_dup_lines": _per_doc(lines.copied, lines.at), "n_repeat_words": rep, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= min_content),
    }


def judge(docs: DataFrame, model: dict, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts and verdict of each document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in texts(b):
                yield batch(SCHEMA, **_judge(t, model, min_content))

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def keep(docs: DataFrame, model: dict, min_content: float = MIN_CONTENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns, whose text passes; judged beside the row, so no join is needed.

    min_words is the base rule's least number of words.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def passes(text: pa.Array) -> pa.Array:
        b = pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), text], names=["doc_id", "text"])
        return pa.array(np.concatenate([_judge(t, model, min_content, min_words)["kept"] for _, t in texts(b)] or [np.zeros(0, bool)]))

    return docs.filter(passes("text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
