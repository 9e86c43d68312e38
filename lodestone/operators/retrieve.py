"""Batch retrieval: BM25, exact vector top-k, rank fusion, reranking, evidence.

questions: qid, question.  chunks: chunk_id, okey (corpus order), title, heading, text.  Scores are ranked at nine
decimals with ties in corpus order, because sums of doubles differ in their last bits from run to run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions import text as X
from ..functions import words as W
from ..plans.tables import cut, parts

K1, B = 1.2, 0.75
CANDIDATES = 20
TOP_K = 4
RRF_K = 60
#: Pairs of question and term that are sent to every task (a few MB); more of them are joined.
FEW_TERMS = 50_000
#: Scores that a task holds at a time.
CELLS = 1 << 21
#: Bytes of query vectors that are sent to every task; more of them meet the vectors' blocks by a product of partitions.
FEW_BYTES = 64 << 20
#: Questions whose lists of both kinds are made in one pass of the texts; a task holds the k best of each.
AT_ONCE = 2048
#: Scores are ranked at nine decimals, so what is this near counts as equal.
NEAR = 1e-8
#: Vectors whose scores give a query's first bound.
SAMPLE = 2048
MODES = ("bm25", "vector", "hybrid", "hybrid+rerank")


def search_text() -> Column:
    return F.concat_ws("\n", X.blank(F.col("title")), X.blank(F.col("heading")), X.blank(F.col("text")))


def chunk_terms(chunks: DataFrame) -> Column:
    """The column ``terms`` of chunks that carry it, as those of a stored index do; else it is worked out."""
    return F.col("terms") if "terms" in chunks.columns else X.search_terms(search_text())


def with_terms(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """chunks with the column terms, as chunk_terms works it out; a stretch of texts at a time, whose different words are looked at once.

    keep: the columns that are wanted beside terms, so that others, like the text, aren't sent through the task.
    """
    own = chunks.columns if keep is None else keep
    if "terms" in chunks.columns:
        return chunks if keep is None else chunks.select(*own, "terms")
    texts = chunks.select(*own, W.lowered(search_text()).alias("terms"))
    schema = StructType([*(chunks.schema[c] for c in own), StructField("terms", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.of_texts(b.column("terms")):
                part = b.slice(t.lo, t.hi - t.lo)
                yield pa.RecordBatch.from_arrays([t.lists() if n == "terms" else part.column(n) for n in b.schema.names], names=b.schema.names)

    return texts.mapInArrow(run, schema)


def uses(texts: DataFrame, text: str = "text") -> DataFrame:
    """term, uses, docs of the texts' search terms: each stretch of texts is counted where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.of_texts(b.column("text")):
                n = len(t.names)
                pair = np.unique(t.rows() * max(n, 1) + t.code)
                cols = [t.names, pa.array(np.bincount(t.code, minlength=n)), pa.array(np.bincount(pair % max(n, 1), minlength=n))]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "uses", "docs"])

    counted = texts.select(W.lowered(F.col(text)).alias("text")).mapInArrow(run, "term string, uses bigint, docs bigint")
    return counted.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def postings(chunks: DataFrame, only: frozenset | None = None) -> DataFrame:
    """term, chunk_id, okey, tf, dl: a chunk's terms are counted where the chunk lies, without a shuffle.

    only: the terms that are asked for, if they are few; others don't leave the task.  A column variant of chunks is kept.
    """
    own = ["chunk_id", "okey", *(["variant"] if "variant" in chunks.columns else [])]
    chunks = chunks.select(*own, chunk_terms(chunks).alias("terms"))
    kinds = ", ".join(f"{n} {chunks.schema[n].dataType.simpleString()}" for n in own)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            lists = b.column("terms")
            dl = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            words = lists.flatten().dictionary_encode()
            code = np.repeat(np.arange(len(b)), dl) * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
            pair, tf = np.unique(code, return_counts=True)
            row, word = np.divmod(pair, max(len(words.dictionary), 1))
            if only is not None:
                wanted = np.array([w in only for w in words.dictionary.to_pylist()], bool)[word] if len(word) else np.zeros(0, bool)
                row, word, tf = row[wanted], word[wanted], tf[wanted]
            at = pa.array(row)
            arrays = [words.dictionary.take(pa.array(word)), *(b.column(n).take(at) for n in own), pa.array(tf), pa.array(dl[row])]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", *own, "tf", "dl"])

    return chunks.mapInArrow(run, f"term string, {kinds}, tf bigint, dl int")


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """n, avgdl in one row (of each value of ``by``); chunks without terms count too, an empty corpus has avgdl 1."""
    return chunks.select(*by, F.size(chunk_terms(chunks)).alias("dl")).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def _top(scored: DataFrame, k: int, by: tuple = ()) -> DataFrame:
    order = Window.partitionBy(*by, "qid").orderBy(F.round("score", 9).desc(), "okey", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _groups(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of a batch by their value of the column variant."""
    coded = b.column("variant").dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(coded.dictionary.to_pylist()):
        yield name, b if len(coded.dictionary) == 1 else b.take(pa.array(np.flatnonzero(code == i)))


WORDS = "dl int, words binary, tfs binary"  # of a chunk its length, and places and uses of the terms that are asked for
NEAR_TO = "near_q binary, near_s binary"  # of a chunk the queries that it was among the k best of its task for, when it was read, and its scores


def _asked_words(chunks: DataFrame, names: list[str], near: tuple[Callable, np.ndarray, int] | None = None) -> DataFrame:
    """variant, chunk_id, okey and WORDS of chunks: their texts, or their terms if at hand, are read once, and only asked terms go on.

    near: what makes vectors of terms, queries and k.  Then the chunks (of one variant) are compared with the queries where their
    terms are at hand, and NEAR_TO goes on too, not the vectors.
    """
    own, at_hand = ["variant", "chunk_id", "okey"], "terms" in chunks.columns
    kinds = ", ".join(f"{n} {chunks.schema[n].dataType.simpleString()}" for n in own)
    more = ["near_q", "near_s"] if near else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.array(names, pa.string())
        best = _Best(*near[1:]) if near else None
        for b in batches:
            for t in (W.of_lists if at_hand else W.of_texts)(b.column("terms")):
                part = b.slice(t.lo, t.hi - t.lo)
                row, word, tf = _counted(t, place)
                cols = [*(part.column(n) for n in own), pa.array(np.diff(t.at).astype(np.int32)), *(rows_of(len(part), row, x.astype(np.int32)) for x in (word, tf))]
                if near:
                    kept = [(some.lo - t.lo, *best.of(x, part.slice(some.lo - t.lo, some.hi - some.lo))) for some, x in near[0](t)]
                    row, query, score = (np.concatenate(x) for x in zip(*((lo + row, query, score) for lo, row, query, score in kept)))
                    cols += [rows_of(len(part), row, query.astype(np.int32)), rows_of(len(part), row, score)]
                yield pa.RecordBatch.from_arrays(cols, names=[*own, "dl", "words", "tfs", *more])

    return chunks.select(*own, (F.col("terms") if at_hand else W.lowered(search_text())).alias("terms")).mapInArrow(run, ", ".join([kinds, WORDS, *([NEAR_TO] if near else [])]))


def _codes(c: pa.Array) -> np.ndarray:
    """A number of each value, the same of equal ones."""
    return c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class _Best:
    """The k best so far of each query in a task, ranked as ``_top`` ranks them: what isn't among them when it is met never is.

    Of rows of one chunk_id only the first counts, so that those that are dropped later leave k others.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)  # at nine decimals, the best first
        self.keys = {n: np.empty((len(queries), k), object) for n in ("okey", "chunk_id")}

    def of(self, x: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, query, score, in order of rows, of those vectors x (of rows) that are now among a query's best."""
        step = max(1, CELLS // max(len(self.queries), 1))
        kept = [(lo, *self._of(x[lo : lo + step], rows.slice(lo, step))) for lo in range(0, len(x), step)]
        row, query, score = (np.concatenate(c) for c in zip(*((lo + row, query, score) for lo, row, query, score in kept)))
        return row, query, score

    def _of(self, x: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, k = x @ self.queries.T, self.k
        floor = self.score[:, -1]
        if len(x) > 2 * k and np.isneginf(floor).any():
            _, once = np.unique(_codes(rows.column("chunk_id")), return_index=True)
            if len(once) >= k:
                floor = np.maximum(floor, np.partition(s if len(once) == len(x) else s[once], -k, axis=0)[-k])
        row, query = np.nonzero(s >= floor - NEAR)
        if not len(row):
            return row, query, s[row, query]
        met = np.unique(query)  # only these queries' best are ranked anew
        held_q, held_at = np.nonzero(np.isfinite(self.score[met]))
        held_q = met[held_q]
        nine = np.r_[self.score[held_q, held_at], s[row, query].round(9)]
        whose = np.r_[held_q, query]
        keys = {n: np.r_[self.keys[n][held_q, held_at], np.array(rows.column(n).take(pa.array(row)).to_pylist(), object)] for n in self.keys}
        table = pa.table({"q": whose, "s": -nine} | {n: pa.array(v.tolist(), rows.schema.field(n).type) for n, v in keys.items()})
        order = pc.sort_indices(table, [("q", "ascending"), ("s", "ascending"), ("okey", "ascending"), ("chunk_id", "ascending")]).to_numpy()
        whose = whose[order]
        ids = _codes(table.column("chunk_id").combine_chunks())[order]
        _, once = np.unique(whose * len(order) + ids, return_index=True)
        once.sort()
        order, whose = order[once], whose[once]
        rank = np.arange(len(order)) - np.searchsorted(whose, whose)
        order, whose, rank = (v[rank < k] for v in (order, whose, rank))
        self.score[whose, rank] = nine[order]
        for n, v in keys.items():
            self.keys[n][whose, rank] = v[order]
        new = np.sort(order[order >= len(held_q)]) - len(held_q)
        return row[new], query[new], s[row[new], query[new]]


def rows_of(n: int, row: np.ndarray, x: np.ndarray) -> pa.Array:
    """The numbers x of each of n rows as its bytes; they come in order of rows."""
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.searchsorted(row, np.arange(n + 1)) * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place, tf of a batch of _asked_words in order of rows and places, and each row's length."""

    many, word = _numbers(b.column("words"), np.int32)
    return np.repeat(np.arange(len(b)), many), word, _numbers(b.column("tfs"), np.int32)[1], b.column("dl").to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(c: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers of that kind each value holds, and all of them."""
    size, data = np.dtype(kind).itemsize, c.buffers()[2]
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.diff(at) // size, np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and len(c) else np.zeros(0, kind)


def _asked_counts(found: DataFrame, n_names: int) -> dict[str, tuple[int, float, np.ndarray]]:
    """Of each variant the number of chunks, their mean length, and how many chunks hold each asked term. found: of _asked_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for variant, b in _groups(whole):
                _, word, _, dl = _unpacked(b)
                sums.setdefault(variant, np.zeros(n_names + 2, np.int64))
                sums[variant] += np.r_[len(b), int(dl.sum()), np.bincount(word, minlength=n_names)]
        for variant, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([variant] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["variant", "at", "n"])

    summed = found.select("variant", "dl", "words", "tfs").mapInArrow(run, "variant string, at bigint, n bigint").groupBy("variant", "at").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # a row a variant and term asked for
        out.setdefault(r.variant, np.zeros(n_names + 2, np.int64))[r["at"]] = r["n"]
    return {v: (int(n[0]), int(n[1]) / int(n[0]), n[2:]) for v, n in out.items()}


def places(names: pa.Array, place: pa.StringArray) -> np.ndarray:
    """Where each name stands in place, or -1."""
    return pc.index_in(names, value_set=place).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(t: W.Terms, place: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, place, tf of the terms that have a place, in order of rows and places."""
    own = places(t.names, place)
    at = own[t.code] if len(own) else np.zeros(0, np.int64)
    has = at >= 0
    code, tf = np.unique(t.rows()[has] * max(len(place), 1) + at[has], return_counts=True)
    return *np.divmod(code, max(len(place), 1)), tf


def bm25(questions: DataFrame, chunks: DataFrame, k: int = CANDIDATES, k1: float = K1, b: float = B, by: str | None = None) -> DataFrame:
    """qid, chunk_id, okey, score, rank of the k best chunks with a common term.

    by: a string column of chunks with few values; the chunks of each value are a corpus of their own, with its own statistics
    and its own k best (``by`` comes first in the result), those of null are in none.

    The questions' terms go to the chunks (if there are more than FEW_TERMS pairs of both, they are joined); a task scores its
    chunks where they lie and passes on k a question and batch.
    """
    asked = asked_terms(questions)
    pairs = asked.limit(FEW_TERMS + 1).collect()  # bounded
    chunks = _keyed(chunks, by)
    if len(pairs) > FEW_TERMS:
        return _of_variants(_top(_joined_scores(asked, with_terms(chunks, ["variant", "chunk_id", "okey"]), k1, b), k, ("variant",)), by)
    found = cut(_asked_words(chunks, names_of(pairs)))  # counted, then scored
    return _of_variants(scored(pairs, questions.schema["qid"].dataType, found, k, k1, b), by)


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(F.array_distinct(X.search_terms(F.col("question")))).alias("term")).distinct()


def names_of(pairs: list) -> list[str]:
    return sorted({r.term for r in pairs})


def scored(pairs: list, qid: DataType, found: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """variant, qid, chunk_id, okey, score, rank of the k best by pairs of question and term. found: of _asked_words, written."""
    names, qids = names_of(pairs), list(dict.fromkeys(r.qid for r in pairs))
    place, no = {w: i for i, w in enumerate(names)}, {q: i for i, q in enumerate(qids)}
    counts = _asked_counts(found, len(names))
    weights = {v: (np.log((n - df + 0.5) / (df + 0.5) + 1), avgdl) for v, (n, avgdl, df) in counts.items()}
    of = np.array(sorted((place[r.term], no[r.qid]) for r in pairs), np.int64).reshape(-1, 2)
    first = np.searchsorted(of[:, 0], np.arange(len(names) + 1))  # a term's questions
    kinds = [qid, *(found.schema[c].dataType for c in ("chunk_id", "okey"))]
    arrow = to_arrow_type(kinds[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(qids, arrow)
        step = max(1, CELLS // max(len(qids), 1))
        least: dict[str, np.ndarray] = {}  # a question's k-th best of any stretch so far
        for whole in batches:
            for variant, rows in _groups(whole):
                idf, avgdl = weights[variant]
                floor = least.setdefault(variant, np.zeros(len(qids)))
                for lo in range(0, len(rows), step):
                    part = rows.slice(lo, step)
                    row, word, tf, dl = _unpacked(part)
                    share = idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                    many = first[word + 1] - first[word]
                    q = of[np.repeat(first[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), 1]
                    score = np.bincount(q * len(part) + np.repeat(row, many), np.repeat(share, many), len(qids) * len(part)).reshape(len(qids), len(part))
                    if len(part) > 2 * k:
                        floor[:] = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
                    i, j = np.nonzero((score > 0) & (score >= floor[:, None] - NEAR))
                    place_of = np.empty(len(part), np.int64)  # in corpus order
                    place_of[pc.sort_indices(part.select(["okey", "chunk_id"]), [("okey", "ascending"), ("chunk_id", "ascending")]).to_numpy()] = np.arange(len(part))
                    order = np.lexsort((place_of[j], -score[i, j].round(9), i))
                    i, j = i[order], j[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[best], j[best]
                    at = pa.array(j)
                    arrays = [part.column("variant").take(at), ids.take(pa.array(i)), part.column("chunk_id").take(at), part.column("okey").take(at), pa.array(score[i, j])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["variant", "qid", "chunk_id", "okey", "score"])

    schema = "variant string, " + ", ".join(f"{c} {t.simpleString()}" for c, t in zip(("qid", "chunk_id", "okey"), kinds)) + ", score double"
    return _top(found.select("variant", "chunk_id", "okey", "dl", "words", "tfs").mapInArrow(run, schema), k, ("variant",))


def _keyed(rows: DataFrame, by: str | None) -> DataFrame:
    return rows.filter(F.col(by).isNotNull()).withColumn("variant", F.col(by)) if by else rows.withColumn("variant", F.lit(""))


def _of_variants(found: DataFrame, by: str | None) -> DataFrame:
    return found.withColumnRenamed("variant", by) if by else found.drop("variant")


def _joined_scores(asked: DataFrame, chunks: DataFrame, k1: float, b: float) -> DataFrame:
    """variant, qid, chunk_id, okey, score by joins of postings and asked terms. chunks: variant, chunk_id, okey, terms."""
    found = cut(postings(chunks).join(asked.select("term").distinct(), "term", "left_semi"))  # counted, then scored
    stats = F.broadcast(statistics(chunks, "variant"))  # a row a variant
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = found.groupBy("variant", "term").agg(F.count("*").alias("df")).join(stats, "variant").select("variant", "term", "avgdl", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = found.join(asked.join(weight, "term"), ["variant", "term"]).select("variant", "qid", "chunk_id", "okey", part.alias("part"))
    return scored.groupBy("variant", "qid", "chunk_id", "okey").agg(F.sum("part").alias("score")).filter("score > 0")


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, np.float64).tobytes()])


def _near(x: np.ndarray, size: int, rounds: int = 3) -> np.ndarray:
    """An order of rows in which each stretch of size rows lies close together: by the nearest of as many centres as stretches."""
    m = -(-len(x) // size)
    if m < 2:
        return np.arange(len(x))
    c = x[np.linspace(0, len(x) - 1, m).astype(int)]
    for _ in range(rounds):
        at = ((c * c).sum(1)[None] / 2 - x @ c.T).argmin(1)
        c = np.stack([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(m)])
    return np.argsort(at, kind="stable")


def _query_blocks(queries: DataFrame, size: int, sample: np.ndarray | None, k: int) -> DataFrame:
    """qid array, q_vecs, floors: blocks of queries that lie close together, and of each the k-th best score in the sample, if that is so large."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1) if len(b) else np.zeros((0, 1))
            order = _near(x, size)
            for lo in range(0, len(b), size):
                at = order[lo : lo + size]
                floor = np.full(len(at), -np.inf)
                if sample is not None and len(sample) >= k:
                    floor = np.partition(x[at] @ sample.T, -k, axis=1)[:, -k]
                ids = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), b.column("qid").take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([ids, _packed(x[at]), _packed(floor)], names=["qid", "q_vecs", "floors"])

    return queries.select("qid", "vec").mapInArrow(run, f"qid array<{queries.schema['qid'].dataType.simpleString()}>, q_vecs binary, floors binary")


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """variant, chunk_id, okey arrays in corpus order, vecs, centre, radius: blocks of a task's vectors of a variant that lie close together."""
    kinds = [f"{n} array<{vectors.schema[n].dataType.simpleString()}>" for n in ("chunk_id", "okey")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for variant, b in (group for whole in frames for group in _groups(whole)):
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
            order = _near(x, size)
            for lo in range(0, len(b), size):
                at = order[lo : lo + size]
                at = at[pc.sort_indices(b.column("okey").take(pa.array(at))).to_numpy()]
                centre = x[at].mean(axis=0)
                radius = float(np.linalg.norm(x[at] - centre, axis=1).max())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), b.column(n).take(pa.array(at))) for n in ("chunk_id", "okey")]
                yield pa.RecordBatch.from_arrays([pa.array([variant]), *lists, _packed(x[at]), _packed(centre), pa.array([radius])], names=["variant", "chunk_id", "okey", "vecs", "centre", "radius"])

    return vectors.select("variant", "chunk_id", "okey", "vec").mapInArrow(run, f"variant string, {', '.join(kinds)}, vecs binary, centre binary, radius double")


def vector(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, query_block: int = 512, block: int = 1024, sample: int = SAMPLE, told=None, by: str | None = None, some: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, okey, score, rank: exact inner products of queries (qid, vec) with all vectors (chunk_id, okey, vec).

    Blocks of queries meet blocks of vectors, so queries x vectors is never a table.  No vector of a block scores more than
    q . centre + |q| radius; a query whose k-th best score so far is above that skips the block.  What it has at first is its
    k-th best in a sample of the vectors.  told: an accumulator of the products of queries and vectors that were worked out.
    by: as in bm25; a query's bound holds for one value of it, so none comes from a sample of all.
    some: vectors to take the sample from, where a limit of all would work out too many.
    """
    vectors, sample = _keyed(vectors, by), 0 if by else sample
    few = (vectors if some is None else some).select("vec").limit(sample).toArrow()  # bounded: any rows will do
    known = few.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(few.num_rows, -1) if few.num_rows else None
    kinds = {n: (queries if n == "qid" else vectors).schema[n].dataType for n in ("qid", "chunk_id", "okey")}
    schema = "variant string, " + ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", score double"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # floors of the query blocks that this task has met, a few numbers a query
        for b in frames:
            for i in range(len(b)):
                qid, ids, keys = (b.column(c)[i].values for c in ("qid", "chunk_id", "okey"))
                x, y, centre = (np.frombuffer(b.column(c)[i].as_buffer()) for c in ("q_vecs", "vecs", "centre"))
                x, y = x.reshape(len(qid), -1), y.reshape(len(ids), -1)
                floor = held.setdefault((b.column("variant")[i].as_py(), b.column("q_no")[i].as_py()), np.frombuffer(b.column("floors")[i].as_buffer()).copy())
                reach = x @ centre + np.linalg.norm(x, axis=1) * b.column("radius")[i].as_py()
                some = np.flatnonzero(reach >= floor - NEAR)
                if not len(some):
                    continue
                s = x[some] @ y.T
                if told is not None:
                    told.add(s.size)
                best = np.argsort(-s.round(9), axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(s, best, 1)
                row, col = np.nonzero(top >= floor[some][:, None] - NEAR)
                if top.shape[1] == k:
                    floor[some] = np.maximum(floor[some], top[:, -1])
                at = pa.array(best[row, col])
                arrays = [pa.array([b.column("variant")[i].as_py()] * len(row), pa.string()), qid.take(pa.array(some[row])), ids.take(at), keys.take(at), pa.array(top[row, col])]
                yield pa.RecordBatch.from_arrays(arrays, names=["variant", "qid", "chunk_id", "okey", "score"])

    q = cut(_query_blocks(queries, query_block, known, k).withColumn("q_no", F.monotonically_increasing_id()))
    size = q.agg(F.coalesce(F.sum(F.length("q_vecs")), F.lit(0))).first()[0]
    met = _blocks(vectors, block).crossJoin(F.broadcast(q) if size <= FEW_BYTES else q)  # a row for each two blocks
    return _of_variants(_top(met.mapInArrow(run, schema), k, ("variant",)), by)


def dense_of(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], k: int = CANDIDATES) -> DataFrame:
    """``vector`` over a table of vectors, or over those that a function gives for chunks, which aren't stored."""
    if not callable(vectors):
        return vector(queries, vectors, k)
    return vector(queries, vectors(chunks), k, some=vectors(chunks.limit(SAMPLE)))


def lists(questions: DataFrame, queries: DataFrame, chunks: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """What bm25 (questions) and dense_of (queries) give.

    Vectors that can be made of terms (``of_terms``, as of embed.Hashing) are made where the terms are counted: each text is
    read and split once for both lists.  More than AT_ONCE queries, or FEW_TERMS pairs of question and term, take a pass a list.
    """
    of_terms = getattr(vectors, "of_terms", None) if callable(vectors) else None
    if of_terms is not None:
        few, pairs = queries.select("qid", "vec").limit(AT_ONCE + 1).toArrow(), asked_terms(questions).limit(FEW_TERMS + 1).collect()  # bounded
        if few.num_rows <= AT_ONCE and len(pairs) <= FEW_TERMS:
            x = few.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(few.num_rows, -1) if few.num_rows else None
            found = cut(_asked_words(_keyed(chunks, None), names_of(pairs), None if x is None else (of_terms, x, k)))
            lexical = scored(pairs, questions.schema["qid"].dataType, found, k).drop("variant")
            return lexical, nearest(found, few.column("qid").to_pylist(), queries.schema["qid"].dataType, k).drop("variant")
    return bm25(questions, chunks, k), dense_of(queries, chunks, vectors, k)


def nearest(found: DataFrame, qids: list, qid: DataType, k: int) -> DataFrame:
    """variant, qid, chunk_id, okey, score, rank of the k best. found: of _asked_words with vectors, or without where there are no queries."""
    schema = "variant string, " + ", ".join(f"{c} {t.simpleString()}" for c, t in (("qid", qid), *((c, found.schema[c].dataType) for c in ("chunk_id", "okey")))) + ", score double"
    if "near_q" not in found.columns:
        return _top(found.sparkSession.createDataFrame([], schema), k, ("variant",))
    arrow = to_arrow_type(qid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(qids, arrow)
        for b in batches:
            many, query = _numbers(b.column("near_q"), np.int32)
            at = pa.array(np.repeat(np.arange(len(b)), many))
            arrays = [b.column("variant").take(at), ids.take(pa.array(query)), b.column("chunk_id").take(at), b.column("okey").take(at), pa.array(_numbers(b.column("near_s"), np.float64)[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["variant", "qid", "chunk_id", "okey", "score"])

    return _top(found.select("variant", "chunk_id", "okey", "near_q", "near_s").filter(F.length("near_q") > 0).mapInArrow(run, schema), k, ("variant",))


def fuse(lists: list[tuple[str, DataFrame]], k: int = RRF_K, by: str | None = None) -> DataFrame:
    """qid, chunk_id, okey, score, rank, ranks, scores: reciprocal-rank fusion of named lists (qid, chunk_id, okey, rank).

    A repeat within a list counts at its first place; ties go to what was seen first, by list and then by rank.
    ranks and scores map a list's name to the place there and, where the list has one, the score there.  by: a column of the
    lists, each of whose values is fused for itself.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    every, keys = None, [by] if by else []
    for no, (name, rows) in enumerate(lists):
        own = F.col("score") if "score" in rows.columns else F.lit(None).cast("double")
        part = rows.groupBy(*keys, "qid", "chunk_id", "okey").agg(F.min(F.struct(F.col("rank").alias("r"), own.alias("s"))).alias("at"))
        part = part.select(*keys, "qid", "chunk_id", "okey", "at.r", "at.s", F.lit(no).alias("no"), F.lit(name).alias("name"))
        every = part if every is None else every.unionByName(part)
    got = every.groupBy(*keys, "qid", "chunk_id", "okey").agg(
        F.sum(1 / (F.col("r") + k)).alias("score"), F.min(F.struct("no", "r")).alias("seen"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "r")))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "s")))).alias("scores"),
    )
    order = Window.partitionBy(*keys, "qid").orderBy(F.round("score", 12).desc(), "seen")
    return got.withColumn("rank", F.row_number().over(order)).drop("seen")


def rerank_score(question: Column, heading: Column, text: Column) -> Column:
    """Share of the question's terms in heading or text, and half the share in the heading again."""
    q = F.array_distinct(X.search_terms(question))
    head, body = X.search_terms(heading), X.search_terms(text)
    both = F.size(F.array_intersect(q, F.array_union(head, body))) + 0.5 * F.size(F.array_intersect(q, head))
    return F.when(F.size(q) == 0, 0.0).otherwise(both / F.size(q))


def coverage(question: Column, text: Column) -> Column:
    q = F.array_distinct(X.search_terms(question))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, X.search_terms(text))) / F.size(q))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(
    questions: DataFrame, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], mode: str = "hybrid", k: int = TOP_K,
    candidate_k: int = CANDIDATES, reranker: Callable | str | None = "lexical", at_hand: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """qid, question, rank, chunk_id, okey, title, heading, text, score, bm25_score, vector_score, rerank_score, ranks.

    questions: qid, question; blank ones have no hits.  query_vectors: qid, vec.  vectors: chunk_id, okey, vec, or a function
    that gives them for rows of chunks (one with ``of_terms``, see lists, in the pass that counts terms): then chunks are embedded
    where they are compared, hits once more, and nothing is stored.
    reranker: "lexical" or a pandas function of (questions, passages) to scores.  at_hand: the lists of bm25 and vector, where a pass
    over the corpus has made them already; then of chunks only the hits are read.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "hybrid+rerank" and reranker is None:
        raise ValueError("mode 'hybrid+rerank' needs a reranker")
    questions = questions.filter(F.trim("question") != "")
    asked = query_vectors.join(questions.select("qid"), "qid", "left_semi")
    if mode in ("bm25", "vector"):
        if at_hand is not None:
            one = at_hand[mode == "vector"]
        else:
            one = bm25(questions, chunks, candidate_k) if mode == "bm25" else dense_of(asked, chunks, vectors, candidate_k)
        found = one.withColumns({"ranks": F.create_map(F.lit(mode), F.col("rank")), "scores": F.create_map(F.lit(mode), F.col("score"))})
    else:
        found = fuse([*zip(MODES, at_hand or lists(questions, asked, chunks, vectors, candidate_k))])
    # the hits of a batch of questions are few beside the chunks: written, their size is known, and Spark sends them to the chunks
    found = cut(found.filter(F.col("rank") <= (candidate_k if mode == "hybrid+rerank" else k)))
    ids = cut(found.select("chunk_id").distinct())
    text = cut(chunks.join(ids, "chunk_id", "left_semi").select("chunk_id", "okey", "title", "heading", "text"))
    near = cut((vectors(text) if callable(vectors) else vectors.join(ids, "chunk_id", "left_semi")).select("chunk_id", "vec"))
    text = text.drop("okey")
    found = found.join(questions.select("qid", "question"), "qid").join(text, "chunk_id")
    found = found.join(asked.select("qid", F.col("vec").alias("qv")), "qid").join(near, "chunk_id")
    found = found.withColumn("vector_score", dot(F.col("qv"), F.col("vec"))).drop("qv", "vec")
    found = found.withColumn("bm25_score", F.coalesce(F.try_element_at("scores", F.lit("bm25")), F.lit(0.0))).drop("scores")
    if mode != "hybrid+rerank":
        return found.withColumn("rerank_score", F.lit(None).cast("double"))
    found = found.repartition(parts(found.sparkSession), "qid")  # written, hits are one small file, which one task would rerank
    if reranker == "lexical":
        found = found.withColumn("rerank_score", rerank_score(F.col("question"), F.col("heading"), F.col("text")))
    else:
        scorer = F.pandas_udf(reranker, "double")
        found = found.withColumn("rerank_score", scorer("question", F.concat_ws("\n", "heading", "text")))
    order = Window.partitionBy("qid").orderBy(F.round("rerank_score", 9).desc(), "rank")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("rank").withColumnRenamed("_r", "rank")


def all_modes(questions: DataFrame, chunks: DataFrame, query_vectors: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], k: int = TOP_K, candidate_k: int = CANDIDATES, modes: tuple = MODES, wanted: DataFrame | None = None) -> DataFrame:
    """mode, qid, rank, chunk_id of each mode's k best, the lists of both kinds being made once (lexical reranking).

    wanted (qid, mode): only these modes of each question, and only the lists that they take.
    """
    questions = questions.filter(F.trim("question") != "")
    asked, lexical = query_vectors.join(questions.select("qid"), "qid", "left_semi"), questions
    if wanted is not None:
        lexical = questions.join(wanted.filter("mode <> 'vector'").select("qid"), "qid", "left_semi")
        asked = asked.join(wanted.filter("mode <> 'bm25'").select("qid"), "qid", "left_semi")
    lexical, dense = (cut(found) for found in lists(lexical, asked, chunks, vectors, candidate_k))
    fused = cut(fuse([("bm25", lexical), ("vector", dense)]).filter(F.col("rank") <= candidate_k).select("qid", "chunk_id", "rank"))
    found = {"bm25": lexical, "vector": dense, "hybrid": fused}
    if "hybrid+rerank" in modes:
        ids = cut(fused.select("chunk_id").distinct())  # of known size, so that Spark sends them to the chunks
        text = cut(chunks.join(ids, "chunk_id", "left_semi").select("chunk_id", "heading", "text"))
        scored = fused.join(questions.select("qid", "question"), "qid").join(text, "chunk_id").repartition(parts(fused.sparkSession), "qid")
        scored = scored.withColumn("s", rerank_score(F.col("question"), F.col("heading"), F.col("text")))
        order = Window.partitionBy("qid").orderBy(F.round("s", 9).desc(), "rank")
        found["hybrid+rerank"] = cut(scored.select("qid", "chunk_id", F.row_number().over(order).alias("rank")))
    every = None
    for mode in modes:
        part = found[mode].filter(F.col("rank") <= k).select(F.lit(mode).alias("mode"), "qid", "rank", "chunk_id")
        every = part if every is None else every.unionByName(part)
    return every if wanted is None else every.join(wanted, ["qid", "mode"], "left_semi")


OK, NO_MODE, NO_RERANKER, NO_EMBEDDER, NO_QUESTION = "ok", "unknown mode", "no reranker", "other embedder", "no question"


def request_status(indexed: str) -> F.Column:
    """Why a request (question, mode, embedder, reranker boolean) can't be searched in an index of the embedder ``indexed``, or ok.

    Of several reasons the first of: mode, reranker, embedder, question. Nulls are no mode, none, another, and blank.
    """
    status = F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), NO_MODE)
    status = status.when((F.col("mode") == "hybrid+rerank") & ~F.coalesce("reranker", F.lit(False)), NO_RERANKER)
    status = status.when(~F.col("embedder").eqNullSafe(F.lit(indexed)), NO_EMBEDDER)
    return status.when(F.trim(F.coalesce("question", F.lit(""))) == "", NO_QUESTION).otherwise(OK)


def search_requests(requests: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], indexed: str, k: int = TOP_K) -> DataFrame:
    """qid, status, rank, chunk_id: the hits of requests (qid, question, mode, embedder, reranker), each by its own mode.

    A request that is rejected, or has no hits, is one row without rank and chunk_id.  Rejected ones are neither embedded
    nor searched.  embed(questions) gives qid, vec.  qid is a key.
    """
    judged = cut(requests.withColumn("status", request_status(indexed)))
    sound = judged.filter(F.col("status") == OK)
    questions = sound.select("qid", "question")
    hits = all_modes(questions, chunks, embed(questions), vectors, k, wanted=sound.select("qid", "mode"))
    return judged.select("qid", "status").join(hits.select("qid", "rank", "chunk_id"), "qid", "left")


def evidence(hits: DataFrame) -> DataFrame:
    """qid, evidence: the best of term coverage and cosine over a question's hits."""
    return hits.groupBy("qid").agg(F.max(F.greatest(coverage(F.col("question"), search_text()), F.col("vector_score"))).alias("evidence"))
