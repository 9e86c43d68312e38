"""Retrieval compared over ways of chunking, in one plan: chunks, statistics, vectors and ranks are keyed by the chunking."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..plans.tables import cut
from . import chunking as C
from . import embed as E
from . import evaluate as V
from . import pieces as G
from . import retrieve as S

SIZES = (60, 120, 220, 400)


def variants(sizes: tuple = SIZES, overlap: int = 30) -> dict[str, tuple[int, int]]:
    """A chunking for each size; its overlap is at most a quarter of it."""
    return {str(n): (n, min(overlap, n // 4)) for n in sizes}


def corpora(sections: DataFrame, chunkings: dict[str, tuple[int, int]]) -> DataFrame:
    """variant, chunk_id, okey, source, heading, terms: the sections by each chunking, read once and written once.

    Repeats of a chunk are looked for by their ids; only rows of repeated ids are sorted, to keep the first, not all texts.
    """
    chunks = C.with_ids(C.chunk_variants(sections, chunkings))
    title = chunks.select("variant", "chunk_id", "okey", "source", F.lit("").alias("title"), "heading", "text")
    return _once(cut(S.with_terms(title).select("variant", "chunk_id", "okey", "source", "heading", "terms")))


def _once(every: DataFrame) -> DataFrame:
    """The first row, in corpus order, of each variant and chunk_id. every: written."""
    ids = ["variant", "chunk_id"]
    again = cut(every.groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    return every.join(again, ids, "left_anti").unionByName(C.distinct_chunks(every.join(again, ids, "left_semi"), "variant").select(*every.columns))


def _spans(found: list[G.Piece], texts: G.Stretch, heads: list[int], start: np.ndarray, ends: np.ndarray) -> E.Ranges:
    """Of each chunk the ranges of the stretch's terms that it is made of, its heading's first.

    heads: of each chunk the text of its heading, or -1.  start: where each term begins.  ends: where each text's terms begin (one
    more for the end); headings, and chunks that are no ranges of words, are texts after those of ``texts``.
    """
    at_word = np.searchsorted(start, np.r_[texts.begins, texts.at[-1]])
    plain = np.array([c.spans is not None for c in found], bool)
    head = np.array(heads, np.int64)
    # headings, then ranges of words, then whole texts: each chunk has ranges of one of the two
    many = np.array([len(c.spans) if c.spans is not None else 0 for c in found], np.int64)
    words = np.fromiter(chain.from_iterable(chain.from_iterable(c.spans for c in found if c.spans is not None)), np.int64).reshape(-1, 2)
    named, whole = np.flatnonzero(head >= 0), np.flatnonzero(~plain)
    text = np.arange(len(ends) - 1 - len(whole), len(ends) - 1)
    row = np.r_[named, np.repeat(np.arange(len(found)), many), whole]
    lo = np.r_[ends[head[named]], at_word[words[:, 0]], ends[text]]
    hi = np.r_[ends[head[named] + 1], at_word[words[:, 1]], ends[text + 1]]
    order = np.argsort(row, kind="stable")
    order = order[(lo < hi)[order]]
    row, lo, hi = row[order], lo[order], hi[order]
    on = np.r_[False, (row[1:] == row[:-1]) & (lo[1:] == hi[:-1])]  # goes on where the one before ends
    first = np.flatnonzero(~on)
    return E.Ranges(len(found), row[first], lo[first], hi[np.r_[first[1:], len(row)] - 1] if len(row) else hi)


def _counted(t: W.Terms, ranges: E.Ranges, place: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, place, tf of the terms that have a place, in order of rows and places."""
    at = S.places(t.names, place)[t.code] if len(t.names) else np.zeros(0, np.int64)
    asked = np.flatnonzero(at >= 0)
    lo, hi = np.searchsorted(asked, ranges.lo), np.searchsorted(asked, ranges.hi)
    many = hi - lo
    found = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    code, tf = np.unique(np.repeat(ranges.row, many) * max(len(place), 1) + at[asked[found]], return_counts=True)
    return *np.divmod(code, max(len(place), 1)), tf


def _read(sections: DataFrame, chunkings: dict[str, tuple[int, int]], names: list[str], near: tuple[np.ndarray, int] | None, embedder: E.Hashing) -> DataFrame:
    """variant, chunk_id, okey, source, heading, section (a number of the section) and what retrieve's lists are made of, of each chunk.

    A text is read once: its tokens, words and terms are found once for all chunkings, features are summed once and its chunks are
    made of differences.  Repeats within a section are dropped here.  near: queries and k.
    """
    own = ["variant", "chunk_id", "okey", "source", "heading"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.array(names, pa.string())
        best = {v: S._Best(*near) for v in chunkings} if near else None
        section = TaskContext.get().partitionId() << 33
        for b in batches:
            for part, texts, cut_up in C.stretches(b, chunkings):
                sources, headings, numbers = (part.column(n).to_pylist() for n in ("source", "heading", "section_no"))
                extra = [h.lower() for h in headings if h]
                named = len(part) + np.cumsum([bool(h) for h in headings]) - 1
                found, heads, rows = [], [], []
                for i, (source, heading, no) in enumerate(zip(sources, headings, numbers)):
                    lead = "".join(x + "\x1f" for x in (source, heading or "") if x is not None)
                    key = "\x01".join([*([] if source is None else [source.replace("/", "\x01")]), *([] if no is None else [str(no)[:10].rjust(10, "0")]), ""])
                    for v, chunks in cut_up[i].items():
                        met: set[str] = set()
                        for n, c in enumerate(chunks):
                            name = sha256((lead + c.text).encode()).hexdigest()[:16]
                            if name not in met:
                                met.add(name)
                                found.append(c)
                                heads.append(int(named[i]) if heading else -1)
                                rows.append((v, name, f"{key}{n:010}", source, heading or "", section + i))
                section += len(part)
                extra += [c.text.lower() for c in found if c.spans is None]
                at = np.r_[texts.at, texts.at[-1] + np.cumsum([len(x) for x in extra], dtype=np.int64)]
                t, start = W.of_characters(np.r_[texts.codes, G.characters("".join(extra))], at)
                ranges = _spans(found, texts, heads, start, t.at)
                cols = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, [pa.string()] * 5 + [pa.int64()])]
                keys = pa.RecordBatch.from_arrays(cols, names=[*own, "section"])
                row, word, tf = _counted(t, ranges, place)
                cols += [pa.array(ranges.lengths().astype(np.int32)), S.rows_of(len(found), row, word.astype(np.int32)), S.rows_of(len(found), row, tf.astype(np.int32))]
                if near:
                    row, query, score = _near(embedder.of_ranges(t, ranges), keys, best)
                    cols += [S.rows_of(len(found), row, query.astype(np.int32)), S.rows_of(len(found), row, score)]
                yield pa.RecordBatch.from_arrays(cols, names=[*own, "section", "dl", "words", "tfs", *(["near_q", "near_s"] if near else [])])

    schema = ", ".join([*(f"{n} string" for n in own), "section bigint", S.WORDS, *([S.NEAR_TO] if near else [])])
    return sections.select("source", "heading", "text", "kind", F.col("section_no").cast("int").alias("section_no")).mapInArrow(run, schema)


def _near(vectors: Iterator[tuple[int, np.ndarray]], keys: pa.RecordBatch, best: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, query, score, in order of rows, of the chunks that are among the best of their variant when they are met."""
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    names = pa.array(list(best), pa.string())
    variant = S.places(keys.column("variant"), names)
    for lo, x in vectors:
        for no, b in enumerate(best.values()):
            at = np.flatnonzero(variant[lo : lo + len(x)] == no)
            if len(at):
                row, query, score = b.of(x[at], keys.take(pa.array(at + lo)))
                kept.append((at[row] + lo, query, score))
    row, query, score = (np.concatenate(x) for x in zip(*kept))
    order = np.argsort(row, kind="stable")
    return row[order], query[order], score[order]


def lists(sections: DataFrame, asked: DataFrame, chunkings: dict[str, tuple[int, int]], k: int = S.CANDIDATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chunks (variant, chunk_id, okey, source, heading) and, of each variant, what ``retrieve.bm25`` and ``retrieve.vector`` give.

    All of it comes from one pass of the sections, which stores neither texts nor terms nor vectors; more than retrieve's AT_ONCE
    queries or FEW_TERMS pairs of question and term take chunks with terms, and a pass a list.
    """
    C.sound(chunkings)
    queries = E.hashing(asked, "qid", "question")
    few, pairs = queries.limit(S.AT_ONCE + 1).toArrow(), S.asked_terms(asked).limit(S.FEW_TERMS + 1).collect()  # bounded
    if few.num_rows > S.AT_ONCE or len(pairs) > S.FEW_TERMS:
        chunks = corpora(sections, chunkings)
        vectors = E.hashing(chunks, ["variant", "chunk_id", "okey"], "terms")
        return chunks.drop("terms"), S.bm25(asked, chunks, k, by="variant"), S.vector(queries, vectors, k, by="variant")
    x = few.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(few.num_rows, -1) if few.num_rows else None
    found = cut(_read(sections, chunkings, S.names_of(pairs), None if x is None else (x, k), E.Hashing(S.search_text)))
    key = F.coalesce("source", F.lit(""))
    several = cut(found.groupBy(key.alias("of")).agg((F.min("section") < F.max("section")).alias("several")).filter("several").select("of"))
    if not several.isEmpty():  # only chunks of sources of several sections may come again
        ids = found.join(several, key == F.col("of"), "left_semi").groupBy("variant", "chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
        if not ids.isEmpty():
            found = cut(_once(found))
    kind = asked.schema["qid"].dataType
    return found.select("variant", "chunk_id", "okey", "source", "heading"), S.scored(pairs, kind, found, k), S.nearest(found, few.column("qid").to_pylist(), kind, k)


def counts(chunks: DataFrame, chunkings: dict[str, tuple[int, int]]) -> DataFrame:
    """mode, chunks: a row a chunking, also of those without chunks."""
    named = chunks.sparkSession.createDataFrame([(v,) for v in chunkings], "mode string")
    n = chunks.groupBy(F.col("variant").alias("mode")).agg(F.count("*").alias("n"))
    return cut(named.join(n, "mode", "left").select("mode", F.coalesce("n", F.lit(0)).alias("chunks")))


def texts(sections: DataFrame, chunkings: dict[str, tuple[int, int]], wanted: DataFrame) -> DataFrame:
    """variant and the columns of chunks, with text, of some (variant, chunk_id, source), few beside all: only sections of their sources are cut again."""
    key = F.coalesce("source", F.lit(""))
    some = sections.join(F.broadcast(wanted.select(key.alias("of")).distinct()), key == F.col("of"), "left_semi")
    again = C.with_ids(C.chunk_variants(some, chunkings)).withColumn("title", F.lit(""))
    return C.distinct_chunks(again.join(F.broadcast(wanted.select("variant", "chunk_id").distinct()), ["variant", "chunk_id"], "left_semi"), "variant")


def report(sections: DataFrame, questions: DataFrame, gold: DataFrame, chunkings: dict[str, tuple[int, int]] | None = None, ks: tuple = V.KS, candidate_k: int = S.CANDIDATES) -> DataFrame:
    """variant, chunks, questions, recall_at_k..., mrr of hybrid retrieval over each chunking; one without chunks has 0 of all.

    sections: as chunk_sections takes them.  questions: qid, question; blank ones find nothing.  gold: as gold_set gives it.
    """
    chunkings = variants() if chunkings is None else chunkings
    chunks, lexical, dense = lists(sections, questions.filter(F.trim("question") != ""), chunkings, candidate_k)
    found = S.fuse([("bm25", lexical), ("vector", dense)], by="variant").filter(F.col("rank") <= max(ks)).select("variant", "qid", "rank", "chunk_id")
    found = cut(found)  # few beside the chunks, and of known size once written
    hits = found.join(chunks.select("variant", "chunk_id", "source", "heading"), ["variant", "chunk_id"]).withColumnRenamed("variant", "mode")
    named = counts(chunks, chunkings)
    return V.retrieval_report(hits, gold, named.select("mode"), ks).join(F.broadcast(named), "mode").withColumnRenamed("mode", "variant")  # a row a chunking
