"""Sections into token-sized chunks with content-hash ids.

Token counts add up over white space, so each sentence or word is counted once and packing folds over integers.  Two
choices differ on purpose from a plain recursion: a word above the budget is cut at token boundaries, and a budget is
never below one token.  Pieces of an over-long sentence come before the short sentences that wait in front of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions import words as W
from . import pieces as G

_TOKENS = regex.compile(P.TOKEN)
_SENTENCES = regex.compile(P.SENTENCE)
_PARAGRAPHS = regex.compile(r"\n\s*\n")

Counter = Callable[[str], int]
#: Characters of the texts that are cut at once.
AT_ONCE = 1 << 19


def count_tokens(text: str) -> int:
    return len(_TOKENS.findall(text))


class _Packer:
    """Joins pieces while their tokens fit; what is full moves to done."""

    def __init__(self, budget: int, done: list[str]):
        self.budget, self.done, self.parts, self.size = budget, done, [], 0

    def add(self, piece: str, n: int) -> None:
        if self.parts and self.size + n > self.budget:
            self.flush()
        self.parts.append(piece)
        self.size += n

    def flush(self) -> None:
        if self.parts:
            self.done.append(" ".join(self.parts).strip())
        self.parts, self.size = [], 0


def _cut_word(word: str, budget: int) -> list[str]:
    ends = [m.end() for m in _TOKENS.finditer(word)][budget - 1 :: budget]
    bounds = [0, *ends] if ends and ends[-1] == len(word) else [0, *ends, len(word)]
    return [word[a:b] for a, b in zip(bounds, bounds[1:])]


def units(text: str, budget: int, count: Counter = count_tokens) -> list[str]:
    """A paragraph whole if it fits, else sentences packed to the budget, and words of those that are too long."""
    budget = max(1, budget)
    if count(text) <= budget:
        return [text]
    out: list[str] = []
    sentences = _SENTENCES.split(text)
    packer = _Packer(budget, out)
    for s in sentences if len(sentences) > 1 else text.split():
        n = count(s)
        if n <= budget:
            packer.add(s, n)
        elif len(sentences) > 1:
            out.extend(units(" ".join(s.split()), budget, count))
        else:
            out.extend(_cut_word(s, budget))
    packer.flush()
    return out


def tail(text: str, overlap: int, count: Counter = count_tokens) -> str:
    """The longest run of last words with at most overlap tokens."""
    words, n = text.split(), 0
    for i in range(len(words), 0, -1):
        n += count(words[i - 1])
        if n > overlap:
            return " ".join(words[i:])
    return " ".join(words) if overlap > 0 else ""


def pack(text: str, max_tokens: int, overlap: int, count: Counter = count_tokens) -> list[str]:
    """Chunks of at most max_tokens, each but the first begun with the tail of the one before."""
    if overlap >= max_tokens:
        raise ValueError("overlap must be smaller than the chunk size")
    out: list[str] = []
    now, size = "", 0
    for p in _PARAGRAPHS.split(text):
        for u in units(p.strip(), max_tokens - overlap, count) if p.strip() else ():
            n = count(u)
            if now and size + n > max_tokens:
                out.append(now)
                now = tail(now, overlap, count)
                size = count(now)
            now, size = f"{now}\n\n{u}" if now else u, size + n
    return out + [now] if now else out


def faq_chunks(question: str, answer: str, max_tokens: int, count: Counter = count_tokens) -> list[str]:
    return [f"Q: {question}\nA: {piece}" for piece in units(answer, max_tokens - count(question), count)]


def sound(variants: dict[str, tuple[int, int]]) -> None:
    if any(overlap >= max_tokens for max_tokens, overlap in variants.values()):
        raise ValueError("overlap must be smaller than the chunk size")


def stretches(b: pa.RecordBatch, variants: dict[str, tuple[int, int]], count: Counter = count_tokens) -> Iterator[tuple[pa.RecordBatch, G.Stretch, list[dict[str, list[G.Piece]]]]]:
    """Rows of a batch of sections whose texts are worked on at once, these texts, and of each row the chunks by each variant.

    Chunks are ranges of words where these tell them; those of question and answer, of odd texts, and by other counters are texts.
    """
    texts = [t or "" for t in b.column("text").to_pylist()]
    for lo, hi in W.stretches(np.array([len(t) for t in texts], np.int64), AT_ONCE):
        part, own, found = b.slice(lo, hi - lo), G.Stretch(texts[lo:hi]), []
        for i, (text, heading, kind) in enumerate(zip(texts[lo:hi], *(part.column(n).to_pylist() for n in ("heading", "kind")))):
            chunks, counted = {}, lru_cache(1 << 14)(count)  # a text's sentences and words are counted once for all variants
            for v, (max_tokens, overlap) in variants.items():
                if kind != "faq" and count is count_tokens and own.plain(i, max_tokens - overlap):
                    chunks[v] = own.pack(i, max_tokens, overlap)
                else:
                    cut = faq_chunks(heading or "", text, max_tokens, counted) if kind == "faq" else pack(text, max_tokens, overlap, counted)
                    chunks[v] = [G.Piece(t, counted(t), None) for t in cut]
            found.append(chunks)
        yield part, own, found


SCHEMA = "source string, heading string, text string, kind string, section_no int, piece_no int, n_tokens int"


def chunk_sections(sections: DataFrame, max_tokens: int = 220, overlap: int = 30, count: Counter = count_tokens) -> DataFrame:
    """source, heading, text, kind, section_no, piece_no, n_tokens of sections, one batch at a time, without a shuffle."""
    return chunk_variants(sections, {"": (max_tokens, overlap)}, count).drop("variant")


def chunk_variants(sections: DataFrame, variants: dict[str, tuple[int, int]], count: Counter = count_tokens) -> DataFrame:
    """variant and the columns of chunk_sections: the chunks by each of some named (max_tokens, overlap), in one pass of the sections."""
    sound(variants)
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = ["variant", *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, found in stretches(b, variants, count):
                rows = [(v, source, heading or "", c.text, kind, no, i, c.n_tokens) for (source, heading, kind, no), own in zip(zip(*(part.column(n).to_pylist() for n in ("source", "heading", "kind", "section_no"))), found) for v in variants for i, c in enumerate(own[v])]
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return sections.select("source", "heading", "text", "kind", F.col("section_no").cast("int").alias("section_no")).mapInArrow(run, f"variant string, {SCHEMA}")


def chunk_id(source, heading, text):
    return F.substring(F.sha2(F.concat_ws("\u001f", source, heading, text), 256), 1, 16)


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id and okey (corpus order) beside each chunk."""
    return chunks.withColumns({"chunk_id": chunk_id(F.col("source"), F.col("heading"), F.col("text")), "okey": X.order_key(F.col("source"), F.col("section_no"), F.col("piece_no"))})


def distinct_chunks(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """The first row, in corpus order, of each chunk_id (of each value of ``by``). Equal ids share their source, so no other shuffle is added."""
    first = Window.partitionBy(*([by] if by else []), "source", "chunk_id").orderBy("okey")
    return chunks.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def apply_manifest(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Title and date of the manifest's entry where it has them, else the document's. chunks: title, updated."""
    m = manifest.select(F.col("path").alias("source"), F.nullif("title", F.lit("")).alias("_t"), F.nullif("updated", F.lit("")).alias("_u"))
    out = chunks.join(m, "source", "left")
    return out.withColumns({"title": F.coalesce("_t", "title", F.lit("")), "updated": F.coalesce("_u", "updated", F.lit(""))}).drop("_t", "_u")


def describe(chunks: DataFrame, embedder: str = "", model: str = "", prompt_version: str = "", indexed_at: str = "") -> DataFrame:
    """What an index is made of, in one row: chunks, sources, tokens, and who embeds, answers and when it was made."""
    say = lambda v, name: F.lit(v).alias(name)
    return chunks.agg(
        F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"),
        say(embedder, "embedder"), say(model, "model"), say(prompt_version, "prompt_version"), say(indexed_at, "indexed_at"),
    )
