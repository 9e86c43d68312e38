"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a piece is at most ``leaf`` characters; leaves are encoded alone, and neighbours are joined up
the tree.  A join re-encodes only a window around the seam.  A window ends where white space follows a non-space
character: no match of the pre-tokenizer pattern spans such a place (a space can only begin a match, and a run of white
space holds nothing else), and every match before it is settled by characters up to it.  So tokens outside are provably
those of the whole text.  Each window reaches one such place further on either side than the proof needs, and the tokens
of these margins are held against the ones there were; while they differ, the window grows by a place a side.  If a side
has no such place the window takes that whole side, so a text without white space costs its length at each level of the
tree.  Decoding concatenates the token bytes up the same tree.

Defined results: null and empty texts give no tokens and the digests of the empty string; other columns are untouched;
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, table

LEAF = 512
#: White space that every regex dialect agrees on, after what none calls white space.
_SEAM = re.compile(r"\S(?=[ \n\r\t])")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str):
    """The encoder of a rank file, each token's length in bytes, and each id's decimal text; once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return enc, size, [str(i) for i in range(len(size))]


def _settled_before(text: str) -> Iterator[int]:
    """The settled places of a text that something will follow, the last first; then 0."""
    hi, width = len(text), 64
    while hi:
        lo = max(0, hi - width)
        # a place at hi was given before, one at lo needs the character before it
        for m in reversed([m for m in _SEAM.finditer(text, max(0, lo - 1), min(len(text), hi + 1)) if lo < m.end() < (hi if hi < len(text) else hi + 1)]):
            yield m.end()
        hi, width = lo + 1 if lo else 0, 4 * width
    yield 0


def _settled_after(text: str) -> Iterator[int]:
    """The settled places of a text that something precedes, the first first; then its end."""
    for m in _SEAM.finditer(text):
        yield m.end()
    yield len(text)


def _cut_ids(ids: list[int], size: np.ndarray, n_bytes: int, from_end: bool) -> int:
    """How many ids, from that end, make n_bytes; looks no further than they reach."""
    seen = k = 0
    while seen < n_bytes:
        seen += size[ids[-1 - k] if from_end else ids[k]]
        k += 1
    if seen != n_bytes:
        raise AssertionError("a settled place fell inside a token")
    return k


def join(left: tuple[str, list[int]], right: tuple[str, list[int]], enc, size) -> list[int]:
    """Ids of left + right, from the ids of each."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return x or y
    before, after = _settled_before(a), _settled_after(b)
    i, j = next(before), next(after)
    while True:
        u, v = next(before, 0), next(after, len(b))
        ids = enc.encode_ordinary(a[u:] + b[:v])
        kept_x, kept_y = len(x) - _cut_ids(x, size, len(a[u:].encode()), True), _cut_ids(y, size, len(b[:v].encode()), False)
        margin_x, margin_y = x[kept_x : len(x) - _cut_ids(x, size, len(a[i:].encode()), True)], y[_cut_ids(y, size, len(b[:j].encode()), False) : kept_y]
        if (u, v) == (0, len(b)) or (ids[: len(margin_x)] == margin_x and ids[len(ids) - len(margin_y) :] == margin_y):
            return x[:kept_x] + ids + y[kept_y:]
        i, j = u, v


def encode(text: str, enc, size, leaf: int = LEAF) -> list[int]:
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    h = len(text) // 2
    a, b = text[:h], text[h:]
    return join((a, encode(a, enc, size, leaf)), (b, encode(b, enc, size, leaf)), enc, size)


def decode(ids: list[int], enc, leaf: int = 1 << 16) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    h = len(ids) // 2
    return decode(ids[:h], enc, leaf) + decode(ids[h:], enc, leaf)


def _per_text(path: str, pattern: str, leaf: int, make, schema: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size, names = codec(path, pattern)
        for b in batches:
            ids, col = b.column("doc_id"), b.column("text")
            for lo in range(0, len(col), 256):
                rows = [make(x.as_py() or "", enc, size, names, leaf) for x in col.slice(lo, 256)]
                yield batch(schema, doc_id=ids.slice(lo, 256), **{k: [r[k] for r in rows] for k in schema if k != "doc_id"})

    return run


def _encoded(text, enc, size, names, leaf):
    return {"ids": encode(text, enc, size, leaf)}


def _digests(text, enc, size, names, leaf):
    ids = encode(text, enc, size, leaf)
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(decode(ids, enc)).hexdigest(),
    }


def encode_documents(docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids array<int>: the tokens of each text."""
    schema = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}
    return docs.select("doc_id", "text").mapInArrow(_per_text(ranks, pattern, leaf, _encoded, schema), "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, raw binary: the bytes that the ids of encode_documents stand for."""

    def run(batches):
        enc = codec(ranks, pattern)[0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([decode(x.as_py() or [], enc) for x in b.column("ids")], pa.binary())], names=["doc_id", "raw"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def token_digests(docs: DataFrame, ranks: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, without a shuffle."""
    schema = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return docs.select("doc_id", "text").mapInArrow(
        _per_text(ranks, pattern, leaf, _digests, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def production(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production(table(spark, sf_dir, "documents"))
