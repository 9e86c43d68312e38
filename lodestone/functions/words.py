"""Search terms of many texts at once, as codes of their different terms; for code that runs in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X

_STOP = pa.array(P.STOPWORDS)
#: Of each byte whether a term may hold it anywhere (1), only between two of those (2), or not.
_KIND = np.array([1 if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 2 if chr(i) in "'." else 0 for i in range(256)], np.uint8)
#: Characters, or terms, of the rows that are worked on at once.
CHARACTERS, TERMS = 1 << 20, 1 << 18


class Terms(NamedTuple):
    """Rows from lo to hi of a batch: where each row's terms begin (one more for the end), the terms' codes, and the terms by code."""

    lo: int
    hi: int
    at: np.ndarray
    code: np.ndarray
    names: pa.Array

    def lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.at.astype(np.int32)), self.names.take(pa.array(self.code)))

    def part(self, lo: int, hi: int) -> Terms:
        a, b = self.at[lo - self.lo], self.at[hi - self.lo]
        return Terms(lo, hi, self.at[lo - self.lo : hi - self.lo + 1] - a, self.code[a:b], self.names)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.at))


def lowered(text: Column) -> Column:
    """The column that of_texts takes."""
    return F.lower(X.blank(text))


def stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most that size in all; a row that is larger alone is one."""
    at = np.r_[0, np.cumsum(sizes)]
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _found(data: np.ndarray, at: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All matches of patterns.TERM in the rows data[at[i] : at[i + 1]] (UTF-8), and where in data each begins.

    Terms are ASCII, so bytes tell: letters, digits, and a joining sign between two of them in one row.
    """
    n, kind = len(data), _KIND[data]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    inside = kind == 1
    sign = np.flatnonzero(kind == 2)
    sign = sign[(sign > 0) & (sign + 1 < n)]
    inside[sign[inside[sign - 1] & inside[sign + 1] & ~begins[sign] & ~begins[sign + 1]]] = True
    edge = np.r_[False, inside, False]
    start = np.flatnonzero(inside & (~edge[:n] | begins[:n]))
    size = np.flatnonzero(inside & (~edge[2:] | begins[1:])) + 1 - start
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data[inside]))
    return terms, start


def _coded(found: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which matches are no stop words, the codes of these, folded, and the terms by code."""
    coded = found.dictionary_encode()
    words = coded.dictionary
    keep = ~pc.is_in(words, value_set=_STOP).to_numpy(zero_copy_only=False)
    plural = pc.ends_with(words, "s")  # only these may be folded
    words = pc.replace_with_mask(words, plural, pa.array([X.folded(w) for w in words.filter(plural).to_pylist()], pa.string()))
    folded = words.filter(pa.array(keep)).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    stays = keep[code]
    return stays, folded.indices.to_numpy(zero_copy_only=False)[(np.cumsum(keep) - 1)[code[stays]]], folded.dictionary


def of_texts(texts: pa.Array) -> Iterator[Terms]:
    """What ``text.search_terms`` makes of these texts, which are lower-cased, a stretch of rows at a time."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for lo, hi in stretches(np.diff(bounds), CHARACTERS):
        at = bounds[lo : hi + 1] - bounds[lo]
        found, start = _found(data[bounds[lo] : bounds[hi]], at)
        stays, code, names = _coded(found)
        yield Terms(lo, hi, np.r_[0, np.cumsum(stays)][np.searchsorted(start, at)], code, names)


def of_characters(codes: np.ndarray, at: np.ndarray) -> tuple[Terms, np.ndarray]:
    """The terms of the texts codes[at[i] : at[i + 1]] (numbers of characters, of which A-Z are lower-cased here), and where each term begins."""
    data = np.where(codes < 128, codes, 255).astype(np.uint8)
    data += 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    found, start = _found(data, at)
    stays, code, names = _coded(found)
    start = start[stays]
    return Terms(0, len(at) - 1, np.searchsorted(start, at), code, names), start


def of_lists(lists: pa.ListArray) -> Iterator[Terms]:
    """The same of rows whose terms are at hand."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in stretches(sizes, TERMS):
        coded = lists.slice(lo, hi - lo).flatten().dictionary_encode()
        yield Terms(lo, hi, np.r_[0, np.cumsum(sizes[lo:hi])], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)
