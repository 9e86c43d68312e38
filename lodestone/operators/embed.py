"""Feature-hashing embeddings and the plug-in surface for other embedders."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W

DIM = 384
ROWS = 2000  # that a task embeds at once
ROWS_AT_ONCE = 400  # whose features a task sums at once, where they are summed by range


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


#: Messages that are hashed at once, and the longest of one block of MD5.
AT_ONCE, SHORT = 1 << 15, 55
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each data[at[i] : at[i + 1]] (bytes) the first half of its MD5 as a number: many short ones in each step."""
    sizes, out = np.diff(at), np.empty(len(at) - 1, np.uint64)
    for lo in range(0, len(out), AT_ONCE):
        size = np.where(sizes[lo : lo + AT_ONCE] <= SHORT, sizes[lo : lo + AT_ONCE], 0)
        n = len(size)
        block = np.zeros((n, 64), np.uint8)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        block.ravel()[np.repeat(np.arange(n) * 64, size) + nth] = data[np.repeat(at[lo : lo + n], size) + nth]
        block[np.arange(n), size] = 0x80
        word = np.ascontiguousarray(block.view("<u4").T)
        word[14] = size * 8
        a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += word[g]
            f += np.uint32(_SINES[i])
            turn = _TURNS[i // 16][i % 4]
            a, b, c, d = d, b + ((f << turn) | (f >> (32 - turn))), b, c
        a, b = (a + np.uint32(0x67452301)).byteswap(), (b + np.uint32(0xEFCDAB89)).byteswap()
        out[lo : lo + n] = a.astype(np.uint64) << 32 | b
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = int.from_bytes(md5(data[at[i] : at[i + 1]].tobytes()).digest()[:8], "big")
    return out


def _bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, and where each begins (one more for the end)."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), at


def _grams(names: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different 4-grams of names between ^ and $, how many each name has, and which. Terms are ASCII (patterns.TERM)."""
    data, at = _bytes(pc.binary_join_element_wise("^", names, "$", ""))
    sizes = np.diff(at)
    many = np.maximum(sizes - 3, 1)
    start = np.repeat(at[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    data = np.r_[data, np.zeros(3, np.uint8)].astype(np.uint32)
    code = data[start] | data[start + 1] << 8 | data[start + 2] << 16
    code |= np.where(np.repeat(sizes > 3, many), data[start + 3], 0).astype(np.uint32) << 24
    code, which = np.unique(code, return_inverse=True)
    letters = code.astype("<u4").view(np.uint8).reshape(-1, 4)
    return _hashes(letters[letters > 0], np.r_[0, np.cumsum((letters > 0).sum(axis=1))]), many, which


def _vectors(t: W.Terms, dim: int) -> Iterator[tuple[W.Terms, np.ndarray]]:
    """ROWS rows of terms at a time, and a row of sums of weights for each: the features of a stretch are hashed at once."""
    names, rows = t.names.cast(pa.string()), t.rows()
    signed = lambda h, weight: ((h % np.uint64(dim)).astype(np.int64), np.where(h % np.uint64(2) == 1, weight, -weight))
    word, word_weight = signed(_hashes(*_bytes(names)), 1.0)
    hashes, many, which = _grams(names)
    gram, gram_weight = (x[which] for x in signed(hashes, 0.25))
    first = np.cumsum(many) - many
    near = np.flatnonzero(rows[1:] == rows[:-1])
    pair = pa.array(t.code[near].astype(np.int64) * len(names) + t.code[near + 1]).dictionary_encode()
    own = pair.indices.to_numpy(zero_copy_only=False)
    left, right = (names.take(pa.array(x)) for x in np.divmod(pair.dictionary.to_numpy(), max(len(names), 1)))
    both, both_weight = (x[own] for x in signed(_hashes(*_bytes(pc.binary_join_element_wise(left, right, "|"))), 0.6))
    for lo in range(t.lo, t.hi, ROWS):
        part = t.part(lo, min(lo + ROWS, t.hi))
        n, base = part.hi - part.lo, part.rows() * dim
        used = many[part.code]
        at = np.repeat(first[part.code] - (np.cumsum(used) - used), used) + np.arange(used.sum())
        out = np.bincount(np.repeat(base, used) + gram[at], gram_weight[at], n * dim)
        out += np.bincount(base + word[part.code], word_weight[part.code], n * dim)
        begin, end = (t.at[x - t.lo] for x in (part.lo, part.hi))
        some = slice(*np.searchsorted(near, [begin, end]))
        out += np.bincount(base[near[some] - begin] + both[some], both_weight[some], n * dim)
        yield part, out.reshape(n, dim)


#: The weights of words, pairs and 4-grams as whole numbers, so that sums over ranges of terms are exact differences.
_WHOLE, _PAIRED, _PART = 20.0, 12.0, 5.0


class Ranges(NamedTuple):
    """Rows that consist of ranges of a stretch's terms: begin and end of each range, in order of the rows and within them, and its row.

    No range is empty; rows without terms have none.
    """

    n: int
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.bincount(self.row, self.hi - self.lo, self.n).astype(np.int64)


def of_ranges(t: W.Terms, ranges: Ranges, dim: int = DIM) -> Iterator[tuple[int, np.ndarray]]:
    """The first of ROWS rows at a time, and their unit vectors: what ``_vectors`` makes of the rows' terms, up to rounding.

    Features are summed up to each place where a range of some rows begins or ends, once for ranges that overlap; rows are made of
    differences.  So rows should come in the order of what they are ranges of.
    """
    names, code = t.names.cast(pa.string()), t.code.astype(np.int64)
    signed = lambda h, weight: ((h % np.uint64(dim)).astype(np.int64), np.where(h % np.uint64(2) == 1, weight, -weight))
    word, word_weight = signed(_hashes(*_bytes(names)), _WHOLE)
    hashes, many, which = _grams(names)
    gram, gram_weight = (x[which] for x in signed(hashes, _PART))
    first = np.cumsum(many) - many
    joint = np.flatnonzero(ranges.row[1:] == ranges.row[:-1])  # where a row goes on with another range
    left, right = np.r_[code[:-1], code[ranges.hi[joint] - 1]], np.r_[code[1:], code[ranges.lo[joint + 1]]]
    pair = pa.array(left * len(names) + right).dictionary_encode()
    own = pair.indices.to_numpy(zero_copy_only=False)
    left, right = (names.take(pa.array(x)) for x in np.divmod(pair.dictionary.to_numpy(), max(len(names), 1)))
    both, both_weight = (x[own] for x in signed(_hashes(*_bytes(pc.binary_join_element_wise(left, right, "|"))), _PAIRED))
    n = max(len(code) - 1, 0)  # pairs of the stretch; those of joints follow
    both_in, weight_in = np.r_[both[:n], 0], np.r_[both_weight[:n], 0.0]  # of each term the pair that it begins

    def sums(a: int, b: int, lo: int, x: np.ndarray) -> None:
        """Adds the ranges a to b to their rows of x, whose first is lo."""
        begins, ends, row = ranges.lo[a:b], ranges.hi[a:b], ranges.row[a:b] - lo
        bounds = np.unique(np.r_[begins, ends])
        begin, end = np.searchsorted(bounds, begins), np.searchsorted(bounds, ends)
        used = np.cumsum(np.bincount(begin, minlength=len(bounds)) - np.bincount(end, minlength=len(bounds)))[:-1] > 0
        size = np.where(used, np.diff(bounds), 0)
        base = np.repeat(np.arange(len(size)) * dim, size)
        at = np.repeat(bounds[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = code[at]
        grams = many[own]
        which = np.repeat(first[own] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
        where, weight = np.r_[base + word[own], base + both_in[at], np.repeat(base, grams) + gram[which]], np.r_[word_weight[own], weight_in[at], gram_weight[which]]
        until = np.zeros((len(bounds), dim))
        np.cumsum(np.bincount(where, weight, len(size) * dim).reshape(-1, dim), axis=0, out=until[1:])
        nth = np.arange(b - a) - np.searchsorted(row, row)  # which of its row's ranges
        for k in range(int(nth.max()) + 1):
            some = np.flatnonzero(nth == k)
            x[row[some]] += until[end[some]]
            x[row[some]] -= until[begin[some]]
            x[row[some], both_in[ends[some] - 1]] -= weight_in[ends[some] - 1]  # the pair of a range's last term with the next isn't in the row

    for lo in range(0, ranges.n, ROWS):
        x = np.zeros((min(ROWS, ranges.n - lo), dim))
        cuts = np.searchsorted(ranges.row, np.r_[lo : lo + len(x) : ROWS_AT_ONCE, lo + len(x)])
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                sums(a, b, lo, x)
        j = slice(*np.searchsorted(ranges.row[joint], [lo, lo + len(x)]))
        np.add.at(x, (ranges.row[joint[j]] - lo, both[n:][j]), both_weight[n:][j])
        yield lo, unit(x)


def hashing(rows: DataFrame, key: str | list[str], text: str, dim: int = DIM) -> DataFrame:
    """The key columns and vec array<double>: unit vectors of hashed terms, adjacent pairs and 4-grams.

    text: a column of texts, or of their search terms where those are at hand.
    """
    keys = [key] if isinstance(key, str) else key
    at_hand = rows.schema[text].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (W.of_lists if at_hand else W.of_texts)(b.column("terms")):
                for t, sums in _vectors(some, dim):
                    x = unit(sums)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(t.lo, t.hi - t.lo) for c in keys), lists], names=[*keys, "vec"])

    terms = F.col(text) if at_hand else W.lowered(F.col(text))
    schema = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys) + "vec array<double>"
    return rows.select(*keys, terms.alias("terms")).mapInArrow(run, schema)


class Hashing(NamedTuple):
    """``hashing`` of chunks: called, it gives the table chunk_id, okey, vec; of_terms gives the vectors in a task that has terms at hand.

    text: the column that is embedded.
    """

    text: Callable[[], Column]
    dim: int = DIM

    def __call__(self, chunks: DataFrame) -> DataFrame:
        return hashing(chunks.withColumn("st", self.text()), ["chunk_id", "okey"], "st", self.dim)

    def of_terms(self, terms: W.Terms) -> Iterator[tuple[W.Terms, np.ndarray]]:
        return ((t, unit(sums)) for t, sums in _vectors(terms, self.dim))

    def of_ranges(self, terms: W.Terms, ranges: Ranges) -> Iterator[tuple[int, np.ndarray]]:
        return of_ranges(terms, ranges, self.dim)


def plugged(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """key, vec of a user's function from at most ``batch`` texts to a matrix; rows are brought to length one."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.slice(lo, batch)
                x = unit(np.asarray(embed([t or "" for t in part.column("text").to_pylist()]), float))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["key", "vec"])

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vec array<double>").withColumnRenamed("key", key)


def normalised(vec):
    """A vector column at length one, in built-in functions."""
    n = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vec, lambda x: x / F.when(n == 0, 1.0).otherwise(n))
