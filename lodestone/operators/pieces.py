"""Chunks of many texts at once, in numbers: the tokens, words and sentences of a stretch of texts are found once for all chunkings.

Words are runs without white space, and a sentence, a piece and a chunk are ranges of words, so counts are differences of sums.
What it gives is what ``chunking.pack`` gives with ``chunking.count_tokens``; texts that ranges of words don't tell are left to it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import regex

from ..functions import patterns as P

_WORD, _BLANK, _ODD, _ENDS, _OPENS = 1, 2, 4, 8, 16
#: What a pattern and str.split take for white space differently, and what lower-casing makes ASCII letters of, or longer.
_STRANGE = "\x1c\x1d\x1e\x1fİK"

Span = tuple[int, int]


class Piece(NamedTuple):
    """A chunk, its tokens and, in the order of its words, the ranges of words of the stretch that it is made of; none are given if these don't tell it."""

    text: str
    n_tokens: int
    spans: list[Span] | None


@cache
def _kinds() -> np.ndarray:
    """Of each character whether it is of a word token, white space, strange, ends a sentence, or begins one."""
    kinds, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    for bit, pattern in ((_WORD, r"[\p{L}\p{N}_]+"), (_BLANK, r"\s+"), (_ODD, f"[{_STRANGE}]"), (_ENDS, "[.!?]"), (_OPENS, "[A-Z0-9(\"']")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] |= bit
    return kinds


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Stretch:
    """Texts as one, and where their words begin.

    whole, codes: all texts, as characters and as their numbers.  at: where each text begins (one more for the end).  begins: where
    each word begins.  words: each text's first word (one more for the end).
    """

    def __init__(self, texts: list[str]):
        self.whole = "".join(texts)
        self.at = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        self.codes = codes = characters(self.whole)
        kind = _kinds()[codes]
        blank = np.r_[True, (kind & _BLANK) > 0, True]
        word = (kind & _WORD) > 0
        edge = np.zeros(len(codes) + 1, bool)
        edge[self.at] = True
        token = (kind & (_WORD | _BLANK)) == 0
        token |= word & (~np.r_[False, word[:-1]] | edge[:-1])
        tokens = np.r_[0, np.cumsum(token, dtype=np.int32)]
        self.begins = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
        ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
        self.words = np.searchsorted(self.begins, self.at)
        last, lines = kind[ends - 1], np.r_[0, np.cumsum(codes == 10, dtype=np.int32)]
        sentence = np.flatnonzero((last[:-1] & _ENDS > 0) & (kind[self.begins[1:]] & _OPENS > 0)) + 1
        paragraph = np.flatnonzero(lines[self.begins[1:]] - lines[ends[:-1]] > 1) + 1
        count = tokens[np.r_[self.begins, len(codes)]]
        # lists, since single numbers of them are looked at
        self._b, self._e, self._t, self._sentence, self._paragraph = self.begins.tolist(), ends.tolist(), count.tolist(), sentence.tolist(), paragraph.tolist()
        largest = np.diff(count)
        filled = np.diff(self.words) > 0
        self._largest = np.zeros(len(texts), np.int64)
        if len(largest):
            self._largest[filled] = np.maximum.reduceat(largest, self.words[:-1][filled])
        odd = np.r_[0, np.cumsum((kind & _ODD) > 0, dtype=np.int64)]
        self._odd = np.diff(odd[self.at]) > 0

    def plain(self, no: int, room: int) -> bool:
        """Whether ranges of words tell the chunks of a text: no word has to be cut."""
        return not self._odd[no] and self._largest[no] <= room

    def _raw(self, a: int, b: int) -> str:
        return self.whole[self._b[a] : self._e[b - 1]]

    def _cut(self, a: int, b: int, room: int) -> Iterator[tuple[str, list[Span]]]:
        while a < b:
            e = bisect_right(self._t, self._t[a] + room, a + 1, b + 1) - 1
            yield " ".join(self._raw(a, e).split()), [(a, e)]
            a = e

    def _units(self, a: int, b: int, room: int) -> Iterator[tuple[str, list[Span]]]:
        """What ``chunking.units`` gives of a paragraph, the words a to b."""
        t = self._t
        if t[b] - t[a] <= room:
            yield self._raw(a, b), [(a, b)]
            return
        inner = self._sentence[bisect_right(self._sentence, a) : bisect_left(self._sentence, b)]
        if not inner:
            yield from self._cut(a, b, room)
            return
        whole, begins, ends = self.whole, self._b, self._e
        wait: list[str] = []
        spans: list[Span] = []
        size = 0
        for i, j in zip([a, *inner], [*inner, b]):
            n = t[j] - t[i]
            if n > room:
                yield from self._cut(i, j, room)
                continue
            if wait and size + n > room:
                yield " ".join(wait), spans
                wait, spans, size = [], [], 0
            wait.append(whole[begins[i] : ends[j - 1]])
            if spans and spans[-1][1] == i:
                spans[-1] = (spans[-1][0], j)
            else:
                spans.append((i, j))
            size += n
        if wait:
            yield " ".join(wait), spans

    def _tail(self, spans: list[Span], overlap: int) -> tuple[str, int, list[Span]]:
        """The longest run of last words of spans with at most overlap tokens, how many these are, and where they lie."""
        t, rest, out = self._t, overlap, []
        for a, b in reversed(spans):
            i = max(a, bisect_left(t, t[b] - rest, a, b))
            if i < b:
                out.append((i, b))
                rest -= t[b] - t[i]
            if i > a:
                break
        out.reverse()
        return " ".join([" ".join(self._raw(*s).split()) for s in out]), overlap - rest, out

    def pack(self, no: int, max_tokens: int, overlap: int) -> list[Piece]:
        """The chunks of a text that is plain for max_tokens - overlap."""
        t, out = self._t, []
        p, q = int(self.words[no]), int(self.words[no + 1])
        if p == q:
            return out
        inner = self._paragraph[bisect_right(self._paragraph, p) : bisect_left(self._paragraph, q)]
        now, size, spans = "", 0, []
        for a, b in zip([p, *inner], [*inner, q]):
            for text, own in self._units(a, b, max_tokens - overlap):
                n = sum([t[j] - t[i] for i, j in own])
                if now and size + n > max_tokens:
                    out.append(Piece(now, size, spans))
                    now, size, spans = self._tail(spans, overlap)
                now, size = f"{now}\n\n{text}" if now else text, size + n
                spans = [*spans[:-1], (spans[-1][0], own[0][1]), *own[1:]] if spans and spans[-1][1] == own[0][0] else [*spans, *own]
        out.append(Piece(now, size, spans))
        return out
