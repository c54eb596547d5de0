"""Words of whole Arrow text columns by array operations on their UTF-8 bytes.

Texts are read in pieces of bounded size. A text that is longer than a piece comes as several pieces, cut
between words, so that memory stays bounded whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are processed at once.
PIECE = 1 << 18

#: Space and \\t \\n \\v \\f \\r separate words; every other byte belongs to one.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: ASCII letters and digits and all bytes of non-ASCII characters belong to words.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: ASCII letters in lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Piece:
    """Consecutive texts, or a part of one. Word w belongs to row `row[w]` and is buf[start[w]:end[w]]."""

    first: int
    rows: int
    last: bool  # False: the next piece continues this one's only row
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def word(self, w: int) -> bytes:
        return self.buf[self.start[w] : self.end[w]].tobytes()

    def heads(self, chars: int) -> np.ndarray:
        """Where the first `chars` characters of each word end, or the word itself if it is shorter."""
        begins = np.flatnonzero((self.buf & 0xC0) != 0x80)
        at = np.searchsorted(begins, self.start) + chars
        return np.minimum(self.end, np.append(begins, len(self.buf))[np.minimum(at, len(begins))])

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its bytes before `end`, with ASCII letters in lower case."""
        n, to = len(self.buf), self.end if end is None else end
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[LOWER[self.buf]] * power[:n], out=sums[1:])
        h = (sums[to] - sums[self.start]) * inverse[self.start]
        return mix(h + (to - self.start).astype(np.uint64))


def _cut(buf: np.ndarray, inside: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of a long text of about `limit` bytes that end between words; a longer word stays whole."""
    at = 0
    while at < len(buf):
        to = min(at + limit, len(buf))
        if to < len(buf):
            gaps = np.flatnonzero(~inside[buf[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(buf):  # further on, until a word ends
                    gaps = np.flatnonzero(~inside[buf[to : to + limit]])
                    if len(gaps):
                        to += int(gaps[0]) + 1
                        break
                    to = min(to + limit, len(buf))
        yield at, to
        at = to


def _piece(first: int, rows: int, last: bool, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Piece:
    word = inside[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Piece(first, rows, last, buf, offsets, start, end, row)


def pieces(column: pa.Array, inside: np.ndarray, limit: int = PIECE) -> Iterator[Piece]:
    """The pieces of a string column in order. Null texts are empty. Every row is in at least one piece."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        if to > at:
            to = min(to, n)
            yield _piece(at, to - at, True, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], inside)
            at = to
        else:
            text = data[bounds[at] : bounds[at + 1]]
            spans = list(_cut(text, inside, limit))
            for k, (a, b) in enumerate(spans):
                yield _piece(at, 1, k == len(spans) - 1, text[a:b], np.array([0, b - a]), inside)
            at += 1
