"""Words of Arrow text columns as numpy arrays, found and hashed a chunk of texts at a time.

A chunk is a run of whole texts of about ``CHUNK_BYTES`` together (one longer text is a chunk
of its own), so the working set is bounded by the chunk and never by the batch. Hashes are
64 bits. Those of words and word sequences add up one mixed value for each part and its place, so
no arithmetic relation between two of them makes them agree. Those of other spans are a polynomial of
the bytes, mixed; it is for spans of a few hundred bytes, as some pairs of longer ones agree by construction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _fold_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte by byte: 0 for separators, else the byte plus 1, with A-Z lower-cased on request."""
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[0x41:0x5B] += 0x20
    table[list(separators)] = 0
    return table


_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_LOWER = _fold_table(_NOT_ALNUM, lower=True)
#: words [^\x20\x09-\x0D]+
SPACED = _fold_table(_SPACES, lower=False)
#: words [^\x20\x09-\x0D]+ after lower-casing A-Z
SPACED_LOWER = _fold_table(_SPACES, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reserve(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = _BASE_INVERSE
        _inverse_powers = np.multiply.accumulate(steps)


def sequence_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:end]``; runs are in order, apart from each other and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sizes = end - start
    begins = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    parts = values[np.repeat(start, sizes) + place].astype(np.uint64)
    parts = mix(parts * _BASE + place.astype(np.uint64) * _PLACE)
    return mix(np.add.reduceat(parts, begins) + sizes.astype(np.uint64))


class SpanHashes:
    """Hashes of any short byte spans of a buffer, from one running polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        _reserve(n)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * _inverse_powers[start])


@dataclass(frozen=True)
class Chunk:
    """Texts ``first`` to ``first + len(self)`` of a batch; ``offsets`` into ``data``."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass(frozen=True)
class Words:
    """Words in text order: the chunk's text each is in, its bytes and, once asked for, its hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    folded: np.ndarray

    @cached_property
    def hash(self) -> np.ndarray:
        return sequence_hashes(self.folded, self.start, self.end)

    def firsts(self) -> np.ndarray:
        """Index of each text's first word."""
        return np.cumsum(self.counts) - self.counts


def text_chunks(column: pa.Array | pa.ChunkedArray, together: int = 1) -> Iterator[Chunk]:
    """The texts of an Arrow column, NULL as the empty text, in bounded chunks.

    Runs of ``together`` texts are never cut apart.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last - (last - first) % together, first + together), len(column))
        cut = offsets[first : last + 1]
        yield Chunk(first, cut - cut[0], data[cut[0] : cut[-1]])
        first = last


def find_words(chunk: Chunk, table: np.ndarray) -> Words:
    """All words of a chunk under a fold table."""
    folded = table[chunk.data]
    inside = np.zeros(len(folded) + 2, bool)
    inside[1:-1] = folded != 0
    edges = inside[1:] != inside[:-1]
    # a text's first byte starts a word even where the text before ends in one
    bounds = chunk.offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(folded))]
    joined = np.unique(bounds[inside[bounds] & inside[bounds + 1]])
    places = np.flatnonzero(edges)
    start, end = places[::2], places[1::2]
    if len(joined):
        start = np.sort(np.concatenate([start, joined]))
        end = np.sort(np.concatenate([end, joined]))
    text = np.searchsorted(chunk.offsets, start, side="right") - 1
    counts = np.bincount(text, minlength=len(chunk)).astype(np.int64)
    return Words(text, start, end, counts, folded)


_STEPS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], np.uint64)


def window_hashes(words: Words, width: int, whole_if_shorter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of every run of ``width`` words inside one text.

    With ``whole_if_shorter`` a text of fewer words, but not none, gives one run of all of them.
    """
    n = len(words.hash)
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        reach = n - k
        if reach > 0:
            sums[:reach] += words.hash[k:] * _STEPS[k]
    left = (words.firsts() + words.counts)[words.text] - np.arange(n)
    full = np.flatnonzero(left >= width)
    text, first, value = words.text[full], full, mix(sums[full])
    if whole_if_shorter:
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        if len(short):
            begins, sizes = words.firsts()[short], words.counts[short]
            total = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                more = sizes > k
                total[more] += words.hash[begins[more] + k] * _STEPS[k]
            text = np.concatenate([text, short])
            first = np.concatenate([first, begins])
            value = np.concatenate([value, mix(total + sizes.astype(np.uint64))])
            order = np.argsort(first, kind="stable")
            text, first, value = text[order], first[order], value[order]
    return text, first, value


def text_counts(text: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or number of entries) per text of a chunk."""
    return np.bincount(text, weights=weights, minlength=size)
