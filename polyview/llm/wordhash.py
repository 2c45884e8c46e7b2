"""64-bit hashes of the lower-cased words of many texts at once, from the bytes of an Arrow column.

A word's bytes are taken eight at a time and mixed into its hash, which starts from its length; the first eight of all words, then
the next eight of those that are longer, and so on. Words of more than LONG bytes are hashed one by one. The words are those of
``common.lowered_words``: A-Z in lower case, cut at the six ASCII white-space characters and at the texts' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from polyview.llm.common import mixed

LONG = 64
# of bytes, where what is below wraps around
_A, _LETTERS, _CASE, _SPACE, _TAB, _TABS = np.array([0x41, 26, 5, 0x20, 0x09, 5], np.uint8)
#: The bytes of a word of 0 to 8 bytes among eight.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BY_SIZE = mixed(np.arange(LONG + 1, dtype=np.uint64) + np.uint64(1))
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _hashes(own: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the words of these sizes that start there; own ends with eight bytes that belong to none."""
    eight = np.ndarray((len(own) - 7,), "<u8", own, strides=(1,))
    h = mixed(eight[start] & _KEPT[np.minimum(size, 8)] ^ _BY_SIZE[np.minimum(size, LONG)])
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(own[start[k] : start[k] + size[k]].tobytes())
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = mixed(h[more] * _TURN ^ eight[start[more] + at] & _KEPT[np.minimum(size[more] - at, 8)])
        at += 8
        more = more[size[more] > at]
    return h


def word_hashes(texts: pa.Array, step: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Over stretches of about ``step`` bytes of texts: number of the first text, hashes of all words in their order, and how many
    words each text has. Nulls have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, places, raw = texts.buffers()
    bounds = np.frombuffer(places, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw if raw is not None else b"", np.uint8)
    first = 0
    while first < len(texts):
        last = min(len(texts), max(first + 1, int(np.searchsorted(bounds, bounds[first] + step))))
        at = bounds[first : last + 1] - bounds[first]
        n = int(at[-1])
        own = np.zeros(n + 8, np.uint8)
        own[:n] = data[bounds[first] : bounds[last]]
        own[:n] |= (own[:n] - _A < _LETTERS).view(np.uint8) << _CASE
        inside = (own[:n] != _SPACE) & (own[:n] - _TAB >= _TABS)
        # a word starts and ends where white space does, and at the texts' ends
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        border = at[(at > 0) & (at < n)]
        starts[border] = inside[border]
        ends[border - 1] = inside[border - 1]
        start = np.flatnonzero(starts)
        size = np.flatnonzero(ends) + 1 - start
        yield first, _hashes(own, start, size), np.diff(np.searchsorted(start, at))
        first = last


class Places:
    """Where hashes stand among ascending distinct ones, by their first bits."""

    def __init__(self, names: np.ndarray):
        self.names = np.append(names, np.uint64((1 << 64) - 1))
        self.rest = np.uint64(64 - min(22, len(names).bit_length() + 3))
        self.first = np.searchsorted(names, np.arange(1 << (64 - int(self.rest)), dtype=np.uint64) << self.rest)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the hash is there."""
        place = self.first[h >> self.rest]
        less = np.flatnonzero(self.names[place] < h)
        while len(less):
            place[less] += 1
            less = less[self.names[place[less]] < h[less]]
        return place, (self.names[place] == h) & (place < len(self.names) - 1)
