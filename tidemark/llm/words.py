"""Words of whole Arrow batches as hashes, and hashes of word runs, in numpy alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import mix64

#: A-Z as a-z, byte by byte.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Blocks of eight bytes that are mixed at once: about 10 MB with all copies.
_CHUNK = 1 << 17
#: The bytes of a block that belong to its word, by how many are left of it.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_PLACE, _KIND, _LENGTH, _PAIR = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


@dataclass
class Words:
    """Words of consecutive texts: hashes, byte places in ``data``, and ``bounds[i]``, the
    first word of text i (the last entry is the number of all words)."""

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def left(self) -> np.ndarray:
        """How many words of its text each word and those after it are."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))

    def named(self, kind: int) -> np.ndarray:
        """Hashes of another kind: words that share one of one kind do not share that of another."""
        return span_hashes(self.data, self.starts, self.ends, kind)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, of a family by ``kind``.

    Blocks of eight bytes are mixed with their place and the kind, summed, and mixed with the length. No
    step is linear in the bytes, so a text's structure cannot make two spans equal, and a long span is read in parts.
    """
    size = ends - starts
    last = np.cumsum((size + 7) >> 3)
    total = np.zeros(len(starts), np.uint64)
    eights = np.lib.stride_tricks.as_strided(padded := np.append(data, np.zeros(8, np.uint8)), (len(data) + 1, 8), (1, 1)) if len(data) else None
    salt = mix64(np.array([kind], np.uint64) * _KIND + _KIND)
    for low in range(0, int(last[-1]) if len(last) else 0, _CHUNK):
        block = np.arange(low, min(low + _CHUNK, int(last[-1])))
        one, end = np.searchsorted(last, (block[0], block[-1]), "right")
        here = slice(one, end + 1)
        first = last[here] - ((size[here] + 7) >> 3)
        inside = np.minimum(last[here], block[-1] + 1) - np.maximum(first, low)
        filled = np.flatnonzero(inside > 0)
        span = np.repeat(filled, inside[filled])
        place = block - first[span]
        at = starts[here][span] + 8 * place
        value = eights[at].view("<u8").ravel() & _MASKS[np.minimum(ends[here][span] - at, 8)]
        mixed = mix64(value ^ mix64(place.astype(np.uint64) * _PLACE + salt))
        cuts = np.concatenate(([0], np.cumsum(inside[filled])[:-1]))
        total[one + filled] += np.add.reduceat(mixed, cuts)
    return mix64(total + (size.astype(np.uint64) + np.uint64(1)) * _LENGTH)


def batch_words(column: pa.Array, lower: bool = False, translate: np.ndarray | None = None, hashed: bool = True, kind: int = 0) -> Words:
    """Words (see ``WORD_PATTERN``) of a batch of texts; null counts as empty.

    A word's hash depends on its bytes alone, A-Z as a-z if ``lower``, and on ``kind``. ``translate`` names
    another byte for each of the 256 before the texts are split. Without ``hashed`` only the
    places are made.
    """
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    data = data if translate is None else translate[data]
    data = _LOWER[data] if lower else data
    solid = (data != 32) & ((data < 9) | (data > 13))
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], end[last] = solid[first], solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = span_hashes(data, starts, ends, kind) if hashed else np.empty(0, np.uint64)
    return Words(data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


class Runs:
    """Hashes of any runs of words of an array, from those of twice as many words each time.

    A run is named by the two runs of a power of two words that begin and end with it, and its length.
    Each step mixes, so no arrangement of words, however regular, cancels out.
    """

    def __init__(self, hashes: np.ndarray):
        self.levels = [hashes]

    def _level(self, number: int) -> np.ndarray:
        while len(self.levels) <= number:
            half, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mix64(half[:-step] * _PAIR + half[step:]) if len(half) > step else half[:0])
        return self.levels[number]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs from ``first`` to before ``last``; content and length matter, place does not."""
        size = last - first
        out, number = np.zeros(len(first), np.uint64), 0
        while (wide := size >> number).any():
            pick = np.flatnonzero(wide == 1)
            if len(pick):
                level = self._level(number)
                a, b = level[first[pick]], level[last[pick] - (1 << number)]
                out[pick] = mix64(a * _LENGTH + b + size[pick].astype(np.uint64) * _PLACE)
            number += 1
        return out
