"""Words of Arrow text columns, found with numpy over the bytes of many texts at once.

All separators are ASCII bytes, which never stand inside a longer UTF-8 character, so
bytes can be looked at one by one. Nothing here depends on how texts are dealt into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together. A longer text is cut, at separators only.
PORTION = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Portion(NamedTuple):
    """Bytes of some texts: text ``rows[i]`` has those from starts[i] to starts[i + 1]. Unless
    ``ends``, the last text goes on in the next portion."""

    data: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    ends: bool


class Words(NamedTuple):
    """Words in order, with the place of the word's text in the portion and whether a
    text or a separator comes before the word."""

    words: pa.Array
    part: np.ndarray
    first: np.ndarray


def marks(separators: bytes) -> np.ndarray:
    """A table of bytes: True for those given."""
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


def portions(texts: pa.Array, cuts: np.ndarray, size: int = PORTION) -> Iterator[Portion]:
    """The texts (no nulls) in portions of about ``size`` bytes. Longer texts are cut at bytes that
    ``cuts`` marks, in which case the next portion goes on with the same row."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        if end > row + 1 or b - a <= size:
            yield Portion(data[a:b], offsets[row : end + 1] - a, np.arange(row, end), True)
        else:
            while a < b:
                stop = min(b, a + size)
                while stop < b:
                    found = np.flatnonzero(cuts[data[stop : stop + size]])
                    if len(found):
                        stop += int(found[0])
                        break
                    stop = min(b, stop + size)
                yield Portion(data[a:stop], np.array([0, stop - a]), np.array([row]), stop == b)
                a = stop
        row = end


def split_words(portion: Portion, spaces: np.ndarray, separators: np.ndarray, lower: bool) -> Words:
    """Words are the longest runs of bytes that are neither spaces nor separators."""
    data = portion.data
    apart = separators[data]
    inside = ~(spaces[data] | apart)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = portion.starts[:-1][portion.starts[:-1] < portion.starts[1:]]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    if not len(at):
        return Words(pa.array([], pa.binary()), at, np.zeros(0, dtype=bool))
    ends = np.concatenate(([0], np.cumsum(np.add.reduceat(inside.view(np.uint8), at, dtype=np.int64)))).astype(np.int32)
    kept = data[inside]
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[kept] if lower else kept)])
    part = np.searchsorted(portion.starts, at, side="right") - 1
    passed = np.searchsorted(np.flatnonzero(apart), at)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (part[1:] != part[:-1]) | (passed[1:] != passed[:-1])
    return Words(words, part, first)


def binary_array(lengths: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def lengths_and_bytes(words: pa.Array) -> tuple[bytes, bytes]:
    """A binary array (without offset) as its lengths (unsigned 32-bit integers) and its bytes."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1)
    data = words.buffers()[2]
    return np.diff(ends).astype(np.uint32).tobytes(), b"" if data is None else data.slice(0, int(ends[-1])).to_pybytes()
