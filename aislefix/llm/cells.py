"""Text columns of Arrow batches as flat byte arrays, so that numpy can work on many texts at once.

White space means the six ASCII characters space and U+0009 to U+000D
throughout; a word is a longest run of anything else.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True


@dataclass
class TextSlice:
    """Some rows of a batch: ``data`` holds their bytes, text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def lengths_in_code_points(self) -> np.ndarray:
        return counts_within((self.data & 0xC0) != 0x80, self.offsets)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """The rows in runs of about ``most_bytes``; a longer text is a run of its own."""
    data, offsets = flat_text(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield TextSlice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@cache
def _trim():
    """The C library's call that returns freed memory to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release_memory() -> None:
    """Give back what a task has freed: its worker stays for a minute or more beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def counts_within(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many set places of ``mask`` each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of the first word at or after its start."""
    ink = ~_WHITE[data]
    if not len(ink):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:-1]
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span, as an Arrow array. Spans are in order and do not overlap."""
    offsets = np.empty(2 * len(starts) + 1, np.int64)
    offsets[0:-1:2], offsets[1::2] = starts, ends
    offsets[-1] = ends[-1] if len(ends) else 0
    both = pa.Array.from_buffers(
        pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, equal for equal bytes, and the distinct values by number."""
    coded = span_values(data, starts, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
