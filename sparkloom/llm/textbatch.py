"""Byte views of Arrow text columns, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20  # numpy works on so many bytes at once
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
SPACE = _SPACE


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows): runs of whole rows of about PIECE_BYTES.

    A row longer than that comes in several pieces of its own, cut at white space where
    there is any within the piece.
    """
    data, offsets = column_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        if last > first:
            last = min(last, n)
            yield data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], np.arange(first, last)
            first = last
            continue
        at, end = int(offsets[first]), int(offsets[first + 1])
        while at < end:
            stop = min(end, at + PIECE_BYTES)
            if stop < end:
                spaces = np.flatnonzero(SPACE[data[at:stop]])
                stop = at + int(spaces[-1]) + 1 if len(spaces) else stop
            yield data[at:stop], np.array([0, stop - at]), np.array([first])
            at = stop
        first += 1
