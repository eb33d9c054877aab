"""Reading binary messages column by column: one step reads one field of all messages of an Arrow batch.

A batch is one buffer of bytes and, for every message, where it is read next and where it ends. A message that cannot go on is stopped
with the name of a condition and the place at which it was met; what the condition means for its status is decided afterwards. Variable
parts (labels, records, extensions) are steps over the n-th part of all messages that have one.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa

_PAD = 8


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a binary column: message i is bytes[bounds[i]:bounds[i + 1]], empty where null. Padding follows the last message."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.dtype(np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, sizes)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and len(bounds) and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(_PAD, np.uint8)]), bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): for each of ``counts[i]`` members of i, i and the number of the member."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def gathered(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of slices of ``raw``, one behind the other."""
    owner, place = spread(size)
    return raw[begin[owner] + place], np.r_[0, np.cumsum(size)]


def strings(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """Slices of ``raw`` as an Arrow column (for strings they must be ASCII)."""
    data, bounds = gathered(raw, begin, size)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list column of ``n`` rows: the values of each owner in the order given."""
    order = np.argsort(owner, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values.take(pa.array(order)))


class Messages:
    """Messages of one buffer that are read together."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.raw, self.begin, self.at, self.end = raw, begin, begin.copy(), end
        self.why = np.full(len(begin), "", dtype=object)
        self.where = np.full(len(begin), np.iinfo(np.int64).max)

    def __len__(self) -> int:
        return len(self.begin)

    def all(self) -> np.ndarray:
        return np.arange(len(self))

    def stop(self, rows: np.ndarray, condition: str, where: np.ndarray | None = None) -> None:
        """Stops ``rows``; of several conditions the one that stands first in the message counts."""
        place = self.at[rows] if where is None else where
        first = place < self.where[rows]
        self.why[rows[first]], self.where[rows[first]] = condition, place[first]

    def only(self, rows: np.ndarray, holds: np.ndarray, condition: str) -> np.ndarray:
        """``rows`` for which something ``holds``; the others stop."""
        if not holds.all():
            self.stop(rows[~holds], condition)
        return rows[holds]

    def going(self, rows: np.ndarray) -> np.ndarray:
        return rows[self.why[rows] == ""]

    def uint(self, place: np.ndarray, width: int) -> np.ndarray:
        """Big-endian numbers of ``width`` bytes at places of the buffer."""
        value = np.zeros(len(place), np.int64)
        for i in range(width):
            value = value << 8 | self.raw[place + i]
        return value

    def take(self, rows: np.ndarray, size, condition: str = "short") -> tuple[np.ndarray, np.ndarray]:
        """Goes over ``size`` bytes (a number, or one for each of ``rows``): (rows that had them, where these begin)."""
        fits = self.at[rows] + size <= self.end[rows]
        taken = np.broadcast_to(size, len(rows))[fits]
        rows = self.only(rows, fits, condition)
        begin = self.at[rows].copy()
        self.at[rows] = begin + taken
        return rows, begin

    def number(self, rows: np.ndarray, width: int, condition: str = "short") -> tuple[np.ndarray, np.ndarray]:
        rows, begin = self.take(rows, width, condition)
        return rows, self.uint(begin, width)

    def block(self, rows: np.ndarray, width: int, condition: str = "short") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A part behind its own length: (rows, begin, size)."""
        rows, size = self.number(rows, width, condition)
        held = np.zeros(len(self), np.int64)
        held[rows] = size
        rows, begin = self.take(rows, size, condition)
        return rows, begin, held[rows]

    def statuses(self, meaning: Mapping[str, str], going: str) -> np.ndarray:
        """The status of each message; ``going`` is that of messages that were not stopped."""
        return np.array([meaning[w] if w else going for w in self.why], dtype=object)
