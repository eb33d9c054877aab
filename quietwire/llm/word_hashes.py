"""Hashes of all words of a batch of texts at once, on the bytes of the Arrow buffer (no Python object for a word or a text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 21
PIECE_BYTES = 1 << 22
_FACTOR = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: 1: part of a word (ASCII letters and digits, everything beyond ASCII), 2: other printable ASCII, 0: blanks and controls
_KIND = np.array([1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 if 33 <= c <= 126 else 0 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(factor: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, factor, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


class _Powers:
    """Powers of the factor and of its inverse modulo 2**64, grown when a longer range comes."""

    up = _powers(_FACTOR, 1 << 16)
    down = _powers(pow(_FACTOR, -1, 1 << 64), 1 << 16)

    @classmethod
    def at_least(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_FACTOR, n), _powers(pow(_FACTOR, -1, 1 << 64), n)
        return cls.up, cls.down


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def groups(bounds: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes (one text at least)."""
    first, n = 0, len(bounds) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, min(end, n)
        first = min(end, n)


def words(raw: np.ndarray, bounds: np.ndarray, lower: bool = True, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word of the texts between ``bounds``, in order.

    Words are runs of letters, digits and non-ASCII characters; with ``marks`` runs of other printable characters are words as well.
    """
    starts_at, stop = int(bounds[0]), int(bounds[-1])
    if stop - starts_at > 2 * PIECE_BYTES:  # a very long text: piece by piece, cut between words
        parts, at = [], starts_at
        while at < stop:
            cut = min(stop, at + PIECE_BYTES)
            while cut < stop and not (free := np.flatnonzero(_KIND[raw[cut:cut + 4096]] == 0)).size:
                cut = min(stop, cut + 4096)
            cut = cut + int(free[0]) if cut < stop else stop
            parts.append(words(raw, np.clip(bounds, at, cut), lower, marks))
            at = cut
        return np.concatenate([h for h, _ in parts]), np.concatenate([o for _, o in parts])
    if stop == starts_at:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = raw[starts_at:stop]
    kind = _KIND[data]
    if not marks:
        kind[kind == 2] = 0
    inside = kind != 0
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    own = bounds[:-1] - starts_at
    edge[own[own < len(data)]] = True
    start = np.flatnonzero(edge & inside)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    after = np.flatnonzero(edge)
    place = np.searchsorted(after, start) + 1
    end = np.append(after, len(data))[place]
    up, down = _Powers.at_least(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        value = (_LOWER if lower else _SAME)[data].astype(np.uint64)
        value += np.uint64(1)
        value *= up[:len(data)]
        np.cumsum(value, out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(own, start, "right") - 1


def per_text(values: np.ndarray, owner: np.ndarray, n: int, reduce: np.ufunc, empty) -> np.ndarray:
    """``reduce`` over the values of each text (``owner`` ascending); texts without values get ``empty``."""
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        with np.errstate(over="ignore"):
            out[owner[first]] = reduce.reduceat(values, first)
    return out


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words inside a text; a text of fewer words, but not none, is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, owner
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[first, n])
    with np.errstate(over="ignore"):
        value = np.zeros(n, np.uint64)
        step = np.uint64(0xD6E8FEB86659FD93)
        for i in range(size):
            value[:n - i] = value[:n - i] * step + hashes[i:]
            # positions whose run ends beyond their text are corrected below
        left = np.repeat(first + count, count) - np.arange(n)
        full = left >= size
        short = first[count < size]
        for i, c in zip(short.tolist(), count[count < size].tolist()):
            whole = 0
            for h in hashes[i:i + c].tolist():
                whole = (whole * int(step) + h) & _MASK
            value[i] = np.uint64((whole + c) & _MASK)
            full[i] = True
        return mix(value[full]), owner[full]
