"""Whole texts as byte arrays inside tasks: words, rolling hashes, groups of sorted rows.

Everything works on one bounded slice of a record batch at a time, so that a task's
memory follows the longest text and not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

U64 = np.uint64
_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)


class Slice(NamedTuple):
    """Some rows of a batch: text ``i`` is ``data[at[i]:at[i + 1]]``."""

    rows: pa.RecordBatch
    data: np.ndarray
    at: np.ndarray


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[Slice]:
    """The texts of ``column`` as bytes, about ``limit`` bytes at a time; null reads as empty."""
    for batch in batches:
        values = batch.column(column)
        values = values.cast(pa.large_string()) if pa.types.is_string(values.type) else values
        values = values.cast(pa.large_binary())
        if values.null_count:
            values = values.fill_null(b"")
        if not len(values):
            continue
        at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(values):
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield Slice(batch.slice(start, stop - start), data[at[start] : at[stop]], at[start : stop + 1] - at[start])
            start = stop


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and where each text's words begin."""
    solid = ~WHITE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, at)


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch, from one prefix sum."""

    def __init__(self, base: int):
        # A copy travels with every pickled function, so powers are made where they are missing.
        self.base, self.inverse = U64(base), U64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(10, int(n).bit_length())
            step = np.full(size, self.base)
            back = np.full(size, self.inverse)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=U64), np.cumprod(back, dtype=U64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], dtype=U64, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))
        return (prefix[ends] - prefix[starts]) * self.down[starts]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hash of each stretch of ``width`` values, by its start."""
        n = len(prefix) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        self._powers(len(prefix))
        return (prefix[width:] - prefix[:n]) * self.down[:n]


BYTES = Rolling(0x9E3779B97F4A7C15 | 1)
WORDS = Rolling(0xD1342543DE82EF95)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return BYTES.prefix(_MIX[data])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return scramble(BYTES.between(byte_prefix(data), starts, ends) + (ends - starts).astype(U64))


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``width`` items that stay inside one text, and each text's first among them.

    ``first[i]`` is where text ``i`` begins among all items.
    """
    counts = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    return starts, begin


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which a key's rows follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        key = tuple(c[0] for c in columns)
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
