"""Vectorised text primitives over Arrow string columns.

A chunk of documents is one byte array with document offsets.  Words, word
hashes, n-gram hashes and sliding minima are computed for all documents of a
chunk at once with numpy; chunks are small, so memory doesn't depend on the
number of documents, only on the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Bytes whose words are hashed at a time: tables of powers and running sums are 8 bytes for each.
HASH_BYTES = 1 << 17
U64 = np.uint64


def give_back() -> None:
    """Return memory that a task has freed to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not everywhere
        ctypes.CDLL(None).malloc_trim(0)


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Words are runs of bytes that aren't ASCII white space.
NOT_SPACE = ~_table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of digits, lower-case letters and all bytes of non-ASCII characters.
ALNUM = _table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: As ALNUM without digits.
LETTERS = _table((0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Odd multipliers of two independent polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, U64(b))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        _POWERS[base] = _Powers(base)
    return _POWERS[base].get(n)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[starts:ends] for each pair, independent of where the span lies."""
    n = len(values)
    if not n or not len(starts):
        return np.zeros(len(starts), dtype=U64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Chunk(NamedTuple):
    """Rows lo to hi of an Arrow batch; offsets has one entry more than rows."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string or binary column (null: empty) into chunks of whole texts of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words(NamedTuple):
    """starts, ends: bytes of each word in data; first: index of each document's first word, one entry more than documents."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        # A span's hash doesn't depend on its place, so stretches of words are hashed one after the other.
        out = np.empty(len(self.starts), dtype=U64)
        lo = 0
        while lo < len(out):
            at = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, at + HASH_BYTES, side="right")))
            out[lo:hi] = span_hash(self.data[at : int(self.ends[hi - 1])], self.starts[lo:hi] - at, self.ends[lo:hi] - at, base)
            lo = hi
        return out

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def stop(self) -> np.ndarray:
        """For each word, the index after its document's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    inside = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def gram_hashes(hashes: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """Hash of each k consecutive values; entry i is that of values i to i + k."""
    n = len(hashes) - k + 1
    out = np.empty(max(0, n), dtype=U64)
    for lo in range(0, n, HASH_BYTES):
        hi = min(n, lo + HASH_BYTES)
        values = hashes[lo : hi + k - 1].astype(U64)
        values += U64(1)
        up, down = powers(base, len(values) + 1)
        values *= up[: len(values)]
        total = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values, out=total[1:])
        total[k:] -= total[:-k].copy()
        out[lo:hi] = mix(total[k:] * down[: hi - lo])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def group_blocks(batches: Iterator[pa.RecordBatch], key: str, rows: int, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``key`` into tables of whole groups, of about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append(part)
            if sum(b.num_rows for b in held) < rows and sum(b.get_total_buffer_size() if b.num_rows == batch.num_rows else b.nbytes for b in held) < size:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def spans_to_binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([view[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], type=pa.binary())
