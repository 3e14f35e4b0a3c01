"""Byte-level text helpers for Arrow batches: blocks of rows, words, and polynomial hashes as NumPy arrays.

Texts stay UTF-8 bytes. A block holds the bytes of consecutive rows, at most BLOCK_BYTES unless one text is longer, so
memory per task is bounded by the block or the longest text. Hashes are 64-bit with natural overflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

U64 = np.uint64
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03))
_INVERSES = tuple(U64(pow(int(b), -1, 1 << 64)) for b in _BASES)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_tables: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """base ** i, or its inverse, for i < n; grown by doubling and kept per Python worker."""
    have = _tables.get((which, inverse))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        row = np.full(size, (_INVERSES if inverse else _BASES)[which], U64)
        row[0] = 1
        have = _tables[(which, inverse)] = np.multiply.accumulate(row)
    return have[:n]


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """H with len(values) + 1 entries; span_hash turns two of them into the hash of a span."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values), which), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    return (h[end] - h[start]) * powers(len(h), which, True)[start]


@dataclass
class Block:
    """Bytes of rows first..first + len(offsets) - 1 of a batch; offsets start at 0."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def text(self, i: int) -> str:
        return self.raw(i).decode("utf-8", "replace")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string or binary column into blocks; null counts as empty with valid False."""
    n = len(column)
    if n == 0:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield Block(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], valid[i:j])
        i = j


def block_of(parts: list[bytes]) -> Block:
    """The given byte strings as one block."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return Block(0, np.frombuffer(b"".join(parts), np.uint8), offsets, np.ones(len(parts), bool))


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block: byte spans, and for each row the range of its words."""

    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def words(block: Block) -> Words:
    n = len(block.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(block) + 1, np.int64))
    inside = ~SPACE[block.data]
    cut = np.zeros(n + 1, bool)
    cut[block.offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, block.offsets))


def word_hashes(block: Block, w: Words, which: int = 0, lower: bool = False) -> np.ndarray:
    data = LOWER[block.data] if lower else block.data
    return mix(span_hash(prefix_hash(data, which), w.start, w.end, which))


def gram_hashes(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = prefix_hash(hashes, which)
    return mix((h[k:] - h[:n]) * powers(n, which, True))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] values, then the next range."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns except those of the added names, then the added ones."""
    names = [c for c in batch.schema.names if c not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added.values()], [*names, *added])
