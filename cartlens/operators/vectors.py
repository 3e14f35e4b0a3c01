"""Vectors in plain files of the shared folder, which Python workers map into memory instead of having them sent.

A task writes its vectors to a file of a new name and returns that name, so of a repeated task only the files whose names
came back are read. What a worker maps are pages of the file; its own memory holds the places of the ids and what it has
taken.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WRITTEN = "path string, n long"
_WRITTEN_ARROW = pa.schema([("path", pa.string()), ("n", pa.int64())])


def flat(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """The numbers in a column of bytes, one value after the other."""
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset)
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]))
    return (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])).view(dtype)


def new_file(folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}"


def written(path: str, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], schema=_WRITTEN_ARROW)


def writer(folder: str, width: int, dtype: str, change: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes vectors (idx, data), each changed once, to a file for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids = new_file(folder), [np.zeros(0, np.int64)]
        with open(path, "wb") as out:
            for batch in batches:
                vectors = flat(batch.column("data"), dtype).reshape(-1, width).astype(np.float64)
                out.write(change(vectors).astype(dtype).data)
                ids.append(batch.column("idx").to_numpy())
        ids = np.concatenate(ids)
        ids.tofile(f"{path}.ids")
        yield written(path, len(ids))

    return run


class Vectors:
    """Vectors by id from the files of ``writer``; a worker keeps the last ones it has opened."""

    _last: tuple[list[tuple[str, int]], Vectors] | None = None

    def __init__(self, files: list[tuple[str, int]], width: int, dtype: str) -> None:
        files = [(path, n) for path, n in files if n]
        ids = np.concatenate([np.zeros(0, np.int64), *(np.fromfile(f"{path}.ids", np.int64) for path, _ in files)])
        short = np.int32 if len(ids) < 2**31 else np.int64
        self._dense = len(ids) and ids.min() >= 0 and ids.max() < 4 * len(ids)
        if self._dense:
            self._at = np.zeros(ids.max() + 1, short)
            self._at[ids] = np.arange(len(ids), dtype=short)
        else:
            self._at = np.argsort(ids).astype(short)
            self._ids = ids[self._at]
        self._starts = np.cumsum([0, *(n for _, n in files)])
        self._maps = [np.memmap(path, dtype, "r", shape=(n, width)) for path, n in files]
        self._width, self._dtype = width, dtype

    @classmethod
    def opened(cls, files: list[tuple[str, int]], width: int, dtype: str) -> Vectors:
        if cls._last is None or cls._last[0] != files:
            cls._last = None
            cls._last = files, cls(files, width, dtype)
        return cls._last[1]

    def take(self, ids: np.ndarray) -> np.ndarray:
        """The vectors of ids that are all there, in their order."""
        at = self._at[ids if self._dense else np.searchsorted(self._ids, ids)]
        order = np.argsort(at)
        ends = np.searchsorted(at, self._starts, sorter=order)
        out = np.empty((len(ids), self._width), self._dtype)
        for start, data, a, b in zip(self._starts, self._maps, ends, ends[1:]):
            out[order[a:b]] = data[at[order[a:b]] - start]
        return out
