"""Removal of repeated word windows by super-k-mer partitioning.

A window is `size` consecutive words of one document. Its minimiser is the least of its groups of GROUP words, by hash,
with frequent groups behind all others: those that begin FREQUENT packed strings or more, by counts over all documents. So
the windows on the rim of a passage that very many documents share go by the words around it to many buckets, and only
those inside it, which are alike everywhere, to the buckets of its own groups.
Consecutive windows that share a minimiser leave their document as one packed string, for the bucket of that minimiser;
equal windows have equal minimisers, so a bucket sees every copy. There the windows are sorted by two independent
64-bit hashes of their words, each group of equal ones keeps its first (smallest document, then start), and the others
go back to their documents as runs of removed words. Windows that repeat within CHUNK_BYTES of text are settled before
the shuffle: only their first occurrence there travels, so a passage that many documents share reaches its bucket once
per chunk.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null or empty text has none, and a text shorter than a window keeps all.
Rows that share id and text count as one document, so they do not remove each other's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlens.llm.arrays import Block, blocks, gram_hashes, mix, ranges, with_columns, word_hashes, words
from cartlens.llm.frames import schema_with, set_aside
from cartlens.llm.packs import (
    CHUNK_BYTES, Runs, Strings, bucket_count, bucket_runs, keyed, marked, packed, rank_pairs, repeats, row_runs, surveyed,
    text_bytes, with_runs,
)

GROUP = 3
FREQUENT = 256
_NO_RUNS: Runs = tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[assignment]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    rest = width - have
    if rest:
        x = np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def window_starts(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window, and its row."""
    count = np.maximum(np.diff(rows) - size + 1, 0)
    return ranges(rows[:-1], count), np.repeat(np.arange(len(count)), count)


def later_copies(h: np.ndarray, g: np.ndarray, order_key: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller key. h, g: independent hashes."""
    out = np.zeros(len(h), bool)
    if len(h) < 2:
        return out
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    near = np.zeros(len(h), bool)
    near[1:] |= same
    near[:-1] |= same
    order = order[near]  # only windows with a partner
    if len(order) == 0:
        return out
    order = order[np.lexsort((order_key[order], g[order], h[order]))]
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = order_key[order][new][np.cumsum(new) - 1]
    out[order] = order_key[order] != first
    return out


def runs_of(marked: np.ndarray, start: np.ndarray, row: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of maximal stretches of marked windows with consecutive starts in one row (and equal `also`)."""
    at = np.flatnonzero(marked)
    if len(at) == 0:
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (start[at][1:] != start[at][:-1] + 1) | (row[at][1:] != row[at][:-1])
    if also is not None:
        new[1:] |= also[at][1:] != also[at][:-1]
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def minimisers(hashes: np.ndarray, size: int, marks: np.ndarray | None) -> np.ndarray:
    """Minimiser of the window at each word; frequent groups have the top bit."""
    groups = gram_hashes(hashes, GROUP) >> np.uint64(1)
    if marks is not None:
        groups = groups | (marked(groups, marks).astype(np.uint64) << np.uint64(63))
    return sliding_min(groups, size - GROUP + 1)


def count_minimisers(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(key, n) of minimisers that begin several strings within CHUNK_BYTES of text, and the bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        held = total = 0
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                w = words(block)
                at, row = window_starts(w.rows, size)
                if len(at):
                    least = minimisers(word_hashes(block, w), size, None)[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                    heads.append(least[new])
                held += len(block.data)
                total += len(block.data)
                if held >= CHUNK_BYTES and heads:
                    yield repeats(heads)
                    heads, held = [], 0
        if heads:
            yield repeats(heads)
        yield text_bytes(total)

    return docs.select(text_col).mapInArrow(run, "key long, n long")


class Chunk:
    """Windows of consecutive blocks, kept until CHUNK_BYTES of text are there."""

    def __init__(self, size: int, n_buckets: int, marks: np.ndarray) -> None:
        self.size, self.n_buckets, self.marks = size, n_buckets, marks
        self.clear()

    def clear(self) -> None:
        self.bytes, self.n_rows = 0, 0
        self.fields: dict[str, list[np.ndarray]] = {k: [] for k in ("h", "g", "least", "row", "start", "from", "to", "id", "th", "data")}

    def add(self, block: Block, ids: np.ndarray, hashes: np.ndarray) -> None:
        w = words(block)
        at, row = window_starts(w.rows, self.size)
        if len(at):
            a, b = word_hashes(block, w, 0), word_hashes(block, w, 1)
            least = minimisers(a, self.size, self.marks)
            put = self.fields
            put["h"].append(gram_hashes(a, self.size)[at])
            put["g"].append(gram_hashes(b, self.size, 1)[at])
            put["least"].append(least[at])
            put["row"].append(row + self.n_rows)
            put["start"].append(at - w.rows[row])
            put["from"].append(w.start[at] + self.bytes)
            put["to"].append(w.end[at + self.size - 1] + self.bytes)
            put["data"].append(block.data)
            put["id"].append(ids)
            put["th"].append(hashes)
            self.bytes += len(block.data)
            self.n_rows += len(block)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n_rows:
            x = {k: np.concatenate(v) for k, v in self.fields.items()}
            self.clear()
            rank = rank_pairs(x["id"], x["th"])
            later = later_copies(x["h"], x["g"], (rank[x["row"]] << 32) | x["start"])
            a, b = runs_of(later, x["start"], x["row"])
            row = x["row"][a]
            gone: Runs = (x["id"][row], x["th"][row], x["start"][a], x["start"][b] + self.size)
            a, b = runs_of(~later, x["start"], x["row"], x["least"])
            row, lo, hi = x["row"][a], x["from"][a], x["to"][b]
            cut = Strings(x["id"][row], x["th"][row], x["start"][a], lo, x["data"])
            yield from packed(_sliced(cut, lo, hi), (mix(x["least"][a]) % np.uint64(self.n_buckets)).astype(np.int64), self.n_buckets, gone)


class _sliced(Strings):  # noqa: N801
    """Strings that still lie in their documents; take() copies those it is asked for."""

    def __init__(self, s: Strings, lo: np.ndarray, hi: np.ndarray) -> None:
        super().__init__(s.ids, s.hashes, s.place, s.offsets, s.data)
        self.lo, self.hi = lo, hi

    def take(self, index: np.ndarray) -> Strings:
        sizes = self.hi[index] - self.lo[index]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return Strings(self.ids[index], self.hashes[index], self.place[index], offsets, self.data[ranges(self.lo[index], sizes)])


def settle(strings: Strings, size: int) -> Runs:
    """Runs of removed words in one bucket's strings."""
    if len(strings) == 0:
        return _NO_RUNS
    rank = strings.document_rank()
    parts: list[tuple[np.ndarray, ...]] = []
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(strings), [None, pa.py_buffer(strings.offsets.astype(np.int64)), pa.py_buffer(strings.data)])
    for block in blocks(data):
        w = words(block)
        at, row = window_starts(w.rows, size)
        a, b = word_hashes(block, w, 0), word_hashes(block, w, 1)
        start = at - w.rows[row] + strings.place[row + block.first]
        parts.append((gram_hashes(a, size)[at], gram_hashes(b, size, 1)[at], row + block.first, start))
    h, g, row, start = (np.concatenate(p) for p in zip(*parts, strict=True))
    later = later_copies(h, g, (rank[row] << 32) | start)
    a, b = runs_of(later, start, row)
    return strings.ids[row[a]], strings.hashes[row[a]], start[a], start[b] + size


def without_repeats(
    docs: DataFrame,
    size: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept_col: str = "kept_text",
    n_buckets: int | None = None,
) -> DataFrame:
    """Add n_words, n_removed and the kept words joined by one space."""
    docs, restore = set_aside(docs, "_id", "_th", "_runs")
    named = keyed(docs, id_col, text_col)
    marks, n_bytes = surveyed(count_minimisers(docs, size, text_col), FREQUENT)
    n_buckets = n_buckets or bucket_count(docs.sparkSession, n_bytes, 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(size, n_buckets, marks)
        for batch in batches:
            ids, hashes = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            for block in blocks(batch.column(text_col)):
                rows = slice(block.first, block.first + len(block))
                chunk.add(block, ids[rows], hashes[rows])
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.out()
        yield from chunk.out()

    runs = bucket_runs(named.select("_id", "_th", text_col), cut, lambda s: settle(s, size), n_bytes)
    joined = with_runs(named, runs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                own = batch.slice(block.first, len(block))
                w = words(block)
                n = np.diff(w.rows)
                gone, _ = row_runs(own.column("_runs"), n)
                stay = np.flatnonzero(~gone)
                row = w.row_of()[stay]
                # Each kept word with one space behind it, then the last space of each row is cut.
                sizes = w.end[stay] - w.start[stay] + 1
                at = ranges(w.start[stay], sizes)
                ends = np.cumsum(sizes)
                text = np.where(np.arange(len(at)) == np.repeat(ends - 1, sizes), np.uint8(0x20), block.data[np.minimum(at, len(block.data) - 1)]) if len(at) else block.data[:0]
                rows = np.searchsorted(row, np.arange(len(block) + 1))
                edge = np.concatenate([[0], ends])[rows]
                raw = text.tobytes()
                kept = [raw[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                left = np.diff(rows)
                yield with_columns(
                    own,
                    {
                        "n_words": pa.array(n.astype(np.int64)),
                        "n_removed": pa.array((n - left).astype(np.int64)),
                        kept_col: pa.array(kept, pa.binary()).cast(pa.string()),
                    },
                )

    out = schema_with(joined, [("n_words", T.LongType()), ("n_removed", T.LongType()), (kept_col, T.StringType())])
    return restore(joined.mapInArrow(keep, out).drop("_id", "_th", "_runs"))
