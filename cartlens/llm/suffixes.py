"""Removal of repeated byte strings by hash-compared suffix sorting.

Every string of `size` bytes has a least anchor: the smallest rolling hash of its groups of ANCHOR bytes. Consecutive
strings with the same least anchor leave their document as one piece, for the bucket of that anchor; equal strings have
equal anchors, so a bucket sees every copy. Frequent anchors, those that begin FREQUENT pieces or more by counts over all
documents, come behind all others, so the strings on the rim of a passage that very many documents share go by the bytes
around it to many buckets. A bucket first merges identical pieces: their strings all repeat. In the
rest it sorts, anchor by anchor, the suffixes that begin at the anchors, and likewise the reversed prefixes that end
there. The mergesort compares two suffixes by the length of their common beginning, found by binary search over prefix
polynomial hashes, so a comparison takes a logarithmic number of steps. The extensions that neighbours in the two
orders share are then compared byte by byte; if a hash collision shows, the sort is done again with another base.
Strings at offset o before an anchor are equal exactly if the suffixes share size - o bytes and the prefixes o; for each
o, pairs of classes that occur more than once are the repeated strings.

Pieces that are identical within CHUNK_BYTES of text are settled before the shuffle and travel once. Null and empty texts
have no bytes; texts shorter than a string keep all. Rows that share id and text count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlens.llm.arrays import Block, blocks, mix, powers, prefix_hash, ranges, span_hash, with_columns
from cartlens.llm.frames import schema_with, set_aside
from cartlens.llm.packs import (
    CHUNK_BYTES, Runs, Strings, bucket_count, bucket_runs, keyed, marked, packed, rank_pairs, repeats, row_runs, surveyed,
    text_bytes, with_runs,
)
from cartlens.llm.windows import _NO_RUNS, sliding_min, window_starts

ANCHOR = 32
FREQUENT = 256

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, by doubling the width; 32 bits, well mixed."""
    h = _GEAR[data]
    width = 1
    while width < ANCHOR:
        h = (h[:-width] << np.uint32(width)) + h[width:] if len(h) > width else h[:0]
        width *= 2
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def anchors(data: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
    """Order of the anchor at each place; frequent ones have the top bit."""
    h = anchor_hashes(data) >> np.uint32(1)
    return h if marks is None else h | (marked(h, marks).astype(np.uint32) << np.uint32(31))


def count_anchors(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(key, n) of least anchors of several pieces within CHUNK_BYTES of text, and the bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        held = total = 0
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                at, row = window_starts(block.offsets, size)
                if len(at):
                    least = sliding_min(anchors(block.data, None), size - ANCHOR + 1)[at]
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


class Comparer:
    """Longest common beginnings of suffixes, up to `cap` bytes, by prefix hashes."""

    def __init__(self, data: np.ndarray, cap: int, which: int) -> None:
        self.data, self.cap, self.which = data, cap, which
        self.h = prefix_hash(data, which)
        self.inverse = powers(len(self.h), which, True)

    def common(self, p: np.ndarray, q: np.ndarray, p_end: np.ndarray, q_end: np.ndarray) -> np.ndarray:
        most = np.minimum(np.minimum(p_end - p, q_end - q), self.cap)
        low = np.zeros(len(p), np.int64)
        high = most
        for _ in range(int(self.cap).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.h[p + mid] - self.h[p]) * self.inverse[p] == (self.h[q + mid] - self.h[q]) * self.inverse[q]
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def below(self, p: np.ndarray, q: np.ndarray, p_end: np.ndarray, q_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix p sorts before q, and whether they are equal up to the cap."""
        n = self.common(p, q, p_end, q_end)
        p_left, q_left = p_end - p, q_end - q
        equal = (n == self.cap) | ((n == p_left) & (n == q_left))
        p_out, q_out = n == p_left, n == q_left
        last = len(self.data) - 1
        smaller = np.where(p_out, ~q_out, ~q_out & (self.data[np.minimum(p + n, last)] < self.data[np.minimum(q + n, last)]))
        return smaller & ~equal, equal


def merge_sort(c: Comparer, at: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes at..end within each group; group: ascending, equal for the members of a group.

    Bottom-up: in every round all runs of all groups merge with their neighbours at once; an element's new place is
    its own offset plus the number of smaller ones in the other run, found by binary search.
    """
    n = len(at)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, n))
    start, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
    order = np.arange(n)
    width = 1
    while n and width < sizes.max():
        active = np.flatnonzero(size > width)
        offset = active - start[active]
        run = offset // width
        left = run % 2 == 0
        other = start[active] + np.where(left, run + 1, run - 1) * width
        stop = np.minimum(other + width, start[active] + size[active])
        low, high = np.minimum(other, stop), stop
        begin = low.copy()
        mine = order[active]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            x, y = order[mid], mine[open_]
            smaller, equal = c.below(at[x], at[y], end[x], end[y])
            before = smaller | (equal & ~left[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        place = np.where(left, active, active - width) + (low - begin)
        new = order.copy()
        new[place] = mine
        order = new
        width *= 2
    return order


def neighbours(c: Comparer, at: np.ndarray, end: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common beginning of each sorted suffix with the one before it in its group, else -1."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        x, y = order[:-1], order[1:]
        out[1:] = np.where(group[x] == group[y], c.common(at[x], at[y], end[x], end[y]), -1)
    return out


def verified(data: np.ndarray, at: np.ndarray, end: np.ndarray, order: np.ndarray, shared: np.ndarray, cap: int) -> bool:
    """Whether every pair of neighbours has exactly the common beginning that the hashes say."""
    pairs = np.flatnonzero(shared >= 0)
    for i in range(0, len(pairs), 4096):
        k = pairs[i : i + 4096]
        p, q, n = at[order[k - 1]], at[order[k]], shared[k]
        if not np.array_equal(data[ranges(p, n)], data[ranges(q, n)]):
            return False
        more = (n < cap) & (p + n < end[order[k - 1]]) & (q + n < end[order[k]])
        if (data[(p + n)[more]] == data[(q + n)[more]]).any():
            return False
    return True


def sorted_suffixes(data: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the suffixes sorted within their groups, and what each shares with the one before it."""
    for which in (0, 1):
        c = Comparer(data, cap, which)
        order = merge_sort(c, at, end, group)
        shared = neighbours(c, at, end, group, order)
        if verified(data, at, end, order, shared, cap):
            return order, shared
    raise ArithmeticError("both hash bases collide on these texts")


def repeated_starts(s: Strings, size: int, marks: np.ndarray | None = None) -> np.ndarray:
    """Marks of the bytes of s.data at which a string begins that also begins elsewhere in s.

    The pieces differ from one another. Anchors: all places in a piece with the piece's least anchor hash.
    """
    out = np.zeros(len(s.data), bool)
    if len(s) == 0:
        return out
    h = anchors(s.data, marks)
    row = np.repeat(np.arange(len(s)), np.diff(s.offsets))[: len(h)]
    inside = np.arange(len(h)) + ANCHOR <= s.offsets[1:][row]
    # The least anchor of a piece is that of its first string.
    width = size - ANCHOR + 1
    least = sliding_min(h, width)[s.offsets[:-1]]
    at = np.flatnonzero(inside & (h == least[row]))
    key = h[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    near = np.zeros(len(at), bool)
    near[1:] |= same
    near[:-1] |= same
    at, key = at[near], key[near]
    if len(at) == 0:
        return out
    # Only pieces with such an anchor go on.
    used = np.unique(row[at])
    shift = np.zeros(len(s), np.int64)
    part = s.take(used)
    shift[used] = part.offsets[:-1] - s.offsets[:-1][used]
    piece = row[at]
    local = at + shift[piece]
    low, high = s.offsets[:-1][piece] + shift[piece], s.offsets[1:][piece] + shift[piece]
    n = len(part.data)
    _, group = np.unique(key, return_inverse=True)
    ahead, ahead_shared = sorted_suffixes(part.data, local, high, group, size)
    back, back_shared = sorted_suffixes(part.data[::-1].copy(), n - local, n - low, group, size)
    total = len(at)

    def best(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        most = np.empty(total, np.int64)
        most[order] = np.maximum(shared, np.append(shared[1:], -1))
        return most

    far_ahead, far_back = best(ahead, ahead_shared), best(back, back_shared)
    live = far_ahead + far_back >= size
    if not live.any():
        return out
    place_a, place_b = np.empty(total, np.int64), np.empty(total, np.int64)
    place_a[ahead], place_b[back] = np.arange(total), np.arange(total)
    lo, hi = np.maximum(size - far_ahead, 0), np.minimum(far_back, size - ANCHOR)
    by_low = np.flatnonzero(live & (lo <= hi))
    if len(by_low) == 0:
        return out
    for o in range(int(lo[by_low].min()), int(hi[by_low].max()) + 1):
        some = by_low[(lo[by_low] <= o) & (o <= hi[by_low])]
        if len(some) < 2:
            continue
        class_a = np.cumsum(ahead_shared < size - o)[place_a[some]]
        class_b = np.cumsum(back_shared < o)[place_b[some]]
        code = class_a * np.int64(total + 1) + class_b
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        hit = np.zeros(len(some), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out[at[some[hit]] - o] = True
    return out


def covered_runs(starts: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): stretches of bytes covered by the strings that begin at the marks; strings stay in their row."""
    at = np.flatnonzero(starts)
    if len(at) == 0:
        return at, at, at
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (np.diff(at) > size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[first], at[first] - offsets[row[first]], at[last] - offsets[row[first]] + size


def piece_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = span_hash(prefix_hash(data, 0), lo, hi, 0)
    b = span_hash(prefix_hash(data, 1), lo, hi, 1)
    return mix(a) ^ (hi - lo).astype(np.uint64), mix(b)


def identical(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its kind, has a copy) for pieces data[lo:hi] with hashes a and b; copies are compared byte by byte."""
    n = len(lo)
    first, twin = np.ones(n, bool), np.zeros(n, bool)
    order = np.argsort(a)
    same = a[order][1:] == a[order][:-1]
    near = np.zeros(n, bool)
    near[1:] |= same
    near[:-1] |= same
    order = order[near]
    if len(order) == 0:
        return first, twin
    order = order[np.lexsort((order, b[order], a[order]))]
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    head = order[new][np.cumsum(new) - 1]
    for i in range(0, len(order), 4096):
        x, y = head[i : i + 4096], order[i : i + 4096]
        if not np.array_equal(data[ranges(lo[x], hi[x] - lo[x])], data[ranges(lo[y], hi[y] - lo[y])]):
            raise ArithmeticError("two pieces share both hashes")
    first[order] = new
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    twin[order] = np.repeat(sizes > 1, sizes)
    return first, twin


def settle(strings: Strings, size: int, marks: np.ndarray | None = None) -> Runs:
    """Runs of removed bytes in one bucket's pieces."""
    if len(strings) == 0:
        return _NO_RUNS
    lo, hi = strings.offsets[:-1], strings.offsets[1:]
    parts = []
    for i in range(0, len(strings), 1024):  # hash tables stay small
        a, b = int(lo[i]), int(hi[min(i + 1024, len(strings)) - 1])
        parts.append(piece_hashes(strings.data[a:b], lo[i : i + 1024] - a, hi[i : i + 1024] - a))
    a, b = (np.concatenate(p) for p in zip(*parts, strict=True))
    # The same piece of the same document counts once: rows that repeat id and text are one document.
    own = mix(strings.ids.view(np.uint64)) ^ mix(strings.hashes.view(np.uint64) + np.uint64(1)) ^ mix(strings.place.view(np.uint64) + np.uint64(2))
    _, once = np.unique(own, return_index=True)
    if len(once) < len(strings):
        once.sort()
        return settle(strings.take(once), size, marks)
    first, twin = identical(strings.data, lo, hi, a, b)
    whole = np.flatnonzero(twin)
    kinds = np.flatnonzero(first & ~twin)
    # A piece with copies stays in the sort once: others may hold some of its strings.
    heads = np.flatnonzero(first)
    rest = strings.take(heads)
    row, x, y = covered_runs(repeated_starts(rest, size, marks), rest.offsets, size)
    single = np.isin(heads[row], kinds)
    row, x, y = heads[row[single]], x[single], y[single]
    place = strings.place
    return (
        np.concatenate([strings.ids[whole], strings.ids[row]]),
        np.concatenate([strings.hashes[whole], strings.hashes[row]]),
        np.concatenate([place[whole], place[row] + x]),
        np.concatenate([place[whole] + (hi - lo)[whole], place[row] + y]),
    )


class Chunk:
    """Pieces of consecutive blocks, kept until CHUNK_BYTES of text are there."""

    def __init__(self, size: int, n_buckets: int, marks: np.ndarray) -> None:
        self.size, self.n_buckets, self.marks = size, n_buckets, marks
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.fields: dict[str, list[np.ndarray]] = {k: [] for k in ("id", "th", "place", "lo", "hi", "a", "b", "least", "data")}

    def add(self, block: Block, ids: np.ndarray, hashes: np.ndarray) -> None:
        at, row = window_starts(block.offsets, self.size)
        if len(at) == 0:
            return
        least = sliding_min(anchors(block.data, self.marks), self.size - ANCHOR + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        lo, hi = at[first], at[np.append(first[1:], len(at)) - 1] + self.size
        row = row[first]
        a, b = piece_hashes(block.data, lo, hi)
        for k, v in (("id", ids[row]), ("th", hashes[row]), ("place", lo - block.offsets[row]), ("lo", lo + self.bytes),
                     ("hi", hi + self.bytes), ("a", a), ("b", b), ("least", least[first]), ("data", block.data)):
            self.fields[k].append(v)
        self.bytes += len(block.data)

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.bytes:
            return
        x = {k: np.concatenate(v) for k, v in self.fields.items()}
        self.clear()
        document = rank_pairs(x["id"], x["th"])
        _, once = np.unique((document << 40) + x["place"], return_index=True)
        x |= {k: v[once] for k, v in x.items() if k != "data"}
        first, twin = identical(x["data"], x["lo"], x["hi"], x["a"], x["b"])
        w = np.flatnonzero(twin)
        gone: Runs = (x["id"][w], x["th"][w], x["place"][w], x["place"][w] + x["hi"][w] - x["lo"][w])
        cut = Pieces(x["id"], x["th"], x["place"], x["lo"], x["data"])
        cut.hi = x["hi"]
        bucket = np.where(first, (mix(x["least"].astype(np.uint64)) % np.uint64(self.n_buckets)).astype(np.int64), -1)
        yield from packed(cut, bucket, self.n_buckets, gone)


class Pieces(Strings):
    """Pieces that still lie in their documents, offsets their beginnings; take() copies those it is asked for."""

    hi: np.ndarray

    def take(self, index: np.ndarray) -> Strings:
        sizes = self.hi[index] - self.offsets[index]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return Strings(self.ids[index], self.hashes[index], self.place[index], offsets, self.data[ranges(self.offsets[index], sizes)])


def without_repeats(
    docs: DataFrame,
    size: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept_col: str = "kept_bytes",
    n_buckets: int | None = None,
) -> DataFrame:
    """Add n_bytes, n_removed, n_spans (maximal removed runs) and the remaining bytes."""
    docs, restore = set_aside(docs, "_id", "_th", "_runs")
    named = keyed(docs, id_col, text_col)
    marks, n_bytes = surveyed(count_anchors(docs, size, text_col), FREQUENT)
    n_buckets = n_buckets or bucket_count(docs.sparkSession, n_bytes, 4)

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

    runs = bucket_runs(named.select("_id", "_th", text_col), cut, lambda s: settle(s, size, marks), n_bytes)
    joined = with_runs(named, runs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                own = batch.slice(block.first, len(block))
                n = np.diff(block.offsets)
                gone, head = row_runs(own.column("_runs"), n)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[block.offsets])
                spans = np.diff(np.concatenate([[0], np.cumsum(head)])[block.offsets])
                raw = block.data[~gone].tobytes()
                edge = np.concatenate([[0], np.cumsum(n - removed)]).tolist()
                yield with_columns(
                    own,
                    {
                        "n_bytes": pa.array(n.astype(np.int64)),
                        "n_removed": pa.array(removed.astype(np.int64)),
                        "n_spans": pa.array(spans.astype(np.int64)),
                        kept_col: pa.array([raw[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                    },
                )

    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), (kept_col, T.BinaryType())]
    return restore(joined.mapInArrow(keep, schema_with(joined, added)).drop("_id", "_th", "_runs"))
