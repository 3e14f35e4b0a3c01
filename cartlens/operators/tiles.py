"""Items in tiles, and each user's best unseen items found by bounds of the tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa

from cartlens.operators.vectors import new_file, written

_CHUNK, _TILE = 1024, 1024  # users, about, and items of one product
_GATHER_BYTES = 8 << 20  # of vectors whose scores are worked out at once
_SLAB = 512  # tiles whose bounds are worked out at once
LISTED = pa.schema([("user_idx", pa.int64()), ("item_idx", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Tiles:
    """Items in the order of their tiles. ``low`` are the vectors over the greatest norm, in single precision."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    top: float
    ends: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    longest: np.ndarray

    _last: ClassVar[tuple[list[str], list[Tiles]] | None] = None

    @classmethod
    def opened(cls, paths: list[str]) -> list[Tiles]:
        """Blocks that ``tile_writer`` wrote, the greatest norm first; a worker keeps the last ones it has opened."""
        if cls._last is None or cls._last[0] != paths:
            cls._last = None
            blocks = []
            for path in paths:
                mapped = (np.load(f"{path}.{part}.npy", mmap_mode="r") for part in ("ids", "vectors", "low"))
                with np.load(f"{path}.npz") as rest:
                    blocks.append(cls(*mapped, **{k: rest[k] for k in ("top", "ends", "centres", "radii", "longest")}))
            cls._last = paths, sorted(blocks, key=lambda b: -b.top)
        return cls._last[1]


def _split(y: np.ndarray, norm: np.ndarray) -> list[np.ndarray]:
    """Places of the items, in tiles of neighbours: bands of falling norm, each twice as long as the one before, halved
    along their widest axes."""
    order, at, size, out = np.argsort(-norm, kind="stable"), 0, _TILE, []
    while at < len(order):
        parts = [order[at : at + size]]
        at, size = at + size, 2 * size
        while parts:
            part = parts.pop()
            if len(part) <= _TILE:
                out.append(part)
                continue
            half = len(part) // 2
            by = np.argpartition(y[part, y[part].var(0).argmax()], half)
            parts += [part[by[half:]], part[by[:half]]]
    return out


def tiled(ids: np.ndarray, vectors: np.ndarray) -> Tiles:
    """At least one item, all of finite vectors."""
    y = vectors.astype(np.float64, copy=False)
    norm = np.sqrt((y**2).sum(1))
    parts = _split(y, norm)
    order = np.concatenate(parts)
    ids, y, norm, vectors = ids[order], y[order], norm[order], vectors[order]
    ends = np.cumsum([len(part) for part in parts])
    spans = list(zip(ends - [len(part) for part in parts], ends, strict=True))
    centres = np.array([y[s:e].mean(0) for s, e in spans])
    radii = np.array([np.sqrt(((y[s:e] - centre) ** 2).sum(1).max()) for (s, e), centre in zip(spans, centres, strict=True)])
    longest = np.array([norm[s:e].max() for s, e in spans])
    top = max(longest[0], np.finfo(np.float64).tiny)
    return Tiles(ids, vectors, (y / top).astype(np.float32), top, ends, centres, radii, longest)


def matrix_of(table: pa.Table, column: str) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = np.concatenate([chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table.column(column).chunks] or [np.zeros(0)])
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)


def with_norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the norm of ``features``, infinite where a vector is not finite."""
    for batch in batches:
        x = matrix_of(pa.Table.from_batches([batch]), "features").astype(np.float64)
        norm = np.sqrt((x**2).sum(1)) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isfinite(norm), norm, np.inf))], [*batch.schema.names, "norm"])


def tile_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's items (idx, features) as one block to files of one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                ids.append(table.column("idx").to_numpy())
                vectors.append(matrix_of(table, "features"))
        if ids:
            ids, vectors = np.concatenate(ids), np.concatenate(vectors)
            finite = np.isfinite(vectors).all(1)
            if finite.any():
                block, path = tiled(ids[finite], vectors[finite]), new_file(folder)
                for part in ("ids", "vectors", "low"):
                    np.save(f"{path}.{part}.npy", getattr(block, part))
                np.savez(f"{path}.npz", **{k: getattr(block, k) for k in ("top", "ends", "centres", "radii", "longest")})
                yield written(path, len(block.ids))

    return run


def _slabs(blocks: list[Tiles]) -> Iterator[tuple[list[tuple[Tiles, int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """The tiles of some blocks at a time, with their centres, radii and greatest norms."""
    held: list[Tiles] = []
    for k, block in enumerate(blocks):
        held.append(block)
        if k + 1 < len(blocks) and sum(len(b.ends) for b in [*held, blocks[k + 1]]) <= _SLAB:
            continue
        spans = [(b, s, e) for b in held for s, e in zip([0, *b.ends[:-1]], b.ends)]
        yield spans, *(np.concatenate([getattr(b, name) for b in held]) for name in ("centres", "radii", "longest"))
        held = []


def _cut(u: np.ndarray, i: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of each user's n best, in order; equal scores in the order of the index."""
    order = np.lexsort((i, -score, u))
    head = np.flatnonzero(np.append(True, np.diff(u[order]) != 0)) if len(u) else np.zeros(0, np.int64)
    return order[np.arange(len(u)) - np.repeat(head, np.diff(np.append(head, len(u)))) < n]


def best_unseen(
    blocks: list[Tiles], users: np.ndarray, x: np.ndarray, floors: np.ndarray | None, seen: tuple[np.ndarray, np.ndarray], n: int
) -> pa.Table:
    """Each user's n best items that are not among the seen pairs; equal scores in the order of the index.

    Items go in tiles, users in chunks. A chunk keeps its n best so far and their last score, the floor, which starts from
    the one the users came with. A score is at most the product of the norms, and at most that of the tile's centre plus
    the user's norm times the tile's radius; a user takes part in a tile only if both reach the floor, and the tiles that
    reach furthest come first. Products of vectors scaled to 1 in single precision, with room for their rounding, find
    what may reach it; the score itself is worked out in double precision for those alone.
    """
    finite = np.isfinite(x).all(1)
    users, x = users[finite], x[finite].astype(np.float64, copy=False)
    floors = np.full(len(users), -np.inf) if floors is None else floors[finite]
    if not len(users) or not blocks:
        return LISTED.empty_table()
    order = np.argsort(users)
    place = np.minimum(np.searchsorted(users, seen[0], sorter=order), len(users) - 1)
    known = users[order[place]] == seen[0]
    place, item = place[known], seen[1][known]
    n_seen = np.bincount(place, minlength=len(users))
    by_seen = np.argsort(n_seen, kind="stable")  # users who have seen much share a chunk
    order, n_seen, back = order[by_seen], n_seen[by_seen], np.argsort(by_seen)
    users, x, floors = users[order], x[order], floors[order]
    base = max(int(max(b.ids.max() for b in blocks)), int(item.max(initial=0))) + 1
    seen_code = np.unique(back[place] * base + item)
    width = x.shape[1]
    slack, gather, tiny = (width + 8) * 2.0**-22, max(1, _GATHER_BYTES // (8 * width)), np.finfo(np.float64).tiny
    x_norm = np.sqrt((x**2).sum(1))
    unit = np.where(x_norm > 0, x_norm, 1.0)
    x32 = (x / unit[:, None]).astype(np.float32)
    slabs, out = list(_slabs(blocks)), []
    for mine in np.array_split(np.arange(len(users)), max(1, round(len(users) / _CHUNK))):
        floor = floors[mine].copy()
        last = np.full(len(mine), np.iinfo(np.int64).max)  # index of the item at the floor
        u, i, score, late = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        for spans, centres, radii, longest in slabs:
            most = x_norm[mine, None] * longest
            reach = np.minimum(most, x[mine] @ centres.T + x_norm[mine, None] * radii) + 1e-9 * most
            furthest = np.argsort(-(reach / unit[mine, None]).mean(0), kind="stable")
            for t in furthest[(reach >= floor[:, None]).any(0)[furthest]]:
                block, s, e = spans[t]
                near = np.flatnonzero(reach[:, t] >= floor)
                if not len(near):
                    continue
                product = x32[mine[near]] @ block.low[s:e].T
                bound = floor[near] / np.maximum(unit[mine[near]] * block.top, tiny) - slack
                free = np.flatnonzero(np.isneginf(bound))
                if len(free):
                    k = n + int(n_seen[mine[near[free]]].max())
                    if k < product.shape[1]:
                        bound[free] = np.partition(product[free], -k, axis=1)[:, -k] - 2 * slack
                bound32 = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
                a, b = np.nonzero(product >= bound32[:, None])
                a, b = near[a], b + s
                value = [np.einsum("ij,ij->i", x[mine[a[k : k + gather]]], block.vectors[b[k : k + gather]].astype(np.float64, copy=False)) for k in range(0, len(a), gather)]
                value, ids = np.concatenate(value or [score[:0]]), block.ids[b]
                fits = np.flatnonzero(np.isfinite(value) & ((value > floor[a]) | ((value == floor[a]) & (ids <= last[a]))))
                if len(seen_code):
                    code = mine[a[fits]] * base + ids[fits]
                    fits = fits[seen_code[np.minimum(np.searchsorted(seen_code, code), len(seen_code) - 1)] != code]
                u, i, score, late = np.concatenate([u, a[fits]]), np.concatenate([i, ids[fits]]), np.concatenate([score, value[fits]]), late + len(fits)
                if 4 * late < n * len(mine):
                    continue
                late = 0
                best = _cut(u, i, score, n)
                u, i, score = u[best], i[best], score[best]
                full = np.flatnonzero(np.bincount(u, minlength=len(mine)) == n)
                end = np.searchsorted(u, full, "right") - 1
                floor[full], last[full] = score[end], i[end]
        best = _cut(u, i, score, n)
        u, i, score = u[best], i[best], score[best]
        out.append(pa.table([pa.array(users[mine[u]]), pa.array(i), pa.array(score)], schema=LISTED))
    return pa.concat_tables(out)


def best_of_files(n: int, paths: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The lists of a group of users (user_idx, features) with the pairs they have seen, from all written blocks of items."""

    def run(people: pa.Table, seen: pa.Table) -> pa.Table:
        pairs = seen.column("user_idx").to_numpy(), seen.column("item_idx").to_numpy()
        return best_unseen(Tiles.opened(paths), people.column("user_idx").to_numpy(), matrix_of(people, "features"), None, pairs, n)

    return run
