"""Implicit-feedback ALS by blocks of ratings, and exact top-N by products of factor blocks.

The objective is the sum over all user-item pairs of c (p - x.y)^2 plus ``regularization`` times the squared norms, with
c = alpha * |r| for observed pairs, 1 for the others, and p = 1 where r > 0. With Y the other side's factors, a row solves
(Y'Y + regularization I + sum (c - 1) y y') x = sum c y: one matrix shared by all rows, and a correction per rating.
With that matrix as L L', the vectors z = L^-1 y and the row u = L' x, it is (I + sum (c - 1) z z') u = sum c z, so the
shared matrix is dealt with once per vector, before the vector is sent, and not once in every block that needs it.

Ratings are dealt once for each side to blocks of whole rows. A half step sends every factor vector once to each block
that needs it, not once per rating, and the vectors for one block together. The first factors come from a hash, so the
blocks work them out themselves. A row with more ratings than a block takes is split over blocks; their corrections are
added in two levels before it is solved. What a task holds is a block's ratings, the vectors they need, and matrices of
factors x factors. The driver holds at most 64 of those.

Where the shared folder is one that Python workers can open, nothing is sent: a half step lays the scaled vectors down in
plain files once, and each block takes those it needs from there. Elsewhere, or where a side is too long for that, vectors
are sent; if they are many, the blocks take their turns, and what is sent to some of them leaves the disk before the next
are served.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.config import AlsConfig
from cartlens.functions.joins import join_small
from cartlens.functions.ranking import top_per_group
from cartlens.operators.matrix import UserItemMatrix
from cartlens.operators.tiles import _CHUNK, LISTED, best_of_files, best_unseen, tile_writer, tiled, with_norm
from cartlens.operators.vectors import WRITTEN, Vectors, flat, writer
from cartlens.session import local_stages, remove, scratch, ship_package, stage, stage_at

_SPREAD = 64  # partial sums of one matrix, and so the matrices the driver adds up
_CHUNK_BYTES = 32 << 20  # of normal matrices solved at once, or of vectors sent at once
_SOLVED, _GRAM, _PART = 0, 1, 2
_BLOCKS_PER_CORE = 4
#: Vectors of one turn of a half step in bytes, and turns at most: each reads and deals the factors again. Where Python
#: workers can open the shared folder, sides of so many bytes in all are not sent but read from files.
_TURN_BYTES, _TURNS = 512 << 20, 4
_STEP = "kind int, idx long, spread int, data binary"
_SENT = pa.schema([("to", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])
_STEP_ARROW = pa.schema([("kind", pa.int32()), ("idx", pa.int64()), ("spread", pa.int32()), ("data", pa.binary())])

#: Users and items of one block at most, and bytes of its factors or lists.
USER_BLOCK, ITEM_BLOCK, BLOCK_BYTES = 1 << 18, 1 << 18, 32 << 20
_GROUP_BYTES = 16 << 20  # of a group's factors or lists where the items are read from files
#: Items of greatest norm that give users their first floors.
HEAD = 8192
_TASKS = 48  # block products at least, four for each core if those are more, or as many as the bytes of the blocks ask for
_BLOB = pa.schema([("side", pa.string()), ("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("floors", pa.binary())])


@dataclass(frozen=True)
class FactorModel:
    user_factors: DataFrame  # idx, features
    item_factors: DataFrame


def _rows(kind: int, idx: np.ndarray, data: list[bytes], spread: int = 0) -> pa.RecordBatch:
    n = len(idx)
    arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(idx.astype(np.int64)), pa.array(np.full(n, spread, np.int32)), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, schema=_STEP_ARROW)


def _packed(vectors: np.ndarray, precision: str) -> list[bytes]:
    return [v.tobytes() for v in vectors.astype(precision)]


def _unpacked(column: pa.ChunkedArray | pa.Array, dtype: str, width: int) -> np.ndarray:
    return flat(column, dtype).reshape(-1, width).astype(np.float64, copy=False)


def _start(idx: np.ndarray, config: AlsConfig) -> np.ndarray:
    """Small uniform factors from a counter-based hash of seed, index and position, the same on any cluster."""
    start = np.uint64(config.seed * 0x9E3779B97F4A7C15 % 2**64)
    x = idx.astype(np.uint64)[:, None] * np.uint64(config.factors) + np.arange(config.factors, dtype=np.uint64) + start
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)) * 2.0**-53 * 0.01).astype(config.precision).astype(np.float64)


def _initial(config: AlsConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first factors of one side, and their Gram matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((config.factors, config.factors))
        for batch in batches:
            idx = batch.column(0).to_numpy()
            vectors = _start(idx, config)
            gram += vectors.T @ vectors
            yield _rows(_SOLVED, idx, _packed(vectors, config.precision))
        yield _rows(_GRAM, np.zeros(1), [gram.tobytes()])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block: its rows, the end of each, and for every rating the place of its vector among the needed."""
    row, col, rating = (table.column(c).to_numpy() for c in ("row", "col", "rating"))
    rows, place = np.unique(row, return_inverse=True)
    needs, at = np.unique(col, return_inverse=True)
    order = np.argsort(place * len(needs) + at, kind="stable")
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (rows, np.cumsum(np.bincount(place)), at[order].astype(np.int32), rating[order], needs)]
    return pa.table([table.column("block")[:1], *binary], names=["block", "rows", "ends", "at", "ratings", "needs"])


def _blocks(pairs: DataFrame, row: str, col: str, total: int, config: AlsConfig) -> tuple[DataFrame, int, bool]:
    """The side's packed blocks, their number, and whether rows are split. Split rows' blocks have negative numbers.

    No more blocks than the cores need, as a vector is sent once for each that has a rating of it.
    """
    limit = max(1, config.block_mb * (1 << 20) // (8 * config.factors))
    spark = pairs.sparkSession
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), _BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)
    n_blocks = max(wanted, -(-total // limit))
    sides = pairs.select(F.col(row).alias("row"), F.col(col).alias("col"), "rating")
    sizes = sides.groupBy("row").agg(F.count(F.lit(1)).alias("_n"))
    hot = stage(sizes.filter(F.col("_n") > limit).select("row", F.ceil(F.col("_n") / limit).alias("_parts")), "split-rows")
    split = not hot.isEmpty()
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks))
    if split:
        part = F.pmod(F.xxhash64("col"), F.col("_parts"))
        own = -F.shiftrightunsigned(F.xxhash64("row", part), 1) - 1
        sides = join_small(sides, hot, ["row"], ["col"], "left")
        block = F.when(F.col("_parts").isNull(), block).otherwise(own)
    dealt = sides.select(block.alias("block"), "row", "col", "rating")
    schema = "block long, rows binary, ends binary, at binary, ratings binary, needs binary"
    return stage(dealt.groupBy("block").applyInArrow(_pack, schema), f"blocks-{row}"), n_blocks, split


def _solved(base: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(base, right[..., None])[..., 0]


def _scaling(gram: np.ndarray, config: AlsConfig) -> tuple[np.ndarray | None, np.ndarray]:
    """L^-1 for L L' = Y'Y + regularization I, and the shared matrix that is left in terms of L^-1 y: the identity.

    Without regularization that matrix may have no such root: then None, and the matrix itself."""
    base = gram + config.regularization * np.eye(config.factors)
    if config.regularization > 0:
        try:
            return np.linalg.inv(np.linalg.cholesky(base)), np.eye(config.factors)
        except np.linalg.LinAlgError:
            pass
    return None, base


def _scaled(vectors: np.ndarray, inverse: np.ndarray | None) -> np.ndarray:
    return vectors if inverse is None else vectors @ inverse.T


def _unscaled(found: np.ndarray, inverse: np.ndarray | None) -> np.ndarray:
    return found if inverse is None else found @ inverse


def _in_turn(blocks: DataFrame, turn: int, turns: int) -> DataFrame:
    return blocks.filter(F.pmod("block", F.lit(turns)) == turn) if turns > 1 else blocks


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, idx) for every vector that a block needs."""
    for batch in batches:
        for block, needs in zip(batch.column("block"), batch.column("needs"), strict=True):
            idx = pa.array(np.frombuffer(needs.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), block.as_py())), idx], ["block", "idx"])


def _routes(blocks: DataFrame, row: str, turns: int) -> list[DataFrame]:
    """(idx, to) for every turn: its blocks that need a vector, at most all of them."""
    out = []
    for turn in range(turns):
        needs = _in_turn(blocks, turn, turns).select("block", "needs").mapInArrow(_needed, "block long, idx long")
        out.append(stage(needs.groupBy("idx").agg(F.collect_list("block").alias("to")), f"routes-{row}"))
    return out


def _sent(inverse: np.ndarray | None, config: AlsConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors (idx, to, data), each scaled once, as rows of many vectors for one block."""
    most = max(1, _CHUNK_BYTES // (8 * config.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, counts = batch.column("idx").to_numpy(), pc.list_value_length(batch.column("to")).to_numpy()
            part = np.cumsum(counts) // most
            for start in np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(idx) else []:
                end = np.searchsorted(part, part[start], "right")
                here = batch.slice(start, end - start)
                vectors = _scaled(_unpacked(here.column("data"), config.precision, config.factors), inverse).astype(config.precision)
                to = here.column("to").flatten().to_numpy()
                order = np.argsort(to, kind="stable")
                source = np.repeat(np.arange(end - start), counts[start:end])[order]
                blocks, first = np.unique(to[order], return_index=True)
                runs = list(zip(first, np.append(first[1:], len(to)), strict=True))
                ids, data = idx[start:end][source], vectors[source]
                columns = [blocks, [ids[a:b].tobytes() for a, b in runs], [data[a:b].tobytes() for a, b in runs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)

    return run


def _solve_block(block: dict, other: np.ndarray, scaling: tuple[np.ndarray | None, np.ndarray], config: AlsConfig) -> list[pa.RecordBatch]:
    """Solve the rows of a block, or give the partial sums of split ones, from the scaled vectors in order of index.

    Rows of equal length are worked out together. A row of n < f ratings with scaled vectors Z, corrections
    D = diag(c - 1) and targets t is Z' applied to the s of (I + D Z Z') s = t: a system of n, not f.
    """
    f, (inverse, rest) = config.factors, scaling
    number = block["block"]
    kinds = {"rows": np.int64, "ends": np.int64, "at": np.int32, "ratings": np.float64}
    rows, ends, at, ratings = (np.frombuffer(block[c], kind) for c, kind in kinds.items())
    weight = config.alpha * np.abs(ratings)
    target = np.where(ratings > 0, weight, 0.0)
    starts = np.concatenate([[0], ends[:-1]])
    spread, out, total = number % _SPREAD, [], np.zeros((f, f))
    counts = ends - starts
    whole = number >= 0
    short = whole & (inverse is not None) & (counts < f)
    for n in np.unique(counts).tolist():
        same = np.flatnonzero(counts == n)
        chunk = max(1, _CHUNK_BYTES // (8 * (2 * n * f + max(n * n, f * f))))
        for i in range(0, len(same), chunk):
            here = same[i : i + chunk]
            mine = starts[here][:, None] + np.arange(n)
            v, d, t = other[at[mine]], weight[mine][..., None] - 1.0, target[mine]
            if short[here[0]]:
                share = _solved(np.eye(n) + d * np.matmul(v, v.transpose(0, 2, 1)), t)
                found = np.matmul(share[:, None], v)[:, 0]
            else:
                left, right = np.matmul((v * d).transpose(0, 2, 1), v), np.matmul(t[:, None], v)[:, 0]
                if not whole:
                    sums = [x.tobytes() + y.tobytes() for x, y in zip(left, right, strict=True)]
                    out.append(_rows(_PART, rows[here], sums, spread))
                    continue
                found = _solved(left + rest, right)
            found = _unscaled(found, inverse).astype(config.precision).astype(np.float64)
            total += found.T @ found
            out.append(_rows(_SOLVED, rows[here], _packed(found, config.precision)))
    if whole:
        out.append(_rows(_GRAM, np.array([number]), [total.tobytes()], spread))
    return out


def _own_half_step(
    files: list[tuple[str, int]], scaling: tuple[np.ndarray | None, np.ndarray], config: AlsConfig
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Solve blocks that take the scaled vectors they need from files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vectors = Vectors.opened(files, config.factors, config.precision)
                other = vectors.take(np.frombuffer(batch.column("needs")[k].as_py(), np.int64)).astype(np.float64, copy=False)
                yield from _solve_block(batch.drop_columns("needs").slice(k, 1).to_pylist()[0], other, scaling, config)

    return run


def _half_step(scaling: tuple[np.ndarray | None, np.ndarray], config: AlsConfig) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, vectors: pa.Table) -> pa.Table:
        if not block.num_rows or not vectors.num_rows:
            return _STEP_ARROW.empty_table()
        ids = np.frombuffer(b"".join(vectors.column("ids").to_pylist()), np.int64)
        other = _unpacked(vectors.column("data"), config.precision, config.factors)[np.argsort(ids)]
        return pa.Table.from_batches(_solve_block(block.to_pylist()[0], other, scaling, config))

    return run


def _first_half_step(scaling: tuple[np.ndarray | None, np.ndarray], config: AlsConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for blocks whose vectors are the first factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                needs = np.frombuffer(batch.column("needs")[k].as_py(), np.int64)
                other = _scaled(_start(needs, config), scaling[0]).astype(config.precision).astype(np.float64)
                yield from _solve_block(batch.drop_columns("needs").slice(k, 1).to_pylist()[0], other, scaling, config)

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of the group's matrices, as a row like its first."""
    total: np.ndarray | int = 0
    for data in table.column("data"):
        total = total + np.frombuffer(data.as_py(), np.float64)
    return table.slice(0, 1).set_column(3, "data", pa.array([total.tobytes()], pa.binary()))


def _joined(scaling: tuple[np.ndarray | None, np.ndarray], config: AlsConfig) -> Callable[[pa.Table], pa.Table]:
    """Add up the parts of a split row and solve it."""
    f, (inverse, rest) = config.factors, scaling

    def run(table: pa.Table) -> pa.Table:
        total = np.frombuffer(_added(table).column("data")[0].as_py(), np.float64)
        x = _solved((total[: f * f].reshape(f, f) + rest)[None], total[None, f * f :])
        x = _unscaled(x, inverse).astype(config.precision).astype(np.float64)
        idx = np.array([table.column("idx")[0].as_py()])
        return pa.Table.from_batches([_rows(_SOLVED, idx, _packed(x, config.precision)), _rows(_GRAM, idx, [(x.T @ x).tobytes()], int(idx[0] % _SPREAD))])

    return run


def _gram(step: DataFrame, parts: int, config: AlsConfig) -> np.ndarray:
    """The factors' Gram matrix: partial ones of tasks and blocks, added in tasks first if there are many."""
    rows = step.filter(F.col("kind") == _GRAM)
    if parts > _SPREAD:
        rows = rows.groupBy("spread").applyInArrow(_added, _STEP)
    total = np.zeros(config.factors**2)
    for row in sorted(rows.collect(), key=lambda r: (r["spread"], r["idx"])):  # _SPREAD matrices at most
        total += np.frombuffer(row["data"], np.float64)
    return total.reshape(config.factors, config.factors)


def _update(
    step: DataFrame | None, gram: np.ndarray, side: tuple[DataFrame, list[DataFrame], int, bool], config: AlsConfig
) -> tuple[DataFrame, list[str], np.ndarray]:
    """One side's factors from the other's, or from the first ones: the written step, its folders, and its Gram matrix.

    A side without routes takes the vectors from files.
    """
    blocks, routes, n_blocks, split = side
    scaling = _scaling(gram, config)
    factors, written = None if step is None else step.filter(F.col("kind") == _SOLVED).select("idx", "data"), []
    if step is None:
        written.append(stage_at(blocks.mapInArrow(_first_half_step(scaling, config), _STEP), "factors"))
    elif not routes:
        folder = f"{local_stages(step.sparkSession)}/vectors-{uuid.uuid4().hex}"
        laid = factors.mapInArrow(writer(folder, config.factors, config.precision, partial(_scaled, inverse=scaling[0])), WRITTEN)
        files = [(r["path"], r["n"]) for r in laid.collect()]  # one row per task
        written.append(stage_at(blocks.mapInArrow(_own_half_step(files, scaling, config), _STEP), "factors"))
        remove(step.sparkSession, f"file:{folder}")
    else:
        for turn, route in enumerate(routes):
            sent = route.join(factors, "idx").select("idx", "to", "data").mapInArrow(_sent(scaling[0], config), "to long, ids binary, data binary")
            mine = _in_turn(blocks.drop("needs"), turn, len(routes)).groupBy("block")
            written.append(stage_at(mine.cogroup(sent.groupBy("to")).applyInArrow(_half_step(scaling, config), _STEP), "factors"))
    new, folders = reduce(DataFrame.unionByName, [part for part, _ in written]), [folder for _, folder in written]
    if split:
        parts = new.filter(F.col("kind") == _PART).groupBy("idx", "spread").applyInArrow(_added, _STEP)
        rest, folder = stage_at(parts.groupBy("idx").applyInArrow(_joined(scaling, config), _STEP), "split-factors")
        new, folders = new.filter(F.col("kind") != _PART).unionByName(rest), [*folders, folder]
        n_blocks = _SPREAD + 1  # one partial matrix for every split row
    return new, folders, _gram(new, n_blocks, config)


def _features(step: DataFrame, config: AlsConfig) -> DataFrame:
    kind = "float" if config.precision == "float32" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(np.frombuffer(b"".join(batch.column("data").to_pylist()), config.precision))
            ends = np.arange(0, len(flat) + 1, config.factors, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.ListArray.from_arrays(ends, flat)], ["idx", "features"])

    solved = step.filter(F.col("kind") == _SOLVED).select("idx", "data")
    return solved.mapInArrow(run, f"idx long, features array<{kind}>")


def train_als(coordinates: DataFrame, config: AlsConfig = AlsConfig()) -> FactorModel:
    """Fit on (user_idx, item_idx, rating), one row per pair; a rating of 0 is no observation, a negative one a dislike.

    One seed gives one model on any cluster, up to the order of sums. No observation leaves training however weak.
    Only the factors stay written.
    """
    ship_package(coordinates.sparkSession)
    with scratch(coordinates.sparkSession) as keep:
        left, right = _trained(coordinates, config)
        return FactorModel(keep(_features(left, config), "user-factors"), keep(_features(right, config), "item-factors"))


def _trained(coordinates: DataFrame, config: AlsConfig) -> tuple[DataFrame, DataFrame]:
    """The last steps of users and items."""
    pairs, pairs_folder = stage_at(
        coordinates.filter("rating <> 0").select(*(F.col(c).cast("long").alias(c) for c in ("user_idx", "item_idx")), F.col("rating").cast("double").alias("rating")),
        "pairs",
    )
    total = pairs.count()
    vector = config.factors * np.dtype(config.precision).itemsize
    turns = max(1, min(_TURNS, -(-total * vector // _TURN_BYTES)))
    longest = max(pairs.agg(*(F.approx_count_distinct(c) for c in ("user_idx", "item_idx"))).first())
    if longest * vector <= _TURNS * _TURN_BYTES and local_stages(pairs.sparkSession):
        turns = 0
    sides = []
    for row, col in (("user_idx", "item_idx"), ("item_idx", "user_idx")):
        blocks, n_blocks, split = _blocks(pairs, row, col, total, config)
        sides.append((blocks, _routes(blocks, row, turns), n_blocks, split))
    users, items = sides
    start = pairs.select("item_idx").distinct().mapInArrow(_initial(config), _STEP)
    right, old = stage_at(start, "factors")
    remove(pairs.sparkSession, pairs_folder)  # the blocks hold them
    gram, old = _gram(right, right.filter(F.col("kind") == _GRAM).count(), config), [old]
    left = right.limit(0)
    for k in range(config.iterations):
        left, left_folders, gram = _update(right if k else None, gram, users, config)
        right, right_folders, gram = _update(left, gram, items, config)
        for folder in old:
            remove(pairs.sparkSession, folder)
        old = [*left_folders, *right_folders]
    return left, right


def _best(n: int, width: int, dtype: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The lists of a block of users from one block of items, see ``best_unseen``."""

    def run(sides: pa.Table, seen: pa.Table) -> pa.Table:
        found = {}
        for row in sides.to_pylist():
            ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], dtype).reshape(-1, width)
            found[row["side"]] = ids, vectors, np.frombuffer(row["floors"], np.float64) if row["floors"] else None
        if len(found) < 2:
            return LISTED.empty_table()
        (users, x, floors), (items, y, _) = found["user"], found["item"]
        finite = np.isfinite(y).all(1)
        blocks = [tiled(items[finite], y[finite])] if finite.any() else []
        pairs = seen.column("user_idx").to_numpy(), seen.column("item_idx").to_numpy()
        return best_unseen(blocks, users, x, floors, pairs, n)

    return run


def _floors(n: int, width: int, dtype: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of users with the floor of each: a little below the n-th best score among the items of greatest norm."""
    best = _best(n, width, dtype)

    def run(sides: pa.Table, seen: pa.Table) -> pa.Table:
        row = next((r for r in sides.to_pylist() if r["side"] == "user"), None)
        if row is None:
            return _BLOB.empty_table()
        listed = best(sides, seen)
        ids = np.frombuffer(row["ids"], np.int64)
        place = np.argsort(ids)
        who, score = listed.column("user_idx").to_numpy(), listed.column("score").to_numpy()
        at = place[np.searchsorted(ids[place], who)] if len(who) else who
        floors = np.full(len(ids), np.inf)
        np.minimum.at(floors, at, score)
        floors[np.bincount(at, minlength=len(ids)) < n] = -np.inf
        floors -= np.where(np.isfinite(floors), 1e-9 * np.abs(floors) + np.finfo(np.float64).tiny, 0.0)
        made = ["user", row["user_block"], row["ids"], row["data"], floors.tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(made, _BLOB, strict=True)], schema=_BLOB)

    return run


def _blob(side: str) -> Callable[[pa.Table], pa.Table]:
    """A block's factors as one row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        features = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        made = [side, table.column("block")[0].as_py(), table.column("idx").to_numpy().tobytes(), features.tobytes(), None]
        return pa.table([pa.array([v], f.type) for v, f in zip(made, _BLOB, strict=True)], schema=_BLOB)

    return run


def _grid(n_users: int, n_items: int, width: int, n: int, tasks: int) -> tuple[int, int]:
    """Blocks of users and of items: squares of pairs for about so many tasks, and no block beyond BLOCK_BYTES.

    Each factor goes once to every block of the other side, so with a given number of tasks what is exchanged grows with
    the factors, not with the pairs. Lists count as bytes of the users, so where these need more blocks than a square
    asks for, those of the items are longer.
    """
    side = max(_CHUNK, int((n_users * n_items / tasks) ** 0.5))
    users = max(1, -(-n_users // max(1, min(side, USER_BLOCK, BLOCK_BYTES // (8 * max(width, 2 * n))))))
    side = max(side, n_items * users // tasks)
    return users, max(1, -(-n_items // max(1, min(side, ITEM_BLOCK, BLOCK_BYTES // (8 * width)))))


def top_unseen_by_index(model: FactorModel, coordinates: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """(user_idx, item_idx, score, rank): n best items per user outside the user's coordinates.

    Where Python workers can open the shared folder, the items are laid down there in tiles, by falling norm, and groups
    of users with the pairs they have seen go through all of them. Elsewhere blocks of users and of items meet in one
    exchange, see ``_sent_lists``.
    """
    spark = coordinates.sparkSession
    ship_package(spark)
    wanted = stage(users.select(F.col("user_idx").cast("long").alias("user_idx")).distinct(), "wanted")
    folder = local_stages(spark)
    listed = _sent_lists(model, coordinates, wanted, n) if folder is None else _lists_of_files(model, coordinates, wanted, n, folder)
    return top_per_group(listed, ["user_idx"], [F.desc("score"), F.asc("item_idx")], n, "rank")


def _lists_of_files(model: FactorModel, coordinates: DataFrame, wanted: DataFrame, n: int, folder: str) -> DataFrame:
    """(user_idx, item_idx, score) of every listed user. A task holds a group of users, their seen pairs and lists, and
    maps the items."""
    spark = coordinates.sparkSession
    first = model.item_factors.agg(F.max(F.size("features")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = first["width"] or 1
    blocks = max(1, -(-first["n"] // max(1, min(ITEM_BLOCK, BLOCK_BYTES // (8 * width)))))
    things = model.item_factors.select("idx", "features")
    normed = things.mapInArrow(with_norm, f"{_ddl(things)}, norm double")
    laid = normed.repartitionByRange(blocks, F.desc("norm"), "idx").mapInArrow(tile_writer(f"{folder}/items-{uuid.uuid4().hex}"), WRITTEN)
    paths = sorted(r["path"] for r in laid.collect())  # one row per block
    tasks = max(_TASKS, _BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)
    most = max(1, min(USER_BLOCK, _CHUNK, _GROUP_BYTES // (16 * max(width, 2 * n))))
    groups = max(1, -(-wanted.count() // most))
    tasks = min(groups, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    group = F.pmod(F.xxhash64("user_idx"), F.lit(groups)).alias("group")
    people = model.user_factors.select(F.col("idx").alias("user_idx"), "features").join(wanted, "user_idx", "left_semi")
    seen = coordinates.select(*(F.col(c).cast("long").alias(c) for c in ("user_idx", "item_idx"))).join(wanted, "user_idx", "left_semi")
    # by number, so that few bytes do not make few tasks
    dealt = (side.select(group, *side.columns).repartition(tasks, "group").groupBy("group") for side in (people, seen))
    return next(dealt).cogroup(next(dealt)).applyInArrow(best_of_files(n, paths), "user_idx long, item_idx long, score double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _sent_lists(model: FactorModel, coordinates: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(user_idx, item_idx, score) that hold every listed user's n best.

    The listed users, in blocks, first meet the HEAD items of greatest norm, which gives each a floor that its n best
    reach at least. Then all blocks of users and of items meet, together with the seen pairs of the two, which are left
    out of the lists. Nothing below a floor leaves a task.
    """
    spark = coordinates.sparkSession
    element = model.item_factors.schema["features"].dataType.elementType.simpleString()
    first = model.item_factors.agg(F.max(F.size("features")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width, dtype = first["width"] or 1, "float32" if element == "float" else "float64"
    tasks = max(_TASKS, _BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism)
    user_blocks, item_blocks = _grid(wanted.count(), first["n"], width, n, tasks)
    user_block = F.pmod(F.xxhash64("user_idx"), F.lit(user_blocks))
    item_block = F.pmod(F.xxhash64("item_idx"), F.lit(item_blocks))
    blob = "side string, block long, ids binary, data binary, floors binary"
    people = model.user_factors.join(wanted.withColumnRenamed("user_idx", "idx"), "idx", "left_semi").withColumnRenamed("idx", "user_idx")
    left = people.select(user_block.alias("block"), F.col("user_idx").alias("idx"), "features").groupBy("block").applyInArrow(_blob("user"), blob)
    things = model.item_factors.withColumnRenamed("idx", "item_idx")
    right = things.select(item_block.alias("block"), F.col("item_idx").alias("idx"), "features").groupBy("block").applyInArrow(_blob("item"), blob)
    norm = F.aggregate("features", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    head = stage(things.orderBy(norm.desc(), "item_idx").limit(HEAD).select(F.col("item_idx").alias("idx"), "features"), "head-items")
    seen = coordinates.select(*(F.col(c).cast("long").alias(c) for c in ("user_idx", "item_idx"))).join(wanted, "user_idx", "left_semi")
    seen = seen.select("user_idx", "item_idx", user_block.alias("ub"), item_block.alias("ib"))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    columns = "side", "ids", "data", "floors", "user_block", "item_block"
    lead = head.withColumn("block", F.lit(0).cast("long")).groupBy("block").applyInArrow(_blob("item"), blob)
    sides = left.withColumnRenamed("block", "user_block").unionByName(lead.drop("block").withColumn("user_block", each(user_blocks)))
    seen_head = seen.join(F.broadcast(head.select(F.col("idx").alias("item_idx"))), "item_idx", "left_semi")
    raised = sides.groupBy("user_block").cogroup(seen_head.groupBy("ub")).applyInArrow(_floors(n, width, dtype), blob)
    left = stage(raised, "user-blocks")
    sides = left.withColumnRenamed("block", "user_block").withColumn("item_block", each(item_blocks)).select(*columns).unionByName(
        right.withColumnRenamed("block", "item_block").withColumn("user_block", each(user_blocks)).select(*columns)
    )
    return sides.groupBy("user_block", "item_block").cogroup(seen.groupBy("ub", "ib")).applyInArrow(_best(n, width, dtype), "user_idx long, item_idx long, score double")


def top_unseen(model: FactorModel, matrix: UserItemMatrix, users: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, score, rank) for the given user ids that the model knows."""
    known = matrix.users.join(users.select("user_id").distinct(), "user_id", "left_semi")
    ranked = top_unseen_by_index(model, matrix.coordinates, known, n)
    return (
        ranked.join(matrix.users, "user_idx")
        .join(matrix.items, "item_idx")
        .select("user_id", "item_id", "score", "rank")
    )
