"""Prefix trie of conversations: every distinct sequence of first turns is a node with its members and subtree sums.

1. A turn becomes two 63-bit hashes of its role and text, so the shuffles carry numbers, not texts. A conversation is the
   array of its turns' hashes in order.
2. Conversations are dealt to shards by range of (array, id), so the members of any node are consecutive, copies of one
   conversation spread over as many shards as they need, and a shard holds about SHARD_TURNS turns.
3. In a shard, arrays are padded to matrices of WIDTH turns and sorted by numpy's lexsort, block after block of columns
   for the groups that are still equal. Where a column differs from the row above, a mask is set and or-ed to the right;
   what stays unset is the prefix shared with the row above. A node of depth d starts at a row that shares less than d,
   and reduceat sums its rows. All sums are over rows: a row saves the turns it shares with the row above, closes a leaf
   if the next row does not go on from it, and starts a child of depth d + 1 if it shares d turns at most.
4. Nodes that reach over a shard's rim are known by the shard they start in and their depth. Their parts are summed in a
   second aggregation, at most one row per shard and depth. Their ending members are hashed from the shards' parts in
   order, as a stream.

Driver: two numbers per shard. Memory of a task: a shard, or the longest conversation (20 bytes a turn). Two different
turns count as one if all 126 bits agree, which is not looked for.

Null turns come first; turns of one number are ordered by hash; repeated rows are repeated turns. Null role or text is
empty. Rows without a conversation id belong to none and are left out. An empty table has no conversation and no node.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.joins import join_small
from cartlens.llm.arrays import ranges
from cartlens.session import stage

#: Turns and conversations in a shard, and turns in a block of the padded matrix.
SHARD_TURNS = 1 << 17
WIDTH = 8

_MEASURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(m, pa.int64()) for m in _MEASURES]
    + [("ends_sha256", pa.string()), ("ends", pa.binary()), ("part", pa.int32()), ("owner", pa.int32()), ("parent_owner", pa.int32())]
)
_NODES_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary, part int, owner int, parent_owner int"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, as structs of two hashes and a number of code points."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    half = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), role, text), 1)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct(F.col("turn").alias("turn"), half(1).alias("a"), half(2).alias("b"), F.length(text).alias("n")).alias("t")
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns"))


def _sort(conv: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their turns, then id, and the turns each shares with the row above (0 for the first)."""
    n = len(conv)
    order, shared, first = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    first[:1] = True
    at, depth = np.arange(n), 0  # places whose groups have several rows and turns left
    while len(at):
        rows = order[at]
        group = np.cumsum(first[at])
        count = np.clip(length[rows] - depth, 0, WIDTH)
        matrix = np.full((len(rows), WIDTH, 2), -1, np.int64)
        matrix[np.repeat(np.arange(len(rows)), count), ranges(np.zeros(len(rows), np.int64), count)] = hashes[ranges(start[rows] + depth, count)]
        flat = matrix.reshape(len(rows), 2 * WIDTH)
        by = np.lexsort((conv[rows], *flat.T[::-1], group))
        order[at], matrix = rows[by], matrix[by]
        change = np.logical_or.accumulate((matrix[1:] != matrix[:-1]).any(2), axis=1)
        inner = group[1:] == group[:-1]
        shared[at[1:][inner]] = depth + WIDTH - change.sum(1)[inner]
        first[at[1:][inner & change[:, -1]]] = True
        depth += WIDTH
        number = np.cumsum(first[at]) - 1
        several = np.bincount(number) > 1
        longer = np.bincount(number, length[order[at]] > depth) > 0
        at = at[(several & longer)[number]]
    size = length[order]
    shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    return order, shared


def _owners(rims: dict[int, int], through: dict[int, int], part: int) -> np.ndarray:
    """Shard in which the node of each depth on the way into this shard starts, for the depths shared with the last one.

    A node that leaves a shard has come into it if all its rows and the row before share that depth.
    """
    owner = np.full(max(rims[part] + 1, 0), -1, np.int32)
    left = rims[part]
    for q in sorted((p for p in rims if p < part), reverse=True):
        if left < 0:
            break
        low = min(left, rims[q], through[q])
        owner[max(low + 1, 0) : left + 1] = q
        left = low
    return owner


def _shard(table: pa.Table, rims: dict[int, int], through: dict[int, int]) -> pa.Table:
    """Nodes of one shard. By shard, rims: turns its first row shares with the row before; through: turns all rows share."""
    part = table.column("part")[0].as_py()
    table = table.combine_chunks()
    conv = table.column("conv_id").to_numpy()
    ids, sizes = (table.column(c).combine_chunks() for c in ("ids", "sizes"))
    length = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = ids.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    start = np.cumsum(length) - length
    points = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    order, shared = _sort(conv, start, length, hashes)
    conv, start, length = conv[order], start[order], length[order]
    shared[0], next_shared = rims[part], rims.get(min((p for p in rims if p > part), default=-1), -1)
    leaf = np.append(shared[1:], next_shared) < length
    saves = points[start + np.maximum(shared, 0)] - points[start]
    owners = _owners(rims, through, part)

    out: dict[str, list] = {name: [] for name in _NODES.names}
    node_of, node_conv, node_owner, made = np.full(len(conv), -1), [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    alive = np.arange(len(conv))
    for depth in range(int(length.max()) + 1):
        alive = alive[length[alive] >= depth]
        begins = shared[alive] < depth
        from_before, goes_on = not begins[0], bool(alive[-1] == len(conv) - 1 and next_shared >= depth)
        begins[0] = True
        at = np.flatnonzero(begins)
        parent = node_of[alive[at]]
        node_of[alive] = made + np.cumsum(begins) - 1
        base = points[start[alive] + max(depth - 1, 0)] - points[start[alive]]
        again = np.where(shared[alive] >= depth, saves[alive] - base, 0)
        child = (length[alive] > depth) & (shared[alive] <= depth)
        smallest = np.minimum.reduceat(conv[alive], at)
        owner = np.full(len(at), -1, np.int32)
        if goes_on:
            owner[-1] = part
        if from_before:
            owner[0] = owners[depth]
        ending = np.add.reduceat((length[alive] == depth).astype(np.int64), at)
        texts = [",".join(map(str, conv[i : i + k].tolist())).encode() if k else b"" for i, k in zip(alive[at].tolist(), ending.tolist(), strict=True)]
        rim = owner >= 0
        known = np.concatenate(node_conv), np.concatenate(node_owner)
        has_parent = parent >= 0
        parent_owner = np.where(has_parent, known[1][parent], -1) if depth else np.full(len(at), -1)
        parent_conv = known[0][parent] if depth else np.zeros(len(at), np.int64)
        out["conv_id"].append(pa.array(smallest))
        out["depth"].append(pa.array(np.full(len(at), depth)))
        out["parent_conv_id"].append(pa.array(parent_conv, mask=~has_parent | (parent_owner >= 0)))
        out["n_convs"].append(pa.array(np.diff(np.append(at, len(alive)))))
        out["n_children"].append(pa.array(np.add.reduceat(child.astype(np.int64), at)))
        out["n_leaves"].append(pa.array(np.add.reduceat(leaf[alive].astype(np.int64), at)))
        out["saved_tokens"].append(pa.array(np.add.reduceat(again, at)))
        out["ends_sha256"].append(pa.array([None if r else hashlib.sha256(t).hexdigest() for t, r in zip(texts, rim, strict=True)], pa.string()))
        out["ends"].append(pa.array([t if r and t else None for t, r in zip(texts, rim, strict=True)], pa.binary()))
        out["part"].append(pa.array(np.full(len(at), part, np.int32)))
        out["owner"].append(pa.array(owner, mask=~rim))
        out["parent_owner"].append(pa.array(parent_owner.astype(np.int32), mask=parent_owner < 0))
        made += len(at)
        # Only the level above is asked for a parent.
        node_conv, node_owner = [np.zeros(made - len(at), np.int64), smallest], [np.zeros(made - len(at), np.int32), owner]
    return pa.table({name: pa.chunked_array(parts) for name, parts in out.items()}, schema=_NODES)


def _common(one: Column, other: Column) -> Column:
    """Number of equal leading entries of two arrays."""
    equal = F.zip_with(one, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(equal, False)
    return F.when(differs == 0, F.size(one)).otherwise(differs - 1)


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the comma-joined parts of every (owner, depth); rows come in order."""
    now, state = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for owner, depth, text in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ends")), strict=True):
            if (owner, depth) != now:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (owner, depth), hashlib.sha256(text)
            else:
                state.update(b"," + text)
    if now:
        done.append((*now, state.hexdigest()))
    columns = list(zip(*done, strict=True)) or [(), (), ()]
    kinds = pa.int32(), pa.int64(), pa.string()
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["owner", "depth", "_sha"])


def nodes(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), ids distinct: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    shards: by default as many as the session's shuffle partitions, and more if a shard would pass SHARD_TURNS.
    """
    spark = paths.sparkSession
    hashed = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    rows = stage(paths.select("conv_id", hashed.alias("ids"), F.transform("turns", lambda t: t["n"]).alias("sizes")), "paths")
    if shards is None:
        turns = rows.agg(F.sum(F.size("sizes") + 1).alias("n")).first()["n"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    dealt = stage(rows.repartitionByRange(shards, "ids", "conv_id").withColumn("part", F.spark_partition_id()), "shards")
    whole = F.struct("ids", "conv_id")
    rim = dealt.groupBy("part").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
    before = F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("part"))  # one row per shard
    turns_shared = lambda one, other: F.floor(_common(F.col(f"{one}.ids"), F.col(f"{other}.ids")) / 2)
    found = (
        rim.select("part", "low", "high", before.alias("before"))
        .select(
            "part",
            F.when(F.col("before").isNull(), -1).otherwise(turns_shared("low", "before")).alias("rim"),
            turns_shared("low", "high").alias("through"),
        )
        .collect()
    )
    rims, through = ({r["part"]: r[c] for r in found} for c in ("rim", "through"))
    parts = stage(dealt.groupBy("part").applyInArrow(lambda t: _shard(t, rims, through), _NODES_SQL), "trie-parts")

    cut = parts.filter("owner IS NOT NULL")
    sums = cut.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *(F.sum(m).alias(m) for m in _MEASURES), F.max("parent_owner").alias("parent_owner"))
    texts = cut.filter("ends IS NOT NULL").select("owner", "depth", "part", "ends").repartition("owner", "depth")
    digests = texts.sortWithinPartitions("owner", "depth", "part").mapInArrow(_streamed_hash, "owner int, depth long, _sha string")
    merged = stage(sums.join(digests, ["owner", "depth"], "left"), "trie-rims")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", *_MEASURES, "ends_sha256", "parent_owner"]
    every = parts.filter("owner IS NULL").select(columns).unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("ends_sha256", F.coalesce("_sha", nothing)).select(columns)
    )
    above = merged.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_above"))
    placed = join_small(every, above, ["parent_owner", "depth"], ["conv_id"], "left")
    return placed.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), *_MEASURES, "ends_sha256"
    )
