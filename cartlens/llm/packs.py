"""Strings cut from documents, packed by bucket for one shuffle, and runs that come back to their documents.

A document is known by its id and a hash of its text, so rows that repeat both count as one document and rows that
share an id only stay apart, in the order of the hash. A null id counts as the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.arrays import Block, ranges
from cartlens.session import stage

#: Bytes of text whose strings are packed together; what repeats within them is settled before the shuffle.
CHUNK_BYTES = 8 << 20

#: Text whose strings one bucket, and one task with its buckets, is meant to get. Buckets grow in number, not in size.
BUCKET_BYTES = 16 << 20
TASK_BYTES = 64 << 20
#: Key under which the counts of `surveyed` hold the bytes of text.
BYTES_KEY = -1

RUNS = "_id long, _th long, a long, b long"


@dataclass
class Strings:
    """String i is data[offsets[i]:offsets[i + 1]], cut from document (ids[i], hashes[i]) at place[i]."""

    ids: np.ndarray
    hashes: np.ndarray
    place: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def block(self) -> Block:
        return Block(0, self.data, self.offsets, np.ones(len(self), bool))

    def take(self, index: np.ndarray) -> Strings:
        sizes = np.diff(self.offsets)[index]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return Strings(self.ids[index], self.hashes[index], self.place[index], offsets, self.data[ranges(self.offsets[index], sizes)])

    def document_rank(self) -> np.ndarray:
        return rank_pairs(self.ids, self.hashes)


#: Bits of a bitmap of frequent values.
MARK_BITS = 1 << 23


def repeats(values: list[np.ndarray]) -> pa.RecordBatch:
    """(key, n): the values that occur more than once, for `frequent`."""
    key, n = np.unique(np.concatenate(values), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key[n > 1].astype(np.uint64).view(np.int64)), pa.array(n[n > 1])], ["key", "n"])


def frequent(counted: DataFrame, least: int) -> np.ndarray:
    """Bitmap of the keys whose counts n come to at least that many, by their low bits.

    It only decides where work goes, never a result, so keys that share a bit do no harm. MARK_BITS / 64 words reach the
    driver, whatever the table's size.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("key").to_numpy().view(np.uint64) & np.uint64(MARK_BITS - 1)
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["w", "b"])

    keys = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")
    table = keys.mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(MARK_BITS // 64, np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return out


def text_bytes(n: int) -> pa.RecordBatch:
    """(key, n): bytes of text read, for `surveyed`."""
    return pa.RecordBatch.from_arrays([pa.array([BYTES_KEY]), pa.array([n])], ["key", "n"])


def surveyed(counted: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """What `frequent` says, and the bytes of text, from one pass; counted holds the rows of `repeats` and `text_bytes`,
    whose other keys are not negative."""
    known = stage(counted.groupBy("key").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("key") == BYTES_KEY)), "counts")
    size = known.filter(F.col("key") == BYTES_KEY).agg(F.sum("n")).first()[0]
    return frequent(known.filter(F.col("key") != BYTES_KEY), least), size or 0


def bucket_count(spark: SparkSession, size: int, per_task: int) -> int:
    """Buckets for that many bytes of text: per_task for every shuffle partition, or more where they would get too large."""
    return max(per_task * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))


def marked(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = values & values.dtype.type(MARK_BITS - 1)
    return (marks[at >> at.dtype.type(6)] >> (at & at.dtype.type(63)).astype(np.uint64)) & np.uint64(1) == 1


def rank_pairs(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Dense rank of (id, hash)."""
    if len(ids) == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((hashes, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pack(s: Strings, runs: Runs) -> bytes:
    head = np.array([len(s), len(runs[0])], np.int64)
    sizes = np.diff(s.offsets).astype(np.int64)
    parts = [head, s.ids, s.hashes, s.place, sizes, *runs]
    raw = b"".join([np.ascontiguousarray(p, np.int64).tobytes() for p in parts] + [s.data.tobytes()])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(blobs: list[bytes]) -> tuple[Strings, Runs]:
    fields: list[list[np.ndarray]] = [[] for _ in range(9)]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        for k, size in enumerate([n, n, n, n, m, m, m, m]):
            fields[k].append(np.frombuffer(raw, np.int64, size, at))
            at += 8 * size
        fields[8].append(np.frombuffer(raw, np.uint8, -1, at))
    whole = [np.concatenate(f) for f in fields]
    offsets = np.concatenate([[0], np.cumsum(whole[3])])
    return Strings(whole[0], whole[1], whole[2], offsets, whole[8]), (whole[4], whole[5], whole[6], whole[7])


def packed(strings: Strings, bucket: np.ndarray, n_buckets: int, runs: Runs) -> Iterator[pa.RecordBatch]:
    """One row per bucket that gets any of the strings; runs that are already known travel along, spread by document."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    home = (runs[1] % n_buckets).astype(np.int64)
    run_order = np.argsort(home, kind="stable")
    run_edge = np.searchsorted(home[run_order], np.arange(n_buckets + 1))
    for b in np.flatnonzero((np.diff(edge) > 0) | (np.diff(run_edge) > 0)).tolist():
        mine, known = order[edge[b] : edge[b + 1]], run_order[run_edge[b] : run_edge[b + 1]]
        blob = pack(strings.take(mine), tuple(r[known] for r in runs))
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The frame with the document key _id, _th."""
    return docs.withColumns(
        {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_th": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    )


def bucket_runs(
    docs: DataFrame,
    cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    settle: Callable[[Strings], Runs],
    size: int = 0,
) -> DataFrame:
    """Cut the documents into packed strings, bring each bucket together, and return the runs found there. size: bytes
    of all texts; there is a task for every TASK_BYTES of them, and not fewer than shuffle partitions."""

    def group(table: pa.Table) -> pa.Table:
        strings, known = unpack(table.column("blob").to_pylist())
        found = settle(strings)
        columns = [pa.array(np.concatenate([x, y])) for x, y in zip(known, found, strict=True)]
        return pa.Table.from_arrays(columns, ["_id", "_th", "a", "b"])

    rows = docs.mapInArrow(cut, "bucket int, blob binary")
    tasks = math.ceil(size / TASK_BYTES)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "bucket")  # the grouping takes these partitions as they are
    return rows.groupBy("bucket").applyInArrow(group, RUNS)


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with the array `_runs` of struct(a, b) of their runs, null if they have none."""
    per_document = runs.groupBy("_id", "_th").agg(F.collect_list(F.struct("a", "b")).alias("_runs"))
    return docs.join(per_document, ["_id", "_th"], "left")


def row_runs(column: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the runs of all rows, over the rows' elements laid end to end: (covered, first of each maximal run)."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    depth = np.zeros(offsets[-1] + 1, np.int64)
    counts = np.asarray(column.value_lengths().fill_null(0))
    if counts.sum():
        flat = column.flatten()
        base = np.repeat(offsets[:-1], counts)
        np.add.at(depth, base + flat.field("a").to_numpy(), 1)
        np.add.at(depth, base + flat.field("b").to_numpy(), -1)
    covered = np.cumsum(depth)[:-1] > 0
    first = covered.copy()
    first[1:] &= ~covered[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(first)]
    first[edges] = covered[edges]
    return covered, first
