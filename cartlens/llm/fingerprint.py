"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's bytes; a chunk ends where its top bits are zero, with a stricter mask before
NORMAL bytes and a looser one behind, and never before MIN or after MAX bytes. Cuts depend on nearby content only, so
text that moves keeps its chunks. A fingerprint is the sorted list of the distinct chunk digests, each ten hex digits with
the chunk's length in four; equal texts have equal fingerprints and the empty text has the empty one. The containment
of one fingerprint in another is the share of the smaller one's bytes in common chunks: 1 for two empty ones, 0 for
one. The texts are cut whole; a null text counts as empty.

`with_next` pairs every document with the next one in descending id. Documents go to tasks by id range; the first
document of the following range comes along as a guest, so no order over the whole table is needed. Rows of one id
follow one another by text; null ids come last, and the last document's next is the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.arrays import Block, block_of, mix, prefix_hash, span_hash

MIN, NORMAL, MAX = 16, 40, 320
STRICT_BITS, LOOSE_BITS = 6, 4
WINDOW = 16

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte of the WINDOW bytes that end there, by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
        width *= 2
    return h


def cuts(candidates: list[int], strict: list[bool], start: int, end: int) -> list[int]:
    """Ends of the chunks of bytes start..end; candidates: places where a cut may follow, ascending, within them."""
    out, k, n = [], 0, len(candidates)
    while end - start > MIN:
        while k < n and candidates[k] < start + MIN:
            k += 1
        while k < n and candidates[k] < start + NORMAL and not strict[k]:
            k += 1
        at = candidates[k] if k < n else end
        at = min(at, start + MAX, end)
        out.append(at)
        start = at
    if start < end:
        out.append(end)
    return out


def fingerprints(block: Block) -> list[str]:
    """Fingerprint of each row."""
    n = len(block.data)
    if n == 0:
        return [""] * len(block)
    h = gear(block.data)
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0)
    strict = ((h[loose] >> np.uint32(32 - STRICT_BITS)) == 0).tolist()
    # The window must lie within the row, or the bytes before it would decide.
    within = np.searchsorted(loose, np.stack([np.minimum(block.offsets[:-1] + WINDOW - 1, block.offsets[1:]), block.offsets[1:]]))
    places = (loose + 1).tolist()
    ends: list[int] = []
    counts = []
    for i in range(len(block)):
        a, b = within[0, i], within[1, i]
        row = cuts(places[a:b], strict[a:b], int(block.offsets[i]), int(block.offsets[i + 1]))
        ends += row
        counts.append(len(row))
    end = np.asarray(ends, np.int64)
    start = np.empty_like(end)
    start[1:] = end[:-1]
    if len(start):
        start[0] = 0
    digest = mix(span_hash(prefix_hash(block.data), start, end)) >> np.uint64(24)
    entry = ((digest << np.uint64(16)) | (end - start).astype(np.uint64)).tolist()
    out, at = [], 0
    for c in counts:
        out.append("".join([f"{e:014x}" for e in sorted(set(entry[at : at + c]))]))
        at += c
    return out


def entries(fingerprint: str) -> set[str]:
    return {fingerprint[i : i + 14] for i in range(0, len(fingerprint), 14)}


def containment(a: str, b: str) -> float:
    """Bytes in common chunks over the bytes of the fingerprint that has fewer."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = entries(a), entries(b)
    weight = lambda s: sum(int(e[10:], 16) for e in s)
    return weight(x & y) / min(weight(x), weight(y))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the other one, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _rank(column: pa.Array) -> np.ndarray:
    """Ids as ascending positions of the descending order; null after every id."""
    ids = column.fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
    return ~ids


def in_ranges(docs: DataFrame, id_col: str, text_col: str, n_ranges: int) -> DataFrame:
    """Rows (part, guest, rank, id, text): each document in its range, and each range's first document also as a guest
    of the range before it, the first range's as a guest of the last one."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_rank(batch.column("id")))], ["rank"])

    ranks = ids.mapInArrow(ranked, "rank long")
    levels = [i / n_ranges for i in range(1, n_ranges)]
    # Null ids, all of one rank, are a range of their own and have no say in the others.
    last = np.iinfo(np.int64).max
    known = ranks.filter(F.col("rank") < int(last))
    cuts_ = np.asarray(known.approxQuantile("rank", levels, 0.25 / n_ranges) if levels else [], np.float64)
    # The largest doubles below 2 ** 63 are the largest that are integers of 64 bits.
    inner = np.clip(cuts_[np.isfinite(cuts_)], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    edges = np.append(np.unique(inner), last)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            part = np.searchsorted(edges, rank, "right")
            for p in np.unique(part).tolist():
                low = int(rank[part == p].min())
                least[p] = min(low, least.get(p, low))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["part", "rank"])

    # One row per range: its place and the rank its first document has.
    rows = ranks.mapInArrow(firsts, "part int, rank long").groupBy("part").agg(F.min("rank").alias("rank")).orderBy("part").collect()
    places = [r["part"] for r in rows]
    host = {r["rank"]: places[i - 1] for i, r in enumerate(rows)}
    guests = np.asarray(sorted(host), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = _rank(batch.column("id"))
            part = np.searchsorted(edges, rank, "right").astype(np.int32)
            names = ["part", "guest", "rank", "id", "text"]
            own = [pa.array(part), pa.array(np.zeros(len(rank), bool)), pa.array(rank), batch.column("id"), batch.column("text")]
            yield pa.RecordBatch.from_arrays(own, names)
            also = np.flatnonzero(np.isin(rank, guests))
            if len(also):
                picked = pa.array(also)
                to = pa.array([host[int(rank[i])] for i in also], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [to, pa.array(np.ones(len(also), bool)), pa.array(rank[also]), batch.column("id").take(picked), batch.column("text").take(picked)],
                    names,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(deal, "part int, guest boolean, rank long, id long, text string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """One row per document: id, n_chars, edited text's digest, both fingerprints, and both containments."""
    spark = docs.sparkSession
    n_ranges = n_ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_ranges(docs, id_col, text_col, n_ranges)
    ordered = dealt.repartition("part").sortWithinPartitions("part", "guest", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last document, whose next is not known yet
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            parts, guests = batch.column("part").to_pylist(), batch.column("guest").to_pylist()
            ids, texts = batch.column("id"), batch.column("text")
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                if held is not None and held[0] == parts[i]:
                    waiting.append((held[1], held[2], text))
                    size += len(held[2]) + len(text)
                held = None if guests[i] else (parts[i], ids[i].as_py(), text)
                if size > 1 << 20:
                    yield result(waiting)
                    waiting, size = [], 0
        if waiting:
            yield result(waiting)

    return ordered.mapInArrow(
        run,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    ).select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def result(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (id, text, next text)."""
    changed = [edited(text, following).encode() for _, text, following in rows]
    own, new, other = [], [], []
    step = 512
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        sources = [r[1] for r in part]
        # The next text of a row is mostly the text of the next row: read it once.
        for k, r in enumerate(part):
            if k + 1 == len(part) or part[k + 1][1] is not r[2]:
                sources.append(r[2])
        found = dict(zip(map(id, sources), fingerprints(block_of([s.encode() for s in sources])), strict=True))
        own += [found[id(r[1])] for r in part]
        other += [found[id(r[2])] for r in part]
        new += fingerprints(block_of(changed[i : i + step]))
    columns = {
        "id": pa.array([r[0] for r in rows], pa.int64()),
        "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
        "fingerprint": pa.array(own, pa.string()),
        "edited_fingerprint": pa.array(new, pa.string()),
        "near_edited": pa.array([containment(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
        "near_next": pa.array([containment(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
