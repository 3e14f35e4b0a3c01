"""Exact n-gram Jaccard join: candidates by prefix, bitmap bounds over size-banded tiles, sorted-array intersection.

A document's set holds the hashes of its distinct word shingles. Two sets link when 7 * common >= 3 * (their sizes),
which is a Jaccard similarity of 3/4. Documents with equal sets are one node.

1. Prefixes. With the elements of every set in one global order, linked sets of sizes n >= m share an element among
   the first n - ceil(3 (n + m) / 7) + 1 of the one and the first m - ceil(3 (n + m) / 7) + 1 of the other. The order puts
   frequent elements last: those marked in a bitmap of fixed size, filled from counts over all documents. Any marks give
   complete results, so the bitmap needs no exactness. Elements of the prefixes meet by hash bucket.
2. Elements that at most TILE sets share give all their pairs of fitting size. Sets meet at a marked or larger element
   when most of a text is frequent, as in a family of copies; there each set first meets one pivot, the one with the
   fewest unmarked elements, usually the text the others were made from.
3. Bitmap bound. Each set has a bitmap of parities, four to eight bits an element; wider ones fold to the width of
   narrower ones. Two bitmaps differ in at most as many bits as their sets differ in elements, so a pair with more than
   (n + m) / 7 differing bits is out.
4. Exact test by intersection of the sorted hash arrays, computed again from the texts of the sets still in question.
   Each set is first tested against its smallest partner. What these links join needs no further test; pairs that
   this leaves in different components follow.
5. Sets of one frequent element that are still in different components are compared in tiles: the sets outside the
   element's largest component, ordered by size and cut into bands of BAND, against the bands of all its sets whose sizes
   can reach 3/4, by the places of the element, the bitmap bound and then the exact test. So a family that hangs together
   costs one test per member and element, not one per pair. Sets that share frequent elements and link with nothing are
   all outside; those of like size are compared pair by pair.

A document without words has the empty set and links with nothing; with fewer words than a shingle, its set is the
whole sequence. A null text counts as empty, a null id keeps a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.arrays import Block, blocks, gram_hashes, mix, prefix_hash, ranges, span_hash, word_hashes, words
from cartlens.llm.components import SMALL, components, extended, slim, with_components
from cartlens.llm.packs import CHUNK_BYTES, frequent, marked
from cartlens.llm.windows import window_starts
from cartlens.session import stage

#: Bounds of a bitmap's width; within them it follows the set's size.
MIN_BITS, MAX_BITS = 1024, 1 << 19
#: Sets that share an element and give all their pairs at once.
TILE = 32
#: Width of a band.
BAND = 4096
#: Documents with an element, as counted below, from which it is marked as frequent.
FREQUENT = 64
#: Frequent elements of a set by which a pair is known to meet sooner.
EARLY = 8
#: Partners of a set, on average, up to which all pairs are tested at once.
FEW_PARTNERS = 3
#: Bits of the bitmap of first documents whose arrays are wanted.
WANTED_BITS = 1 << 22


def sets_of(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): distinct shingle hashes of each row, ascending; those of row i are hashes[rows[i]:rows[i + 1]]."""
    n = len(block)
    w = words(block)
    h = word_hashes(block, w, lower=True)
    at, row = window_starts(w.rows, size)
    count = np.diff(w.rows)
    short = np.flatnonzero((count > 0) & (count < size))
    whole = mix(span_hash(prefix_hash(h, 1), w.rows[:-1][short], w.rows[1:][short], 1) + count[short].astype(np.uint64))
    values = np.concatenate([gram_hashes(h, size)[at], whole])
    row = np.concatenate([row, short])
    order = np.argsort(values)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(n + 1))


def set_ids(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """64-bit digest of each set; with the set's size it names the set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x5851F42D4C957F2D)))])
    return mix((total[rows[1:]] - total[rows[:-1]]) ^ np.diff(rows).astype(np.uint64)).view(np.int64)


def signature_width(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: four times the power of two from its size on, within MIN_BITS..MAX_BITS.

    At fewer bits, differing elements fall together so often that pairs well below 3/4 pass the bound.
    """
    return np.clip(4 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), MIN_BITS, MAX_BITS)


def signatures(values: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Bitmaps of the parities of the sets' elements by their low bits."""
    n = np.diff(rows)
    width = signature_width(n)
    out: list[bytes] = [b""] * len(n)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        step = max(1, (1 << 22) // w)
        for k in range(0, len(own), step):
            part = own[k : k + step]
            at = np.repeat(np.arange(len(part)), n[part])
            bit = (values[ranges(rows[:-1][part], n[part])] & np.uint64(w - 1)).astype(np.int64)
            parity = (np.bincount(at * w + bit, minlength=len(part) * w) & 1).astype(np.uint8)
            for i, row in zip(part.tolist(), np.packbits(parity.reshape(len(part), w), axis=1), strict=True):
                out[i] = row.tobytes()
    return out


def folded(bitmaps: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bitmaps at a smaller width: parities of bits that fall together."""
    while bitmaps.shape[1] > n_bytes:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def bits_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Differing bits of each pair of bitmaps, at the smaller width of the two."""
    widths = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for a, b in np.unique(widths, axis=0).tolist():
        at = np.flatnonzero((widths[:, 0] == a) & (widths[:, 1] == b))
        u = np.frombuffer(b"".join([x[i] for i in at]), np.uint8).reshape(len(at), a)
        v = np.frombuffer(b"".join([y[i] for i in at]), np.uint8).reshape(len(at), b)
        small = min(a, b)
        differ = np.ascontiguousarray(folded(u, small) ^ folded(v, small)).view(np.uint64)
        out[at] = np.bitwise_count(differ).sum(1, dtype=np.int64)
    return out


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (3 * (n + m) + 6) // 7


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Length that serves every partner size up to n; larger partners need less of this set."""
    return n - overlap_needed(n, (3 * n + 3) // 4) + 1


def _scan(batches: Iterator[pa.RecordBatch], text_col: str, size: int):
    """(id array or None, values, rows) block by block."""
    for batch in batches:
        ids = batch.column("_id") if "_id" in batch.schema.names else None
        for block in blocks(batch.column(text_col)):
            values, rows = sets_of(block, size)
            yield (ids.slice(block.first, len(block)) if ids is not None else None), values, rows, len(block.data)


def describe(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(_id, n, sid, sig) of every document, and in rows with n = -1 the elements that repeat within a chunk of text:
    the element as sid, its count as _id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        names = ["_id", "n", "sid", "sig"]

        def counted() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(heads), return_counts=True)
            some = count > 1
            k = int(some.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(count[some].astype(np.int64)), pa.array(np.full(k, -1, np.int32)), pa.array(key[some].view(np.int64)), pa.nulls(k, pa.binary())],
                names,
            )

        for ids, values, rows, n_bytes in _scan(batches, text_col, size):
            n = np.diff(rows)
            sid = set_ids(values, rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int32)), pa.array(sid), pa.array(signatures(values, rows), pa.binary())], names
            )
            # Twice the prefix: marked elements make room for others.
            length = np.minimum(n, 2 * prefix_length(n))
            fresh = np.array([s not in seen and not seen.add(s) for s in sid.tolist()], bool)
            heads.append(values[ranges(rows[:-1][fresh], length[fresh])])
            held += n_bytes
            if held >= CHUNK_BYTES:
                yield counted()
                heads, held = [], 0
                seen.clear()
        if heads:
            yield counted()

    return docs.mapInArrow(run, "_id long, n int, sid long, sig binary")


def bitmap(hashes: DataFrame, column: str, n_bits: int) -> np.ndarray:
    """A bitmap with the bit of every value set; n_bits / 64 words reach the driver, whatever the table's size."""
    at = F.pmod(F.xxhash64(column), F.lit(n_bits))
    rows = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), {n_bits}) & 63 as int))").alias("b"))
    table = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(n_bits // 64, np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return out


_FIELDS = (("key", np.int64), ("sid", np.int64), ("n", np.int32), ("pos", np.int32), ("rare", np.int32), ("mark", np.int8))


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    raw = np.array([len(rows["key"])], np.int64).tobytes() + b"".join(rows[k].astype(t).tobytes() for k, t in _FIELDS)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [] for k, _ in _FIELDS}
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for k, t in _FIELDS:
            parts[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in parts.items()}


def prefixes(docs: DataFrame, marks: np.ndarray, text_col: str, size: int, n_buckets: int) -> DataFrame:
    """Prefix elements of every set, packed by bucket; sets that repeat within a chunk of text go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        seen: set[int] = set()
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            x = {k: np.concatenate([p[k] for p in parts]) for k, _ in _FIELDS}
            bucket = (x["key"].view(np.uint64) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in range(n_buckets):
                if edge[b] < edge[b + 1]:
                    mine = order[edge[b] : edge[b + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([_pack({k: v[mine] for k, v in x.items()})], pa.binary())], ["bucket", "blob"]
                    )

        for _, values, rows, n_bytes in _scan(batches, text_col, size):
            n = np.diff(rows)
            sid = set_ids(values, rows)
            row = np.repeat(np.arange(len(n)), n)
            mark = marked(values, marks)
            key = row * 2 + mark
            order = np.argsort(key.astype(np.uint16) if 2 * len(n) < 1 << 16 else key, kind="stable")
            pos = np.arange(len(values)) - np.repeat(rows[:-1], n)
            rare = n - np.diff(np.concatenate([[0], np.cumsum(mark)])[rows])
            fresh = np.array([s not in seen and not seen.add(s) for s in sid.tolist()], bool)
            take = np.flatnonzero((pos < np.repeat(prefix_length(n), n)) & np.repeat(fresh, n))
            at, r = order[take], row[take]  # a row's elements keep its places in either order
            parts.append({"key": values[at].view(np.int64), "sid": sid[r], "n": n[r], "pos": pos[take], "rare": rare[r], "mark": mark[at]})
            held += n_bytes
            if held >= CHUNK_BYTES:
                yield from out()
                parts, held = [], 0
                seen.clear()
        if parts:
            yield from out()

    return docs.mapInArrow(run, "bucket int, blob binary")


_MEETING = "kind int, a long, b long, n int, rare int, pos int"


def meet(table: pa.Table) -> pa.Table:
    """One bucket: candidate pairs (kind 0: a < b) of elements with few sets; members (kind 1: element a, set b) of the others."""
    x = _unpack(table.column("blob").to_pylist())
    order = np.lexsort((x["sid"], x["n"], x["key"]))
    x = {k: v[order] for k, v in x.items()}
    new = np.ones(len(order), bool)
    new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["sid"][1:] != x["sid"][:-1]) | (x["n"][1:] != x["n"][:-1])
    x = {k: v[new] for k, v in x.items()}
    head = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1])) if len(x["key"]) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(x["key"])))
    group_size = np.repeat(sizes, sizes)
    end = np.repeat(head + sizes, sizes)
    many = ((x["mark"] > 0) | (group_size > TILE)) & (group_size > 1)
    few = np.flatnonzero(~many & (group_size > 1))
    pairs_a, pairs_b = [], []
    step = 1
    while len(few):
        few = few[few + step < end[few]]
        # Members are in ascending size, so the first that is too large for a set ends its pairs.
        few = few[3 * x["n"][few + step].astype(np.int64) <= 4 * x["n"][few]]
        i, j = few, few + step
        small, large = x["n"][i].astype(np.int64), x["n"][j].astype(np.int64)
        need = overlap_needed(small, large)
        fits = (x["pos"][i] <= small - need) & (x["pos"][j] <= large - need)
        pairs_a.append(x["sid"][i[fits]])
        pairs_b.append(x["sid"][j[fits]])
        step += 1
    a = np.concatenate(pairs_a) if pairs_a else np.zeros(0, np.int64)
    b = np.concatenate(pairs_b) if pairs_b else np.zeros(0, np.int64)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    low, high = low[new], high[new]
    m = np.flatnonzero(many)
    zero = np.zeros(len(low), np.int32)
    columns = [
        np.concatenate([zero, np.ones(len(m), np.int32)]),
        np.concatenate([low, x["key"][m]]),
        np.concatenate([high, x["sid"][m]]),
        np.concatenate([zero, x["n"][m]]).astype(np.int32),
        np.concatenate([zero, x["rare"][m]]).astype(np.int32),
        np.concatenate([zero, x["pos"][m]]).astype(np.int32),
    ]
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b", "n", "rare", "pos"])


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a < b that the sizes and the bitmaps let through, with the first document of each set. sets: a written table."""
    pairs = slim(stage(pairs.select("a", "b").distinct(), "candidates"))
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"), F.col("first").alias(f"first_{c}"))
    both = side("a").join(pairs, "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            apart = bits_apart(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist())
            keep = (7 * apart <= n + m) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
            yield batch.select(["a", "b", "first_a", "first_b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long, first_a long, first_b long")


def wanted_arrays(pairs: DataFrame, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(sid, items) of every set of the pairs, one row each.

    Arrays are made for the wanted first documents: few ids are broadcast, many are looked up in a bitmap, which lets some
    others through. Only the array of the set's first document goes on, and only once where rows repeat.
    """
    one = lambda c: F.struct(F.col(c).alias("sid"), F.col(f"first_{c}").alias("_id"))
    wanted = stage(pairs.select(F.explode(F.array(one("a"), one("b"))).alias("w")).select("w.sid", "w._id").distinct(), "wanted")
    few = wanted.count() <= SMALL
    if few:
        texts = docs.join(F.broadcast(wanted.select("_id").distinct()), "_id", "left_semi")
    else:
        bits = bitmap(wanted, "_id", WANTED_BITS)
        texts = docs.withColumn("_bit", F.pmod(F.xxhash64("_id"), F.lit(WANTED_BITS)))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        held = 0
        for batch in batches:
            if not few:
                at = batch.column("_bit").to_numpy()
                batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for block in blocks(batch.column(text_col)):
                values, rows = sets_of(block, size)
                sid = set_ids(values, rows)
                ids = batch.column("_id").slice(block.first, len(block)).to_pylist()
                take = []
                for i, (s, d) in enumerate(zip(sid.tolist(), ids, strict=True)):
                    # A copy behind a smaller id is not the first document.
                    if d is not None and (s not in least or d < least[s]):
                        least[s] = d
                        take.append(i)
                lists = [values[rows[i] : rows[i + 1]].tobytes() for i in take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[take]), pa.array([ids[i] for i in take], pa.int64()), pa.array(lists, pa.binary())], ["sid", "_id", "items"]
                )
                held += len(block.data)
                if held >= CHUNK_BYTES:
                    least.clear()
                    held = 0

    made = texts.mapInArrow(arrays, "sid long, _id long, items binary")
    return made.join(slim(wanted), ["sid", "_id"], "left_semi").dropDuplicates(["sid"]).select("sid", "items")


def linked(pairs: DataFrame, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """The pairs whose sorted arrays have enough in common. docs: _id and text; pairs: a written table."""
    items = wanted_arrays(pairs, docs, text_col, size)
    side = lambda c, name: items.select(F.col("sid").alias(c), F.col("items").alias(name))
    both = side("a", "x").join(slim(pairs).select("a", "b"), "a").join(side("b", "y"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(u, v)
                common = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                keep.append(7 * common >= 3 * (len(u) + len(v)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.mapInArrow(test, "a long, b long"), "linked")


def still_open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets in different components."""
    known = with_components(pairs, labels)
    return known.filter("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b", "first_a", "first_b")


def joined_up(pairs: DataFrame, labels: DataFrame | None, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, component) under the links among the pairs and those behind the labels.

    Each set is first tested against its smallest partner. Then only pairs that are still in different components are.
    Where sets have few partners, all are tested at once.
    """
    pairs = stage(pairs, "pairs")
    every = lambda links: stage(components(links) if labels is None else extended(labels, links), "components")
    first = stage(pairs.groupBy("b").agg(F.min(F.struct("a", "first_a", "first_b")).alias("p")).select("p.a", "b", "p.first_a", "p.first_b"), "pairs")
    if pairs.count() <= FEW_PARTNERS * first.count():
        return every(linked(pairs, docs, text_col, size))
    labels = every(linked(first, docs, text_col, size))
    rest = pairs.join(slim(first).select("a", "b"), ["a", "b"], "left_anti")
    open_ = stage(still_open(rest, labels), "pairs")
    if open_.isEmpty():
        return labels
    return stage(extended(labels, linked(open_, docs, text_col, size)), "components")


def banded(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, sid, n, pos, early, label, outside) of the frequent elements whose sets lie in several components, with
    bands and the first EARLY such elements of each set. Members without a place get 0, which bounds nothing.

    `band` cuts all sets of a key by their rank in size, `minor_band` those outside its largest component. Sets of one
    size are ranked by hash, so a band holds about BAND sets.
    """
    if "pos" not in members.columns:
        members = members.withColumn("pos", F.lit(0))
    known = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("component", "sid"))
    sizes = known.groupBy("key", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("parts"))
    split = largest.filter("parts > 1").select("key", F.col("top.label").alias("main"))
    mixed = stage(known.join(split, "key").select("key", "sid", "n", "pos", "label", (F.col("label") != F.col("main")).alias("outside")), "mixed")
    placed = F.sort_array(F.collect_list(F.struct("pos", "key")))  # at most a set's prefix
    early = mixed.groupBy("sid").agg(F.slice(F.transform(placed, lambda e: e["key"]), 1, EARLY).alias("early"))
    # One row per key and size, so the window is bounded by the sizes that occur.
    counts = mixed.groupBy("key", "n").agg(F.count("*").alias("k"), F.sum(F.col("outside").cast("long")).alias("k_minor"))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({c: F.coalesce(F.sum(k).over(before), F.lit(0)) for c, k in (("at", "k"), ("at_minor", "k_minor"))})
    rank = lambda at, k, salt: F.floor((F.col(at) + F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(k))) / BAND).cast("int")
    return mixed.join(offsets, ["key", "n"]).join(early, "sid").select(
        "key", "sid", "n", "pos", "early", "label", "outside", rank("at", "k", 0).alias("band"), F.when(F.col("outside"), rank("at_minor", "k_minor", 1)).alias("minor_band")
    )


def tiles(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The banded members, once for every tile (key, band, against) they are compared in: a band of all sets meets the
    bands of outside sets whose sizes reach 3/4 of its own or the other way round."""
    rows = banded(members, labels)
    every = rows.groupBy("key", "band").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    minor = rows.filter("outside").groupBy("key", F.col("minor_band").alias("against")).agg(F.min("n").alias("low_m"), F.max("n").alias("high_m"))
    near = every.join(minor, "key").filter("4 * high >= 3 * low_m and 4 * high_m >= 3 * low").select("key", "band", "against")
    # Bands follow one another in size, so those that a band reaches do too.
    of_band = near.groupBy("key", "band").agg(F.min("against").alias("low"), F.max("against").alias("high"))
    of_minor = near.groupBy("key", F.col("against").alias("minor_band")).agg(F.min("band").alias("low"), F.max("band").alias("high"))
    reach = F.explode(F.sequence("low", "high"))
    return (
        rows.join(of_band, ["key", "band"])
        .select("key", "sid", "n", "pos", "early", "label", F.lit(False).alias("outside"), "band", reach.alias("against"))
        .union(
            rows.filter("outside").join(of_minor, ["key", "minor_band"])
            .select("key", "sid", "n", "pos", "early", "label", F.lit(True).alias("outside"), reach.alias("band"), F.col("minor_band").alias("against"))
        )
    )


def across(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets that share a frequent element, lie in different components, and pass the bounds.

    A linked pair is found at the first element it shares, where both sets have enough elements left; a pair that shares
    one of its early elements before the tile's is left to that one.
    """
    placed = tiles(members, labels).join(sets.select("sid", "sig"), "sid")

    def tile(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy()
        sid, n, pos, label = (table.column(c).to_numpy() for c in ("sid", "n", "pos", "label"))
        n = n.astype(np.int64)
        left = n - pos
        key = table.column("key")[0].as_py()
        lists = table.column("early").to_pylist()
        early = np.zeros((len(sid), EARLY), np.int64)
        filled = np.zeros((len(sid), EARLY), bool)
        for k, keys in enumerate(lists):
            before = keys[: keys.index(key)] if key in keys else keys
            early[k, : len(before)], filled[k, : len(before)] = before, True
        raw = table.column("sig").to_pylist()
        width = np.array([len(r) for r in raw])
        place = np.zeros(len(raw), np.int64)
        maps = {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            place[own] = np.arange(len(own))
            maps[w] = np.frombuffer(b"".join([raw[k] for k in own]), np.uint8).reshape(len(own), w)
        rows = np.flatnonzero(~outside)
        rows = rows[np.argsort(n[rows], kind="stable")]
        sizes_ = n[rows]
        low, high = [], []
        for i in np.flatnonzero(outside):
            a, b = np.searchsorted(sizes_, [(3 * n[i] + 3) // 4, 4 * n[i] // 3 + 1])
            near = rows[a:b]
            need = overlap_needed(n[near], n[i])
            near = near[(label[near] != label[i]) & (left[near] >= need) & (left[i] >= need)]
            sooner = ((early[near][:, :, None] == early[i][filled[i]]) & filled[near][:, :, None]).any((1, 2))
            near = near[~sooner]
            apart = np.zeros(len(near), np.int64)
            for w in np.unique(width[near]).tolist():
                some = np.flatnonzero(width[near] == w)
                small = min(w, int(width[i]))
                one = folded(maps[int(width[i])][place[i]][None], small)
                differ = np.ascontiguousarray(folded(maps[w][place[near[some]]], small) ^ one).view(np.uint64)
                apart[some] = np.bitwise_count(differ).sum(1, dtype=np.int64)
            near = near[7 * apart <= n[near] + n[i]]
            low.append(np.minimum(sid[near], sid[i]))
            high.append(np.maximum(sid[near], sid[i]))
        none = [np.zeros(0, np.int64)]
        return pa.Table.from_arrays([pa.array(np.concatenate(low + none)), pa.array(np.concatenate(high + none))], ["a", "b"])

    return placed.groupBy("key", "band", "against").applyInArrow(tile, "a long, b long")


def groups(
    docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: set size and the smallest id reachable by links."""
    n_buckets = n_buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_col)
    described = stage(describe(texts, text_col, size), "sets")
    rows = described.filter("n >= 0")
    # Equal sets are one node; its first document is the smallest id.
    sets = stage(rows.filter("n > 0").groupBy("sid").agg(F.max("n").alias("n"), F.first("sig").alias("sig"), F.min("_id").alias("first")).filter("first is not null"), "nodes")
    marks = frequent(described.filter("n < 0").select(F.col("sid").alias("key"), F.col("_id").alias("n")), FREQUENT)
    met = stage(prefixes(texts, marks, text_col, size, n_buckets).groupBy("bucket").applyInArrow(meet, _MEETING), "meetings")
    members = met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("sid"), "n", "rare", "pos")
    pivots = members.groupBy("key").agg(F.min(F.struct("rare", "n", "sid")).alias("p")).select("key", F.col("p.sid").alias("p"))
    stars = members.join(pivots, "key").filter("sid <> p").select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b"))
    candidates = met.filter("kind = 0").select("a", "b").union(stars)
    labels = joined_up(bounded(candidates, sets), None, texts, text_col, size)
    more = stage(across(members, sets, labels), "across")
    if not more.isEmpty():
        labels = joined_up(bounded(more, sets), labels, texts, text_col, size)
    of_set = sets.join(labels, sets["sid"] == labels["node"], "left").select("sid", "first", F.coalesce("component", "sid").alias("c"))
    least = of_set.groupBy("c").agg(F.min("first").alias("component_id"))
    named = of_set.join(least, "c").select("sid", "component_id")
    return (
        rows.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "sid")
        .join(named, "sid", "left")
        .select(id_col, "n_shingles", F.when((F.col("n_shingles") > 0) & F.col(id_col).isNotNull(), F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))
    )
