"""Alignment of two tokenizers over a corpus: which tokens of one stand for which of the other, and how often.

1. Each text is encoded by both; where tokens of both end at the same byte, the text is cut into groups. Every token of A
   in a group is linked with every one of B. Within a group equal tokens are counted first, so a long group costs its
   different pairs, not all occurrences.
2. Inverted lists: a block holds up to BLOCK_ENTRIES (document, pair) entries and at most 65,536 documents. For every pair
   of token ids it has a bitmap of the block's documents: sorted 16-bit numbers where few are set, else plain bits. Links
   that a document has more than once are kept in planes: plane k marks documents where bit k of the repeats is set. The
   parts of a block are or-ed together, and the bits counted: documents and links of each pair, a row per block and pair.
3. These counts are summed over the corpus and marked where they are the highest of their A id. They return to the blocks
   that hold the pair; there the lists turn them into two sums for each document.

A pair in every document has one row per block, so no task sees a pair's documents; memory of a task is a block, or the
longest text. Texts that are null, empty, or that one tokenizer does not give back byte by byte have no tokens: zeros and
empty groups. Rows that share an id are documents of their own. The text leaves the rows, other columns pass through; a
column that has an output's name is replaced. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.arrays import Block, blocks, ranges
from cartlens.llm.bpe import text_ids
from cartlens.llm.frames import schema_with, set_aside
from cartlens.session import stage

#: Entries after which a block is closed, documents it can number, and pairs that are laid out at once.
BLOCK_ENTRIES = 1 << 21
BLOCK_ROWS = 1 << 16
_PAIRS_AT_ONCE = 1 << 20

#: A pair is one number: the A id above these bits, the B id in them.
B_BITS = 15

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_OWN = [
    ("_block", T.LongType()),
    ("_row", T.IntegerType()),
    *((c, T.LongType()) for c in _COUNTS),
    ("groups", T.StringType()),
    ("_pair", T.IntegerType()),
    ("_docs", T.LongType()),
    ("_links", T.LongType()),
    ("_lists", T.BinaryType()),
]


class Side(NamedTuple):
    """One tokenizer: a function from texts to ids, whether these give every text back, and each id's bytes, their number
    and its decimal texts."""

    encode: object
    exact: bool
    raw: list[bytes]
    size: np.ndarray
    inner: np.ndarray
    last: np.ndarray


def _side(encode, raw: list[bytes], end: str, exact: bool = False) -> Side:
    numbers = [str(i) for i in range(len(raw))]
    texts = [np.array([n + sign for n in numbers], object) for sign in (",", end)]
    return Side(encode, exact, raw, np.array([len(r) for r in raw], np.int64), *texts)


@lru_cache(maxsize=2)
def byte_side(path: str, pattern: str | None = None) -> Side:
    """Byte-level BPE of a tokenizers file; texts get a space in front. Loaded once per Python worker.

    With the pattern that the file's byte-level rule splits by, and merges that stand in the order of their ids, tiktoken
    gives the same ids from the file's vocabulary in a quarter of the time. Otherwise the tokenizers library encodes.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    vocabulary, added = model["model"]["vocab"], model.get("added_tokens") or []
    # Bytes that print stand for themselves, the others for the code points from 256 on, in order.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    raw = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in added)]))
    for token in added:
        raw[token["id"]] = token["content"].encode()
    for entry, i in vocabulary.items():
        raw[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()

    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    single = sum(len(entry) == 1 and i < 256 for entry, i in vocabulary.items())
    in_order = single == 256 and all(vocabulary.get(x + y) == 256 + i for i, (x, y) in enumerate(pairs))
    if pattern and in_order and model["normalizer"] is None:
        import tiktoken

        ranks = {raw[i]: i for i in range(256 + len(pairs))}
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _side(lambda texts: [text_ids(encoding, " " + t) for t in texts], raw, "|", exact=True)

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return _side(encode, raw, "|")


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """Sentence pieces with byte fallback; the model puts the space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return _side(lambda texts: [np.array(ids, np.int32) for ids in model.encode(texts, num_threads=1)], raw, ";")


class Aligned(NamedTuple):
    """Per row: counts and the text of its groups. Entries: pair, row and links, by row, then pair."""

    counts: np.ndarray
    groups: list[str]
    pair: np.ndarray
    row: np.ndarray
    links: np.ndarray


def align(block: Block, a: Side, b: Side) -> Aligned:
    """Both encodings of every row of a block, its groups, and the links of its different pairs."""
    n = len(block)
    texts = [block.text(i) for i in range(n)]
    full = [i for i in range(n) if texts[i]]
    nothing = np.zeros(0, np.int32)
    ids = {"a": [nothing] * n, "b": [nothing] * n}
    if full:
        some = [texts[i] for i in full]
        for i, one, other in zip(full, a.encode(some), b.encode(some), strict=True):
            raw = b" " + block.raw(i)
            if all(side.exact or b"".join(map(side.raw.__getitem__, x.tolist())) == raw for side, x in ((a, one), (b, other))):
                ids["a"][i], ids["b"][i] = one, other
    n_a, n_b = (np.array([len(x) for x in ids[side]], np.int64) for side in "ab")
    flat_a, flat_b = (np.concatenate(ids[side]).astype(np.int64) for side in "ab")
    end_a, end_b = np.cumsum(a.size[flat_a]), np.cumsum(b.size[flat_b])
    place = np.searchsorted(end_b, end_a)
    cut_a, cut_b = end_b[place] == end_a if len(end_b) else np.zeros(0, bool), np.zeros(len(end_b), bool)
    cut_b[place[cut_a]] = True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    row = np.repeat(np.arange(n), n_a)[cut_a]  # row of each group
    in_a, in_b = np.bincount(group_a, minlength=len(row)), np.bincount(group_b, minlength=len(row))
    counts = np.zeros((n, 4), np.int64)
    counts[:, 0], counts[:, 1] = n_a, n_b
    counts[:, 2] = np.bincount(row, minlength=n)
    np.add.at(counts[:, 3], row, in_a * in_b)
    return Aligned(counts, _texts(a, b, flat_a, flat_b, group_a, group_b, in_a, in_b, n_a + n_b), *_entries(flat_a, flat_b, group_a, group_b, row, len(row)))


def _texts(a, b, flat_a, flat_b, group_a, group_b, in_a, in_b, per_row) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of every row; empty without tokens."""
    out = np.empty(len(flat_a) + len(flat_b), object)
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    out[np.arange(len(flat_a)) + (np.cumsum(in_b) - in_b)[group_a]] = np.where(last_a, a.last[flat_a], a.inner[flat_a])
    out[np.arange(len(flat_b)) + np.cumsum(in_a)[group_b]] = np.where(last_b, b.last[flat_b], b.inner[flat_b])
    ends = np.cumsum(per_row).tolist()
    return ["".join(out[s:e].tolist())[:-1] for s, e in zip([0, *ends], ends, strict=False)]


def _entries(flat_a, flat_b, group_a, group_b, row, n_groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, row and links of every different pair of a row."""
    (key_a, times_a), (key_b, times_b) = (np.unique(g << 17 | x, return_counts=True) for g, x in ((group_a, flat_a), (group_b, flat_b)))
    of_b = np.bincount(key_b >> 17, minlength=n_groups)
    begin_b = np.cumsum(of_b) - of_b
    group = key_a >> 17
    width = of_b[group]
    parts = []
    for part in np.split(np.arange(len(key_a)), np.flatnonzero(np.diff(np.cumsum(width) // _PAIRS_AT_ONCE)) + 1):
        left = np.repeat(part, width[part])
        right = ranges(begin_b[group[part]], width[part])
        key = row[group[left]] << 32 | (key_a[left] & 0x1FFFF) << B_BITS | key_b[right] & 0x1FFFF
        parts.append(_summed(key, times_a[left] * times_b[right]))
    key, links = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if len(parts) > 1 else parts[0]
    return (key & 0xFFFFFFFF).astype(np.int64), (key >> 32).astype(np.int64), links


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different keys and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(value, first) if len(first) else value


@dataclass
class Plane:
    """For lists 0..n - 1 the documents marked in each: sparse ones as numbers, dense ones as bits."""

    sparse_size: np.ndarray
    sparse: np.ndarray
    dense: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, lists: np.ndarray, rows: np.ndarray, n_lists: int, n_rows: int) -> Plane:
        """Or all marks (list, row) together; they may come in any order and repeatedly."""
        key = np.sort(lists << 16 | rows)
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        lists, rows = key >> 16, key & 0xFFFF
        count = np.bincount(lists, minlength=n_lists)
        wide = -(-n_rows // 8)
        dense = np.flatnonzero(2 * count > wide)
        place = np.full(n_lists, -1)
        place[dense] = np.arange(len(dense))
        to_bits = place[lists] >= 0
        bits = np.zeros((len(dense), wide), np.uint8)
        np.bitwise_or.at(bits, (place[lists[to_bits]], rows[to_bits] >> 3), (128 >> (rows[to_bits] & 7)).astype(np.uint8))
        size = np.where(place >= 0, 0, count)
        return cls(size.astype(np.uint32), rows[~to_bits].astype(np.uint16), dense.astype(np.uint32), bits)

    def counts(self) -> np.ndarray:
        """Documents in each list."""
        out = self.sparse_size.astype(np.int64)
        out[self.dense] = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        return out

    def marks(self) -> np.ndarray:
        """All marks as list << 16 | row, ascending."""
        sparse = np.repeat(np.arange(len(self.sparse_size)), self.sparse_size) << 16 | self.sparse
        at, row = np.nonzero(np.unpackbits(self.bits, axis=1)) if len(self.bits) else (np.zeros(0, np.int64),) * 2
        return np.sort(np.concatenate([sparse, self.dense[at].astype(np.int64) << 16 | row]))


@dataclass
class Lists:
    """Inverted lists of a block: ascending pairs, their documents, and planes of the links beyond the first."""

    pairs: np.ndarray
    docs: Plane
    planes: list[Plane]

    @classmethod
    def merged(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_rows: int) -> Lists:
        """The (pair, row, links) entries of a block's parts, whose rows differ, or-ed into one set of lists."""
        pair, row, links = (np.concatenate(x) for x in zip(*parts, strict=True))
        pairs, at = np.unique(pair, return_inverse=True)
        more = links - 1
        top = int(more.max()).bit_length() if len(more) else 0
        planes = []
        for k in range(top):
            on = (more >> k & 1).astype(bool)
            planes.append(Plane.of(at[on], row[on], len(pairs), n_rows))
        return cls(pairs, Plane.of(at, row, len(pairs), n_rows), planes)

    def links(self) -> np.ndarray:
        return self.docs.counts() + sum(plane.counts() << k for k, plane in enumerate(self.planes))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the pair, row and links of every entry."""
        marks = self.docs.marks()
        links = np.ones(len(marks), np.int64)
        for k, plane in enumerate(self.planes):
            links[np.searchsorted(marks, plane.marks())] += 1 << k
        return marks >> 16, marks & 0xFFFF, links

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = [self.pairs.astype(np.uint32)]
        for plane in (self.docs, *self.planes):
            arrays += [plane.sparse_size, plane.sparse, plane.dense, plane.bits]
        for array in arrays:
            np.save(out, array, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Lists:
        source, arrays = io.BytesIO(data), []
        while source.tell() < len(data):
            arrays.append(np.load(source, allow_pickle=False))
        planes = [Plane(*arrays[i : i + 4]) for i in range(1, len(arrays), 4)]
        return cls(arrays[0].astype(np.int64), planes[0], planes[1:])


@dataclass
class Alignment:
    """docs: the rows with n_a, n_b, n_groups, n_links, groups, n_best, count_sum. pairs: a_id, b_id, n_docs, n_links, is_best."""

    docs: DataFrame
    pairs: DataFrame


def _invert(batches: Iterator[pa.RecordBatch], kept: list[str], schema: pa.Schema, text_col: str, sides, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of documents, then for each block its pairs' counts and its lists, in columns of their own."""
    a, b = sides()
    part, number, n_rows, parts, n_entries = TaskContext.get().partitionId(), 0, 0, [], 0

    def record(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block_id(n: int) -> pa.Array:
        return pa.array(np.full(n, part << 32 | number, np.int64))

    def closed() -> Iterator[pa.RecordBatch]:
        lists = Lists.merged(parts, n_rows)
        docs, links = lists.docs.counts(), lists.links()
        for i in range(0, len(lists.pairs), 1 << 16):
            cut = slice(i, i + (1 << 16))
            n = len(docs[cut])
            yield record(n, {"_block": block_id(n), "_pair": pa.array(lists.pairs[cut]), "_docs": pa.array(docs[cut]), "_links": pa.array(links[cut])})
        yield record(1, {"_block": block_id(1), "_lists": pa.array([lists.dump()], pa.binary())})

    for batch in batches:
        for block in blocks(batch.column(text_col)):
            if parts and (n_rows + len(block) > BLOCK_ROWS or n_entries >= BLOCK_ENTRIES):
                yield from closed()
                number, n_rows, parts, n_entries = number + 1, 0, [], 0
            found = align(block, a, b)
            texts = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.groups] if digest else found.groups
            own = batch.slice(block.first, len(block))
            columns = {c: own.column(c) for c in kept} | {c: pa.array(found.counts[:, i]) for i, c in enumerate(_COUNTS)}
            columns |= {"_block": block_id(len(block)), "_row": pa.array(np.arange(n_rows, n_rows + len(block))), "groups": pa.array(texts, pa.string())}
            yield record(len(block), columns)
            parts.append((found.pair, found.row + n_rows, found.links))
            n_rows, n_entries = n_rows + len(block), n_entries + len(found.pair)
    if parts:
        yield from closed()


def _scores(counts: pa.Table, lists: pa.Table) -> pa.Table:
    """Sums over the links of every document of a block."""
    kinds = pa.schema([("_block", pa.int64()), ("_row", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    if not lists.num_rows or not counts.num_rows:
        return kinds.empty_table()
    held = Lists.load(lists.column("_lists")[0].as_py())
    order = np.argsort(counts.column("_pair").to_numpy())
    docs, best = (counts.column(c).to_numpy()[order] for c in ("_docs", "is_best"))
    at, row, links = held.entries()
    sums = np.zeros((2, int(row.max()) + 1), np.int64)
    np.add.at(sums[0], row, links * best[at].astype(np.int64))
    np.add.at(sums[1], row, links * docs[at])
    block = np.full(sums.shape[1], lists.column("_at")[0].as_py(), np.int64)
    return pa.table([pa.array(block), pa.array(np.arange(len(block), dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], schema=kinds)


def alignment(
    docs: DataFrame, byte_file: str, piece_file: str, pattern: str | None = None, text_col: str = "text", digest: bool = False
) -> Alignment:
    """Align the tokens of a byte-level tokenizers file (A) and of a sentencepiece model (B) over all texts.

    pattern: what A's byte-level rule splits by, for a faster encoder of the same ids.

    digest: groups as lowercase hexadecimal SHA-256 instead of the text; empty stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    outputs = [*_COUNTS, "groups", "n_best", "count_sum"]
    own, back = set_aside(docs.drop(*(c for c in outputs if c != text_col)), "_block", "_row", "_pair", "_docs", "_links", "_lists")
    kept = [c for c in own.columns if c != text_col]
    spark_schema = schema_with(own.drop(text_col), _OWN)
    for field in spark_schema.fields:
        field.nullable = True
    arrow = to_arrow_schema(spark_schema)
    sides = lambda: (byte_side(byte_file, pattern), piece_side(piece_file))
    made = stage(own.mapInArrow(lambda it: _invert(it, kept, arrow, text_col, sides, digest), spark_schema), "alignment")

    counted = made.filter("_pair IS NOT NULL").select("_block", "_pair", "_docs", "_links")
    totals = counted.groupBy("_pair").agg(F.sum("_docs").alias("_docs"), F.sum("_links").alias("_links"))
    totals = stage(totals.withColumn("a_id", F.shiftright("_pair", B_BITS)), "pair-counts")
    highest = totals.groupBy("a_id").agg(F.max("_docs").alias("_most"))  # at most one row per entry of the vocabulary
    known = totals.join(F.broadcast(highest), "a_id").withColumn("is_best", F.col("_docs") == F.col("_most"))
    returned = counted.select("_block", "_pair").join(known.select("_pair", "_docs", "is_best"), "_pair")
    lists = made.filter("_lists IS NOT NULL").select(F.col("_block").alias("_at"), "_lists")
    scores = returned.groupBy("_block").cogroup(lists.groupBy("_at")).applyInArrow(_scores, "_block long, _row int, n_best long, count_sum long")
    rows = made.filter("_row IS NOT NULL").drop("_pair", "_docs", "_links", "_lists").join(scores, ["_block", "_row"], "left")
    pairs = known.select(
        "a_id",
        F.col("_pair").bitwiseAND((1 << B_BITS) - 1).alias("b_id"),
        F.col("_docs").alias("n_docs"),
        F.col("_links").alias("n_links"),
        "is_best",
    )
    return Alignment(back(rows.select(*kept, *outputs[:-2], *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in outputs[-2:]))), pairs)
