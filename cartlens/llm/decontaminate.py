"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Index. Terms are runs of ASCII letters, digits and non-ASCII bytes; letters of
ASCII and Latin-1 count in lower case. An item's score for a passage is the
BM25 sum over the terms they share, divided by the item's score for itself, so 1 means that every term is there and one
THRESHOLD serves all items. Items stand in blocks of BLOCK; each term keeps its largest impact in every block.

Query. A document is cut into passages of two strides, one stride apart; a stride is at least MIN_STRIDE words and not
shorter than the longest item, so every copy of an item lies whole in some passage. As in block-max WAND, a passage's
terms are ordered by their largest impact. The longest run of weak terms whose impacts stay below WEAK_PART of the
threshold cannot lift an item over it alone, so only the lists of the other terms are opened. A block is scored only if its largest impacts
for them, plus those of the weak terms, reach the threshold. All items at or above the threshold are retrieved.

Verification. An item's answer is its last sentence, or the last quarter of its words if it has only one; the question
is the rest. A hit needs MIN_OVERLAP of the word triples of both (single words if there are fewer than three) in the
passage.

The index is read in shards of at most SHARD_TERMS postings, with the statistics of all items, and each shard is queried
by every document; one shard at a time travels to the tasks. Null and empty texts and items match nothing; items that
repeat are found each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.arrays import Block, Words, blocks, gram_hashes, mix, prefix_hash, ranges, span_hash
from cartlens.llm.lookup import HashTable
from cartlens.session import stage

K1, B = 1.2, 0.75
THRESHOLD = 0.6
MIN_OVERLAP = 0.6
MIN_STRIDE = 64
BLOCK = 4
#: Part of the threshold that the terms whose lists stay closed may reach together.
WEAK_PART = 0.25
SHARD_TERMS = 1_000_000

_TERM = np.zeros(256, np.uint8)
_TERM[48:58] = np.arange(48, 58)
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def terms(block: Block) -> tuple[np.ndarray, Words]:
    """Hash of every term, and the terms' places."""
    n = len(block.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), Words(none, none, np.zeros(len(block) + 1, np.int64))
    data = _TERM[block.data]
    # Capital letters of Latin-1, C3 80 to C3 9E in UTF-8 but for the multiplication sign.
    second = np.flatnonzero(block.data[:-1] == 0xC3) + 1
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    data[capital] += 0x20
    inside = data > 0
    cut = np.zeros(n + 1, bool)
    cut[block.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix(span_hash(prefix_hash(data), start, end)), Words(start, end, np.searchsorted(start, block.offsets))


def answer_start(block: Block, i: int, w: Words) -> int:
    """Number of question terms in row i."""
    a, b = int(w.rows[i]), int(w.rows[i + 1])
    n = b - a
    for k in range(n - 2, 0, -1):
        gap = block.data[w.end[a + k] : w.start[a + k + 1]].tobytes()
        if any(c in gap for c in b".!?\n"):
            return k + 1
    return n - max(1, n // 4)


def triples(h: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(h, 3) if len(h) >= 3 else h)


@dataclass
class Index:
    """One shard. Terms are numbered by ascending largest impact."""

    numbers: HashTable  # from a term's hash to its number
    largest: np.ndarray  # by term number
    list_start: np.ndarray  # by term number, into the block lists
    list_block: np.ndarray
    list_impact: np.ndarray
    post_key: np.ndarray  # term number * blocks + block, ascending
    post_item: np.ndarray
    post_impact: np.ndarray
    n_blocks: int
    ids: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]


def item_terms(items: DataFrame) -> DataFrame:
    """One row per item with terms: item_id, len, and as bytes its terms, their counts, question and answer triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for block in blocks(batch.column("text")):
                h, w = terms(block)
                rows: list[tuple] = []
                for i in range(len(block)):
                    own = h[w.rows[i] : w.rows[i + 1]]
                    if len(own):
                        k = answer_start(block, i, w)
                        term, count = np.unique(own, return_counts=True)
                        question, answer = triples(own[:k] if k else own), triples(own[k:])
                        rows.append((ids[block.first + i].as_py(), len(own), len(term), *(x.astype(t).tobytes() for x, t in (
                            (term, np.uint64), (count, np.int32), (question, np.uint64), (answer, np.uint64)))))
                kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "len", "n", "terms", "counts", "question", "answer"])

    return items.mapInArrow(run, "item_id long, len int, n int, terms binary, counts binary, question binary, answer binary")


def document_frequencies(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column("terms").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64))], ["term"])

    return rows.mapInArrow(run, "term long").groupBy("term").agg(F.count("*").alias("df"))


def build_index(rows: pa.Table, df: tuple[np.ndarray, np.ndarray], n_items: int, mean_len: float) -> Index:
    """rows: item rows of one shard; df: (terms, counts) with terms ascending as unsigned."""
    join = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
    term, count = join("terms", np.uint64), join("counts", np.int32)
    size = rows.column("n").to_numpy()
    item = np.repeat(np.arange(len(size)), size)
    length = rows.column("len").to_numpy()[item]
    n_with = df[1][np.searchsorted(df[0], term)]
    idf = np.log1p((n_items - n_with + 0.5) / (n_with + 0.5))
    impact = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean_len))
    impact = impact / np.bincount(item, impact, len(size))[item]
    hashes, at = np.unique(term, return_inverse=True)
    largest = np.zeros(len(hashes))
    np.maximum.at(largest, at, impact)
    order = np.argsort(largest, kind="stable")
    number = np.empty(len(hashes), np.int64)
    number[order] = np.arange(len(hashes))
    n_blocks = max(1, math.ceil(len(size) / BLOCK))
    key = number[at] * n_blocks + item // BLOCK
    by = np.argsort(key, kind="stable")
    lists, first = np.unique(key[by], return_index=True)
    return Index(
        HashTable(hashes, number),
        largest[order],
        np.searchsorted(lists, np.arange(len(hashes) + 1) * n_blocks),
        lists % n_blocks,
        np.maximum.reduceat(impact[by], first) if len(first) else impact[by],
        key[by],
        item[by],
        impact[by],
        n_blocks,
        np.asarray(rows.column("item_id").to_pylist(), dtype=object),
        [np.frombuffer(x, np.uint64) for x in rows.column("question").to_pylist()],
        [np.frombuffer(x, np.uint64) for x in rows.column("answer").to_pylist()],
    )


def passages(rows: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first term, end) of every passage: two strides long, one stride apart, together the whole row."""
    n = np.diff(rows)
    count = np.where(n > 0, np.maximum(-(-n // stride) - 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    start = rows[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return row, start, np.minimum(start + 2 * stride, rows[row + 1])


def retrieve(index: Index, h: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all pairs whose score reaches the threshold."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    n_terms = len(index.largest)
    if len(h) == 0 or n_terms == 0 or len(start) == 0:
        return none
    number = index.numbers.get(h)
    passage = np.repeat(np.arange(len(start)), end - start)
    of = number[ranges(start, end - start)]
    known = of >= 0
    pairs = np.sort(passage[known] * n_terms + of[known])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    passage, term = pairs // n_terms, pairs % n_terms  # by passage, then ascending largest impact
    edge = np.searchsorted(passage, np.arange(len(start) + 1))
    total = np.concatenate([[0.0], np.cumsum(index.largest[term])])
    so_far = total[1:] - total[edge[:-1]][passage]
    strong = so_far >= WEAK_PART * threshold
    if not strong.any():
        return none
    weak = np.bincount(passage[~strong], index.largest[term[~strong]], len(start))
    s = np.flatnonzero(strong)
    length = index.list_start[term[s] + 1] - index.list_start[term[s]]
    entry = ranges(index.list_start[term[s]], length)
    at = np.repeat(passage[s], length) * index.n_blocks + index.list_block[entry]
    if len(start) * index.n_blocks <= 4 * len(at):
        bound = np.bincount(at, index.list_impact[entry], len(start) * index.n_blocks)
        key = np.flatnonzero(bound)
        bound = bound[key]
    else:
        key, inverse = np.unique(at, return_inverse=True)
        bound = np.bincount(inverse, index.list_impact[entry], len(key))
    bound += weak[key // index.n_blocks]
    key = key[bound >= threshold - 1e-9]
    if len(key) == 0:
        return none
    # Full scores of the blocks that are left: all terms of the passage, weak ones too.
    p, b = key // index.n_blocks, key % index.n_blocks
    n = edge[p + 1] - edge[p]
    want = term[ranges(edge[p], n)] * index.n_blocks + np.repeat(b, n)
    low, high = np.searchsorted(index.post_key, want), np.searchsorted(index.post_key, want, "right")
    entry = ranges(low, high - low)
    n_items = len(index.ids)
    pair, inverse = np.unique(np.repeat(np.repeat(p, n), high - low) * n_items + index.post_item[entry], return_inverse=True)
    score = np.bincount(inverse, index.post_impact[entry], len(pair))
    keep = score >= threshold - 1e-9
    return pair[keep] // n_items, pair[keep] % n_items, score[keep]


def share(wanted: np.ndarray, there: np.ndarray, single: np.ndarray) -> float:
    """Part of the wanted triples, or of the single terms where an item has fewer than three, that are there."""
    return float(max(np.isin(wanted, there).mean(), np.isin(wanted, single).mean())) if len(wanted) else 1.0


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): every document with every item it contains, once, with the
    figures of its best passage."""
    spark = docs.sparkSession
    rows = stage(item_terms(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))), "items")
    facts = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.max("len").alias("longest"), F.sum("n").alias("terms")).first()
    n_shards = max(1, math.ceil((facts["terms"] or 0) / SHARD_TERMS))
    stride = max(MIN_STRIDE, facts["longest"] or 0)
    counts = document_frequencies(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = []
    for k in range(n_shards):
        shard = rows.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_shards)) == k)
        own = document_frequencies(shard).select("term")
        df = counts.join(own, "term", "left_semi").toArrow()
        term = df.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        index = build_index(shard.toArrow(), (term[order], df.column("df").to_numpy()[order]), facts["n"], facts["mean"] or 1.0)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("id").to_pylist()
                for block in blocks(batch.column("text")):
                    h, w = terms(block)
                    row, start, end = passages(w.rows, stride)
                    best: dict[tuple, tuple] = {}
                    for p, i, score in zip(*(x.tolist() for x in retrieve(index, h, start, end, threshold)), strict=True):
                        own = h[start[p] : end[p]]
                        there = gram_hashes(own, 3)
                        q, a = share(index.question[i], there, own), share(index.answer[i], there, own)
                        if q >= min_overlap and a >= min_overlap:
                            pair = int(row[p]), i
                            best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (score, q, a))
                    hits = sorted(best.items())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[block.first + r] for (r, _), _ in hits], pa.int64()), pa.array([index.ids[i] for (_, i), _ in hits], pa.int64())]
                        + [pa.array([v[k] for _, v in hits], pa.float64()) for k in range(3)],
                        ["id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found.append(texts.mapInArrow(run, "id long, item_id long, score double, question_overlap double, answer_overlap double"))
    return reduce(DataFrame.union, found).withColumnRenamed("id", id_col)
