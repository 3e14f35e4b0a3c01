"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than PIECE_CHARS are cut before they reach the splitting pattern, only where a white-space character
follows another kind of character: no match of the pattern has white space behind its first character unless it is all
white space, and the pattern never looks back, so the matches on both sides are those of the whole text. A stretch
without such a place stays whole. Decoding joins the tokens' raw bytes; it never goes through text, so ids that end in
the middle of a character survive.

Null and empty texts give no ids and empty bytes. Rows, ties and other columns pass through; a column that has an
output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlens.llm.arrays import blocks, with_columns
from cartlens.llm.frames import schema_with

#: Length from which a text is cut, in characters.
PIECE_CHARS = 1 << 16

# White space of tiktoken's engine: Python's also holds U+001C to U+001F.
_SAFE_CUT = re.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """The encoding of a rank file: a base64 token and its rank on each line. Loaded once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts whose pattern matches together are those of the text."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def text_ids(encoding, text: str) -> np.ndarray:
    if len(text) <= PIECE_CHARS:
        return encoding.encode_to_numpy(text).astype(np.int32, copy=False)
    return np.concatenate([encoding.encode_to_numpy(p) for p in safe_pieces(text)]).astype(np.int32, copy=False)


def encode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    bytes_col: str | None = None,
) -> DataFrame:
    """Add the token ids of the whole text as an array of int and, in bytes_col, what these ids decode to.

    Decoding in the same pass keeps one Python worker per task; `decode` is for ids that are stored.
    """
    added = [(ids_col, T.ArrayType(T.IntegerType()))] + ([(bytes_col, T.BinaryType())] if bytes_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(rank_file, pattern)
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                ids = [text_ids(encoding, block.text(i)) for i in range(len(block))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                new = {ids_col: lists}
                if bytes_col:
                    new[bytes_col] = pa.array([encoding.decode_bytes(x.tolist()) for x in ids], pa.binary())
                yield with_columns(batch.slice(block.first, len(block)), new)

    return docs.mapInArrow(run, schema_with(docs, added))


def decode(
    docs: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded"
) -> DataFrame:
    """Add the bytes that the ids stand for; null ids give empty bytes, an unknown id fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(rank_file, pattern)
        for batch in batches:
            lists = batch.column(ids_col)
            step = 256
            for i in range(0, len(lists), step):
                part = [x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else [] for x in lists[i : i + step]]
                raw = pa.array([encoding.decode_bytes(ids) for ids in part], pa.binary())
                yield with_columns(batch.slice(i, len(part)), {bytes_col: raw})

    return docs.mapInArrow(run, schema_with(docs, [(bytes_col, T.BinaryType())]))
