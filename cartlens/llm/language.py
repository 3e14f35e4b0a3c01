"""Language identification as mixture inference: each document is a blend of languages with unknown shares.

A language is a smoothed distribution over hashed byte trigrams of lower-cased words, counted over every labelled
training row. A document is cut into runs of RUN_WORDS words; expectation-maximisation estimates the shares under
which the runs' trigram likelihoods are largest. It runs for the best one, two, ... languages (by their shares under
all of them), and the set with the best Bayesian information criterion stays.

Words are runs of ASCII letters and non-ASCII bytes. A text without a letter, an empty or a null text is `und` with
score 0; so is every text where there is nothing to learn from. Ties go to the language whose name sorts first.
Training rows with a null text or language teach nothing. The model holds at most languages x BUCKETS counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.arrays import Block, blocks, with_columns
from cartlens.llm.frames import schema_with

BUCKETS = 1 << 16
RUN_WORDS = 4
ROUNDS = 6
SMOOTHING = 0.5
UNKNOWN = "und"

#: Byte as it counts for a trigram: lower-case ASCII letter, non-ASCII byte, or a space.
_LETTER = np.full(256, 0x20, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """log_p[i, b]: log probability of trigram bucket b in languages[i]."""

    languages: list[str]
    log_p: np.ndarray


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, index of each word's first letter, and words per row as ranges."""
    n = len(block.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(block) + 1, np.int64)
    now = _LETTER[block.data]
    before = np.empty_like(now)
    before[0] = 0x20
    before[1:] = now[:-1]
    after = np.empty_like(now)
    after[-1] = 0x20
    after[:-1] = now[1:]
    edges = block.offsets[1:-1]
    before[edges[edges < n]] = 0x20
    after[edges[edges > 0] - 1] = 0x20
    letter = np.flatnonzero(now != 0x20)
    code = (before[letter] << np.uint32(16)) | (now[letter] << np.uint32(8)) | after[letter]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(before[letter] == 0x20)
    return bucket, first, np.searchsorted(letter[first], block.offsets)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams per language over all rows; only the sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(lang_col).to_pylist()
            for block in blocks(batch.column(text_col)):
                bucket, first, rows = trigrams(block)
                own = names[block.first : block.first + len(block)]
                here = sorted(set(own))
                of_row = np.searchsorted(here, own)
                ends = np.append(first, len(bucket))[rows]
                lang = np.repeat(of_row, np.diff(ends))
                found = np.bincount(lang * BUCKETS + bucket, minlength=len(here) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(here, found, strict=True):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))],
                ["lang", "bucket", "n"],
            )

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = np.asarray(table.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        at = np.searchsorted(languages, list(names))
        counts[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    smooth = counts + SMOOTHING
    return LanguageModel(languages, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32))


def shares(runs: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS):
    """Mixture shares of each document and its log likelihood.

    runs[k, i]: likelihood of run i in language k, relative to the run's best; starts: first run of each document;
    allowed[k, d]: whether document d may use language k.
    """
    sizes = np.diff(np.append(starts, runs.shape[1]))
    pi = allowed / allowed.sum(0)
    for _ in range(rounds):
        part = runs * np.repeat(pi, sizes, axis=1)
        part /= np.maximum(part.sum(0), 1e-30)
        pi = np.add.reduceat(part, starts, axis=1) / sizes
    total = (runs * np.repeat(pi, sizes, axis=1)).sum(0)
    return pi, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts)


def infer(block: Block, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Shares [language, row] under the chosen set of languages, zero for rows without words; and which rows have any."""
    bucket, first, rows = trigrams(block)
    out = np.zeros((len(model.languages), len(block)), np.float32)
    has = np.diff(rows) > 0
    if not has.any() or not model.languages:
        return out, has
    position = np.arange(len(first)) - np.repeat(rows[:-1], np.diff(rows))
    heads = np.flatnonzero(position % RUN_WORDS == 0)
    logs = np.stack([np.add.reduceat(row[bucket], first[heads]) for row in model.log_p])
    runs = np.exp(logs - logs.max(0))
    starts = np.searchsorted(heads, rows[:-1][has])
    sizes = np.diff(np.append(starts, len(heads)))
    full, _ = shares(runs, starts, np.ones((len(runs), len(starts)), np.float32))
    rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
    best = np.full(len(starts), np.inf)
    chosen = full
    for k in range(1, len(runs) + 1):
        pi, fit = shares(runs, starts, (rank < k).astype(np.float32), ROUNDS if k > 1 else 0)
        cost = -2 * fit + 2 * (k - 1) * np.log(np.maximum(sizes, 2))
        better = cost < best
        chosen = np.where(better, pi, chosen)
        best = np.where(better, cost, best)
    out[:, has] = chosen
    return out, has


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    lang_col: str = "lang_pred",
    score_col: str = "lang_score",
    mix_col: str = "lang_mix",
) -> DataFrame:
    """Add the language with the largest share, that share, and all chosen languages as `name:share`, largest first."""
    wanted = [(lang_col, T.StringType()), (score_col, T.DoubleType()), (mix_col, T.ArrayType(T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                pi, has = infer(block, model)
                ascii_letter = np.zeros(len(block) + 1, np.int64)
                letters = np.flatnonzero((_LETTER[block.data] >= 97) & (block.data < 128))
                ascii_letter = np.diff(np.searchsorted(letters, block.offsets)) > 0
                known = has & (len(model.languages) > 0)
                for i in np.flatnonzero(known & ~ascii_letter):
                    known[i] = any(map(str.isalpha, block.text(i)))
                top = pi.argmax(0) if len(pi) else np.zeros(len(block), int)
                names, scores, mixes = [], [], []
                for i in range(len(block)):
                    if known[i]:
                        names.append(model.languages[top[i]])
                        scores.append(min(1.0, float(pi[top[i], i])))
                        order = np.argsort(-pi[:, i], kind="stable")
                        mixes.append([f"{model.languages[k]}:{pi[k, i]:.3f}" for k in order if pi[k, i] > 0])
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        mixes.append([])
                yield with_columns(
                    batch.slice(block.first, len(block)),
                    {
                        lang_col: pa.array(names, pa.string()),
                        score_col: pa.array(scores, pa.float64()),
                        mix_col: pa.array(mixes, pa.list_(pa.string())),
                    },
                )

    return docs.mapInArrow(run, schema_with(docs, wanted))
