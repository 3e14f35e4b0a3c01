"""Toxicity of texts behind noisy-channel deobfuscation.

Channel. A word with a digit or sign next to a letter, a letter three times in a row, or three letters alone between gaps,
and a run of three or more words of one character, becomes a lattice: a letter stands for itself, a sign for the letters
it imitates, for itself or for nothing, a letter of a run of three for itself or nothing, a gap for nothing or for the
edge of a word. Viterbi decoding finds the path with the best sum of channel costs and a character trigram model, which
is counted over the words of every document and prices the edges too. Other words have a single path and are left alone.

Score. Features of the restored text are letter runs and their beginnings of 4 to 7 bytes, each with the number of
times a text has it (once, twice, four times or more). A feature counts if its share of toxic texts is beyond chance: the
likelihood ratio statistic against the share of all texts passes twice the log of the number of features that
MIN_SUPPORT toxic texts have, so less than one feature in all passes by luck. Its weight is the lower confidence
bound of its log likelihood ratio between toxic and other texts, zero when negative. A text's evidence is the largest
weight and the log sum of all; a logistic curve over the two, fitted on training rows that gave no weights, turns them
into a probability.

Null and empty texts have no evidence and get the curve's value there. Rows without a label or with a null label teach
nothing; a document with several labels is toxic if any says so. With no toxic or no clean training rows every text
gets the same score. Bounds: MAX_FEATURES weights (those with the highest bound), FIT_ROWS rows for the curve (those with the
smallest hash of their id). The trigram counts, the feature counts and the scoring cover all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.arrays import Block, blocks, mix, prefix_hash, ranges, span_hash, with_columns, words
from cartlens.llm.frames import schema_with
from cartlens.llm.lookup import HashTable
from cartlens.session import stage

BEGINNINGS = (4, 5, 6, 7)
TIMES = (1, 2, 4)
MIN_SUPPORT = 3
CONFIDENCE = 2.0
MAX_FEATURES = 200_000
FIT_ROWS = 20_000
BITMAP_BITS = 1 << 24

# Letters that a digit or sign imitates.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y",
}
IMITATION_COST, DROP_SIGN_COST, DROP_REPEAT_COST, DROP_SEPARATOR_COST = 0.7, 9.0, 3.0, 0.2
KEEP_SIGN_COST, SPACE_EDGE_COST, GAP_EDGE_COST = 4.0, 0.2, 3.0
_SEPARATORS = frozenset(" .-_*~'`,:;/\\")

# Character codes of the language model: 0 the word's edge, 1 to 26 the letters, 27 anything else.
N_CODES = 28
_CODE = np.full(256, 0, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "0123456789@$!|+("]] = True
_LETTER = _CODE > 0
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in ".-_*~"]] = True


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts [before-last, last, next] over the letter runs of all texts; N_CODES cubed sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CODES**3, np.int64)
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                n = len(block.data)
                code = np.zeros(n + len(block) + 2, np.int32)  # an edge behind every row
                code[np.arange(n) + 2 + np.repeat(np.arange(len(block)), np.diff(block.offsets))] = _CODE[block.data]
                a, b, c = code[:-2], code[1:-1], code[2:]
                a = np.where(b == 0, 0, a)
                some = (b > 0) | (c > 0)
                total += np.bincount(((a * N_CODES + b) * N_CODES + c)[some], minlength=N_CODES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    table = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N_CODES**3)
    out[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(N_CODES, N_CODES, N_CODES)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Trigram model interpolated with the bigram model."""
    pairs = counts.sum(0) + 0.1
    pairs /= pairs.sum(1, keepdims=True)
    seen = counts.sum(2, keepdims=True)
    return np.log((counts + 8 * pairs[None]) / (seen + 8))


@dataclass
class Channel:
    """Decoder with its language model."""

    log_p: np.ndarray

    def __post_init__(self) -> None:
        self.table = self.log_p.tolist()
        self.known: dict[str, str] = {}

    def options(self, word: str, i: int) -> list[tuple[str, float]]:
        c = word[i]
        if c.isalpha():
            out = [(c, 0.0)]
            if i and word[i - 1] == c and (word[i - 2 : i - 1] == c or word[i + 1 : i + 2] == c):
                out.append(("", DROP_REPEAT_COST))
            return out
        if c.isspace():
            return [("", DROP_SEPARATOR_COST), (" ", SPACE_EDGE_COST)]
        if c in _SEPARATORS:
            return [("", DROP_SEPARATOR_COST), (" ", GAP_EDGE_COST)]
        return [(x, IMITATION_COST) for x in IMITATED.get(c, "")] + [("", DROP_SIGN_COST), (c, KEEP_SIGN_COST)]

    def decode(self, word: str) -> str:
        """The best letters for a lower-case word; recent answers are kept."""
        if word not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[word] = self.best(word)
        return self.known[word]

    def best(self, word: str, costs: list[float] | None = None) -> str:
        """The cheapest path's letters; its cost is appended to costs."""
        p = self.table
        # State: the last two letters' codes; value: cost, and the letters as a linked list.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(word)):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, cost in self.options(word, i):
                for (a, b), (so_far, path) in states.items():
                    if letter and not letter.isalpha():  # a word's edge, or a sign that stays
                        if letter == " " and not b:
                            continue
                        key, value, way = (0, 0), so_far + cost - (p[a][b][0] if b else 0.0), (letter, path)
                    elif letter:
                        c = _code(letter)
                        key, value, way = (b, c), so_far + cost - p[a][b][c], (letter, path)
                    else:
                        key, value, way = (a, b), so_far + cost, path
                    if key not in new or value < new[key][0]:
                        new[key] = (value, way)
            states = new
        ends = ((v - (p[a][b][0] if b else 0.0), way) for (a, b), (v, way) in sorted(states.items(), key=lambda x: x[0]))
        cost, path = min(ends, key=lambda x: x[0])
        if costs is not None:
            costs.append(cost)
        out = []
        while path is not None:
            letter, path = path
            out.append(letter)
        return "".join(reversed(out))


def suspects(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that need decoding: single words, and runs of three or more words of one character."""
    w = words(block)
    none = np.zeros(0, np.int64)
    if len(w.start) == 0:
        return none, none
    data = block.data
    letter, sign = _LETTER[data], _SIGN[data]
    body = letter | sign
    # A sign next to a letter, or a letter three times.
    odd = np.zeros(len(data) + 1, bool)
    odd[:-2] |= (sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:])
    low = data | 0x20
    odd[:-3] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    inside = np.zeros(len(data) + 1, bool)  # bytes of a word that have another byte of it behind them
    inside[:-1][ranges(w.start, w.end - w.start - 1)] = True
    marks = _sums(odd[:-1] & inside[:-1])
    # Letters or signs alone between gaps or the word's ends.
    gap = _GAP[data]
    alone = body.copy()
    alone[1:] &= gap[:-1] | ~inside[:-2]
    alone[:-1] &= gap[1:] | ~inside[:-2]
    alone, letters, bodies = _sums(alone), _sums(letter), _sums(body)
    some = letters[w.end] > letters[w.start]
    spaced = alone[w.end] - alone[w.start] >= 3
    has = some & ((marks[w.end] > marks[w.start]) | spaced) & (bodies[w.end] - bodies[w.start] >= 3)
    # Runs of words of one character.
    one = (w.end - w.start == 1) & (bodies[w.end] - bodies[w.start] == 1)
    row = w.row_of()
    new = np.ones(len(one) + 1, bool)
    new[1:-1] = (one[1:] != one[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    run = np.flatnonzero((np.diff(head) >= 3) & one[head[:-1]])
    first, last = w.start[head[run]], w.end[head[run + 1] - 1]
    some = letters[last] > letters[first]
    start = np.concatenate([w.start[has], first[some]])
    end = np.concatenate([w.end[has], last[some]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def _sums(marks: np.ndarray) -> np.ndarray:
    """Number of marks before each place."""
    return np.concatenate([[0], np.cumsum(marks)])


def restored(block: Block, channel: Channel) -> Block:
    """The block with its suspect words decoded; what stands around a word's letters and signs stays."""
    start, end = suspects(block)
    if len(start) == 0:
        return block
    parts, offsets, at, size = [], [0], 0, 0
    raw = block.data.tobytes()
    edges = block.offsets.tolist()
    k, spans = 0, list(zip(start.tolist(), end.tolist(), strict=True))
    for i in range(len(block)):
        at = edges[i]
        while k < len(spans) and spans[k][0] < edges[i + 1]:
            a, b = spans[k]
            word = raw[a:b].decode("utf-8", "replace")
            core = word.strip("\"'.,:;!?()[]{}#%&*-_=<>/\\ ")
            # An opening sign may stand for a letter: $tupid, !diot, (lown.
            at_word = word.find(core) if core else 0
            if core and at_word and word[at_word - 1] in "!(":
                core, at_word = word[at_word - 1] + core, at_word - 1
            if core:
                text = word[:at_word] + channel.decode(core.lower()) + word[at_word + len(core) :]
                parts += [raw[at:a], text.encode()]
                size += a - at + len(parts[-1])
                at = b
            k += 1
        parts.append(raw[at : edges[i + 1]])
        size += edges[i + 1] - at
        offsets.append(size)
    return Block(block.first, np.frombuffer(b"".join(parts), np.uint8), np.asarray(offsets, np.int64), block.valid)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every letter run and of its beginnings."""
    n = len(block.data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.where((block.data >= 65) & (block.data <= 90), block.data + np.uint8(32), block.data)
    inside = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[block.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(block.offsets, start, "right") - 1
    h = prefix_hash(data)
    rows, out = [row], [mix(span_hash(h, start, end))]
    for k in BEGINNINGS:
        some = end - start > k
        rows.append(row[some])
        out.append(mix(span_hash(h, start[some], start[some] + k) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(out)


def counted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times) of the distinct pairs."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))


@dataclass
class Weights:
    """weight[i, t]: weight of feature i seen TIMES[t] times or more."""

    table: HashTable
    weight: np.ndarray

    def evidence(self, block: Block) -> np.ndarray:
        """[row, 2]: largest weight and log sum."""
        out = np.zeros((len(block), 2))
        row, h = features(block)
        at = self.table.get(h)
        row, at, times = counted(row[at >= 0], at[at >= 0])
        if len(row):
            w = np.zeros(len(row))
            for t, least in enumerate(TIMES):
                w = np.where(times >= least, np.maximum(w, self.weight[at, t]), w)
            np.maximum.at(out[:, 0], row, w)
            out[:, 1] = np.log1p(np.bincount(row, w, len(block)))
        return out


@dataclass
class ToxicityModel:
    channel: Channel
    weights: Weights
    curve: np.ndarray  # constant, largest weight, log sum

    def scores(self, block: Block) -> tuple[Block, np.ndarray]:
        clear = restored(block, self.channel)
        return clear, 1 / (1 + np.exp(-(self.curve[0] + self.weights.evidence(clear) @ self.curve[1:])))


def bitmap(places: DataFrame) -> np.ndarray:
    """Bitmap of the places in column `at`, 0 to BITMAP_BITS - 1; at most BITMAP_BITS / 64 words reach the driver."""

    def words_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            one = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(one.view(np.int64))], ["w", "b"])

    table = places.mapInArrow(words_, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def labelled(docs: DataFrame, labels: DataFrame, text_col: str) -> DataFrame:
    """(id, text, toxic) of documents with a label. docs: id, text. A bitmap of fixed size keeps most others from the join."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    at = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    bits = bitmap(known.select(at.alias("at")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            yield batch.filter(pa.array(in_bitmap(bits, at))).select(["id", "text"])

    rows = docs.filter("id is not null").select("id", F.col(text_col).alias("text"), at.alias("at"))
    # Labels grow with the documents, so both sides are dealt by id at every size.
    return rows.mapInArrow(listed, "id long, text string").join(known.hint("merge"), "id")


def train(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """docs: all documents, for the language model; train_docs: those whose labels may be used."""
    channel = Channel(log_probabilities(count_trigrams(docs, text_col)))
    rows = stage(labelled(train_docs.select(F.col(id_col).cast("long").alias("id"), text_col), labels, text_col).withColumn(
        "fits", F.pmod(F.xxhash64("id"), F.lit(3)) == 0), "labelled")
    weighing = rows.filter("not fits")
    shared = docs.sparkSession.sparkContext.broadcast(channel)
    totals = {r["toxic"]: r["n"] for r in weighing.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(channel, Weights(HashTable(np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.zeros((0, len(TIMES)))), np.zeros(3))

    def counted_features(bits: np.ndarray | None):
        """Function from texts to (h, t, n), the texts of a block with a feature; only features in the bitmap, if there is one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column("text")):
                    row, h = features(restored(block, shared.value))
                    if bits is not None:
                        some = in_bitmap(bits, (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64))
                        row, h = row[some], h[some]
                    _, key, times = counted(row, h)
                    for t, least in enumerate(TIMES):
                        key_t, n = np.unique(key[times >= least], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key_t.view(np.int64)), pa.array(np.full(len(key_t), t, np.int32)), pa.array(n)], ["h", "t", "n"]
                        )

        return run

    kind = "h long, t int, n long"
    toxic = weighing.filter("toxic").select("text").mapInArrow(counted_features(None), kind)
    frequent = stage(toxic.groupBy("h", "t").agg(F.sum("n").alias("k")).filter(F.col("k") >= MIN_SUPPORT), "features")
    bits = bitmap(frequent.select((F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("at")))
    clean = weighing.filter("not toxic").select("text").mapInArrow(counted_features(bits), kind)
    both = frequent.join(clean.groupBy("h", "t").agg(F.sum("n").alias("c")).hint("merge"), ["h", "t"], "left").na.fill(0, ["c"])
    k, c, share = F.col("k"), F.col("c"), n_toxic / (n_toxic + n_clean)
    beyond = lambda n, part: F.when(n > 0, n * F.log(n / ((k + c) * part))).otherwise(0.0)
    ratio = F.log((k + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    bound = ratio - CONFIDENCE * F.sqrt(1 / (k + 0.5) + 1 / (c + 0.5))
    chance = math.log(max(frequent.count(), 1))
    strong = both.withColumn("bound", bound).filter((F.col("bound") > 0) & (beyond(k, share) + beyond(c, 1 - share) >= chance))
    table = strong.orderBy(F.desc("bound"), "h", "t").limit(MAX_FEATURES).toArrow()
    hashes, at = np.unique(table.column("h").to_numpy().view(np.uint64), return_inverse=True)
    weight = np.zeros((len(hashes), len(TIMES)))
    weight[at, table.column("t").to_numpy()] = table.column("bound").to_numpy()
    weights = Weights(HashTable(hashes, np.arange(len(hashes))), weight)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                e = weights.evidence(restored(block, shared.value))
                y = batch.column("toxic").slice(block.first, len(block))
                k = batch.column("k").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([k, pa.array(e[:, 0]), pa.array(e[:, 1]), y], ["k", "a", "b", "toxic"])

    # Numbers are ordered and cut, never texts: first the hash up to which rows are needed, then their evidence.
    fits = rows.filter("fits").withColumn("k", F.xxhash64("id", F.lit(1)))
    last = fits.select("k").orderBy("k").limit(FIT_ROWS).agg(F.max("k")).first()[0]
    fit_rows = fits.filter(F.col("k") <= F.lit(last)).select("k", "text", "toxic")
    fit = fit_rows.mapInArrow(evidence, "k long, a double, b double, toxic boolean").orderBy("k", "a", "b").limit(FIT_ROWS).toArrow()
    x = np.stack([fit.column("a").to_numpy(), fit.column("b").to_numpy()], 1)
    return ToxicityModel(channel, weights, fit_curve(x, fit.column("toxic").to_numpy().astype(float)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, with a pull towards (-2, 1, 0)."""
    z = np.column_stack([np.ones(len(x)), x])
    prior = np.array([-2.0, 1.0, 0.0])
    b = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (y - p) - ridge * (b - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3), gradient)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity", restored_col: str | None = "restored_text"
) -> DataFrame:
    """Add the probability that the text is toxic and, unless restored_col is None, the restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [(score_col, T.DoubleType())] + ([(restored_col, T.StringType())] if restored_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                clear, p = model.scores(block)
                new = {score_col: pa.array(p, pa.float64())}
                if restored_col:
                    new[restored_col] = pa.array([clear.text(i) for i in range(len(clear))], pa.string())
                yield with_columns(batch.slice(block.first, len(block)), new)

    return docs.mapInArrow(run, schema_with(docs, added))
