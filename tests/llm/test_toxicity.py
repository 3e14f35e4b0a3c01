"""Disguises, decoding against all paths, and weights against a plain recount."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import toxicity
from cartlens.llm.arrays import block_of

PROSE = (
    "the river runs by the old stone house and a man said that it is a good idea to go home. what an idiot he was, they said, "
    "and a moron too; shut the door and do not hate people, i think that a stupid ass is better than no answer at all. "
) * 3


@pytest.fixture(scope="module")
def channel(spark):
    docs = spark.createDataFrame([(i, PROSE) for i in range(50)], "doc_id long, text string")
    return toxicity.Channel(toxicity.log_probabilities(toxicity.count_trigrams(docs)))


def clear(text: str, channel) -> str:
    return toxicity.restored(block_of([text.encode()]), channel).data.tobytes().decode()


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [
        ("idio7", "idiot"), ("hat3", "hate"), ("a$$", "ass"), ("5h17", "shit"), ("1d107", "idiot"), ("i..d..i..o..t", "idiot"),
        ("s h u", "shu"), ("a i d i o t", "a idiot"), ("i d i o t m o r o n", "idiot moron"), ("t h e i d i o t", "the idiot"),
        ("m0r0n", "moron"), ("$tupid", "stupid"), ("(stupid)", "(stupid)"), ("stop!", "stop!"), ("covid19", "covid19"),
        ("idiot$$$", "idiot$$$"), ("1 2 3", "1 2 3"), ("12 34", "12 34"), ("e.g.", "e.g."), ("x1", "x1"), ("", ""),
    ],
)
def test_disguises(channel, disguised, plain):
    assert clear(disguised, channel) == plain
    assert clear(f"the house {disguised} the door", channel) == f"the house {plain} the door"


def brute_best(channel, word: str) -> float:
    """Cost of the cheapest of all paths."""
    p, best = channel.table, math.inf
    for path in itertools.product(*(channel.options(word, i) for i in range(len(word)))):
        a = b = 0
        total = 0.0
        for letter, cost in path:
            total += cost
            if letter and not letter.isalpha():
                if letter == " " and not b:
                    total = math.inf
                total -= p[a][b][0] if b else 0.0
                a = b = 0
            elif letter:
                c = toxicity._code(letter)
                total -= p[a][b][c]
                a, b = b, c
        best = min(best, total - (p[a][b][0] if b else 0.0))
    return best


def test_viterbi_equals_all_paths(channel):
    rng = random.Random(3)
    for _ in range(150):
        word = "".join(rng.choice("aidot01573$ .é") for _ in range(rng.randint(1, 7)))
        costs: list[float] = []
        channel.best(word, costs)
        assert costs[0] == pytest.approx(brute_best(channel, word)), word


def test_weights_equal_a_recount(spark):
    rng = random.Random(8)
    vocabulary = ["river", "stones", "ideas", "rounded", "streets", "lighter"]
    rows, labels = [], []
    for i in range(500):
        toxic = rng.random() < 0.2
        words = rng.choices(vocabulary, k=12) + rng.choices(["grumbok", "snarlit"] if toxic else ["paper", "corner"], k=rng.randint(0, 5))
        words += [f"rare{rng.choice('abcdefgh')}x"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    fits = {r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).select("doc_id").collect()}
    is_toxic = dict(labels)
    counts = {True: Counter(), False: Counter()}
    n = Counter(bool(is_toxic[i]) for i, _ in rows if i not in fits)
    for i, text in rows:
        if i not in fits:
            runs = re.findall("[a-z]+", text)
            seen = Counter(runs) + Counter((k, w[:k]) for w in runs for k in toxicity.BEGINNINGS if len(w) > k)
            counts[bool(is_toxic[i])].update((f, t) for f, times in seen.items() for t in toxicity.TIMES if times >= t)
    candidates = {f: k for f, k in counts[True].items() if k >= toxicity.MIN_SUPPORT}
    share, want = n[True] / sum(n.values()), []
    for f, k in candidates.items():
        c = counts[False][f]
        beyond = sum(x * math.log(x / ((k + c) * part)) for x, part in ((k, share), (c, 1 - share)) if x)
        ratio = math.log((k + 0.5) / (n[True] + 1)) - math.log((c + 0.5) / (n[False] + 1))
        bound = ratio - toxicity.CONFIDENCE * math.sqrt(1 / (k + 0.5) + 1 / (c + 0.5))
        if bound > 0 and beyond >= math.log(len(candidates)):
            want.append(bound)
    got = np.sort(model.weights.weight[model.weights.weight > 0])
    assert len(want) > 5 and got == pytest.approx(np.sort(want))


def test_rare_evidence_counts_at_any_size(spark):
    """A word in 12 of 6,000 toxic texts and in no other is learnt; a word in 4 toxic texts and as many others is not."""
    rows = [(i, ("river stone " + ("vexlor " if i < 48 and i % 4 == 0 else "") + ("plinth " if i % 1500 == 1 else ""))) for i in range(12_000)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("k", F.lit("y"))
    model = toxicity.train(docs, docs, labels)
    found = model.weights.evidence(block_of([b"river stone vexlor", b"river stone plinth", b"river"]))[:, 0]
    assert found[0] > 0 and found[1] == found[2] == 0
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxicity", "restored_text"] and scored.filter("toxic <> 'x' or k <> 'y'").count() == 0
