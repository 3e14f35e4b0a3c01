"""Documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

# Names that operators use for their own columns.
CLASHES = ["_id", "_th", "id", "n", "sid", "sig", "h", "rank", "part", "bucket", "blob", "host", "path", "token_ids", "_runs", "component"]


def make_words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return ["".join(rng.choices("abcdefghié", k=rng.randint(1, 7))) if rng.random() < 0.5 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(40):
        texts.append(rng.choice([" ", "\n", "  \t"]).join(make_words(rng, rng.randint(1, 400))))
    base = make_words(rng, 300)
    for k in range(25):  # near copies of one text, and of one another
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = " ".join(make_words(rng, 120))
    for _ in range(10):  # a shared passage in different surroundings, once twice in one text
        texts.append(" ".join(make_words(rng, 150)) + " " + passage + " " + " ".join(make_words(rng, 100)))
    texts.append(passage + " middle " + passage)
    texts += [texts[0]] * 5 + [None, "", " ", "\t\n ", "one", "two words", "a b c d", "é", "!!! 123", "ab " * 900, "x" * 3000, "ABC def " * 40 + "Ghi"]
    texts.append(" ".join(make_words(rng, 20000)))  # long
    texts.append("nospace" * 20000)
    ids: list[int | None] = rng.sample(range(-5, 10**6), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Several partitions, with extra columns whose names clash."""
    wide = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])
    return spark.createDataFrame([(i, t, *(["z"] * len(CLASHES))) for i, t in rows], wide).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def save(tmp_path_factory, spark):
    """Write tables of documents, labels, pages and benchmark to a folder that queries can read."""

    def write(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
