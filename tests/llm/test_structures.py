"""Conversation trie, source mix and token alignment against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from cartlens.functions import joins
from cartlens.llm import alignment, fingerprint, mixing, queries, trie
from cartlens.llm.queries_alignment import vocabularies
from cartlens.llm.queries_trie import rebuilt
from samples import corpus, docs, empty, rows  # noqa: F401  fixtures

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("part", T.StringType()),  # a name the operator uses
        T.StructField("depth", T.StringType()),
    ]
)


# --- trie ---


def brute_trie(paths: dict[int, list[tuple[str, str]]]) -> dict:
    members = collections.defaultdict(list)
    for c, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = {}
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = [c for c in who if len(paths[c]) == len(prefix)]
        out[(who[0], len(prefix))] = (
            members[prefix[:-1]][0] if prefix else None,
            len(who),
            children[prefix],
            sum(children[p] == 0 for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(900), 120):
        n = rng.choice([1, 2, 3, 5, 9, 20])
        texts = [rng.choice(["hi", "hi", "hi", "é😀", "", None]) for _ in range(n)]
        out += [(c, t if t else None, rng.choice(["user", None]) if t % 2 else "user", x, "z", "z") for t, x in enumerate(texts)]
    out += [(c, t, "user", "same " * t, "z", "z") for c in range(1000, 1060) for t in range(30)]  # a large group of copies
    out += [(5000, t, "bot", f"t{t % 7}", "z", "z") for t in range(400)]  # long
    out += [(5001, t, "bot", f"t{t % 7}", "z", "z") for t in range(390)]
    out += [(None, 1, "user", "no conversation", "z", "z"), (7001, 3, "a", "x", "z", "z"), (7001, 3, "a", "x", "z", "z")]
    return out


def own_turns(rows) -> dict[int, list[tuple[str, str]]]:
    paths = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            paths[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(p)] for c, p in paths.items()}


def found_nodes(df) -> dict:
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shards", [1, 3, 40, None])
def test_trie_equals_brute_force(spark, shards):
    rows = conversations(shards or 0)
    paths = trie.sequences(spark.createDataFrame(rows, TURNS).repartition(6))
    assert found_nodes(trie.nodes(paths, shards)) == brute_trie(own_turns(rows))


def test_trie_of_rebuilt_conversations(spark):
    rows = conversations(11)
    own = own_turns(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not p for p in want.values()) and any(c % 100 and len(want[c]) != len(own[c]) for c in own)
    assert found_nodes(trie.nodes(rebuilt(trie.sequences(spark.createDataFrame(rows, TURNS))), 5)) == brute_trie(want)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.nodes(trie.sequences(none)).collect() == []
    only = spark.createDataFrame([(3, None, None, None, "z", "z"), (None, 1, "a", "b", "z", "z")], TURNS)
    digest = hashlib.sha256(b"3").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert found_nodes(trie.nodes(trie.sequences(only))) == {(3, 0): (None, 1, 1, 1, 0, digest[1]), (3, 1): (3, 1, 0, 1, 0, digest[0])}


def test_shared_turns_of_sorted_rows():
    rng = np.random.default_rng(3)
    paths = [rng.integers(0, 2, rng.integers(0, 30)).tolist() for _ in range(300)] + [[]] * 3
    length = np.array([len(p) for p in paths])
    hashes = np.repeat(np.concatenate([np.array(p, np.int64) for p in paths]), 2).reshape(-1, 2)
    conv = rng.permutation(len(paths))
    order, shared = trie._sort(conv, np.cumsum(length) - length, length, hashes)
    ranked = sorted(range(len(paths)), key=lambda i: (paths[i], conv[i]))
    assert order.tolist() == ranked
    for k in range(1, len(paths)):
        a, b = paths[order[k - 1]], paths[order[k]]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# --- mix ---

MIX = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("_hash", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("weight", T.IntegerType()),
    ]
)


def filled(sizes: list[int], weights: list[float], budget: float, epochs: float) -> list[float]:
    """Targets by bisection over the common rate."""
    low, high = 0.0, 1e12
    for _ in range(200):
        rate = (low + high) / 2
        if sum(min(s * epochs, rate * w) for s, w in zip(sizes, weights, strict=True)) < budget:
            low = rate
        else:
            high = rate
    return [min(s * epochs, high * w) for s, w in zip(sizes, weights, strict=True)]


def mix_rows(rng) -> list[tuple]:
    out = []
    for k, source in enumerate(["a", "b", "c", "Z", "é", "", "tiny", None, "large"]):
        for _ in range({"tiny": 1, "large": 400}.get(source, 20 + k)):
            out.append((rng.randrange(10**6), " ".join(["w"] * rng.randrange(60)) + rng.choice(["", "\t", "\n x"]), source, 1, "t", 2))
    out += [(None, None, "a", 1, "t", 2), (None, "", None, 1, "t", 2), (4, "long " * 20000, "b", 1, "t", 2)]
    out += [(77, "copy of a row", "copies", 1, "t", 2)] * 50  # one key for a whole source
    out += [(5, None, "void", 1, "t", 2)]
    return out


def test_mix_meets_targets(spark):
    rows = mix_rows(random.Random(5))
    df = spark.createDataFrame(rows, MIX).repartition(7)
    weights = mixing.cyclic_weights(df, [1, 2, 3])
    got = mixing.mix(df, weights, 3.0, seed=1)
    assert sorted(got.columns) == sorted(["doc_id", "source", "_hash", "weight", "size", "source_size", "target", "taken"])
    out = got.collect()
    assert len(out) == len(rows)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sources]
    assert {r["source"]: r["weight"] for r in weights.collect()} == {s: i % 3 + 1 for i, s in enumerate(sources)}
    for s, size, target in zip(sources, sizes, filled(sizes, [i % 3 + 1 for i in range(len(sources))], sum(sizes), 3), strict=True):
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size}
        assert all(r["target"] == pytest.approx(target, rel=1e-9, abs=1e-6) and 0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= (50 if s == "copies" else 0.5 + 1e-6)
        assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in mine) or s == "copies" or sum(r["taken"] % max(r["size"], 1) > 0 for r in mine) <= 1
    again = mixing.mix(df.repartition(3), weights, 3.0, seed=1).collect()
    key = lambda r: (r["source"] or "", r["source"] is None, r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_mix_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame(mix_rows(random.Random(6)), MIX)
    weights = mixing.cyclic_weights(df, [2, 5])
    key = lambda r: tuple(str(r[c]) for c in sorted(r.asDict()))
    want = sorted(map(key, mixing.mix(df, weights).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(key, mixing.mix(df, weights).collect())) == want


def test_mix_budgets_and_weights(spark, empty):  # noqa: F811
    df = spark.createDataFrame([(1, "a b c d", "x", 1, "", 1), (2, "a b", "y", 1, "", 1), (3, "a", "z", 1, "", 1)], MIX)
    weights = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "source string, weight double")
    taken = lambda budget, epochs: {r["doc_id"]: r["taken"] for r in mixing.mix(df, weights, epochs, budget=budget).collect()}
    assert taken(100, 2.0) == {1: 8, 2: 4, 3: 0}  # the limits are below the budget; z has no weight
    assert taken(6, 2.0) == {1: 3, 2: 3, 3: 0}
    assert taken(0, 2.0) == {1: 0, 2: 0, 3: 0}
    assert mixing.mix(empty, mixing.cyclic_weights(empty, [1, 2, 3])).collect() == []


# --- alignment ---


def brute_alignment(texts: list[str | None]):
    """Straight from the definition, with every pair of occurrences; A by the tokenizers library."""
    a, b = alignment.byte_side(vocabularies()[0]), alignment.piece_side(vocabularies()[1])
    rows, held, total = [], collections.Counter(), []
    for text in texts:
        ids = [side.encode([text])[0] if text else np.zeros(0, int) for side in (a, b)]
        if text and any(b"".join(side.raw[i] for i in one.tolist()) != b" " + text.encode() for side, one in zip((a, b), ids, strict=True)):
            ids = [np.zeros(0, int)] * 2
        spans = []
        for side, one in zip((a, b), ids, strict=True):
            ends = np.cumsum([len(side.raw[i]) for i in one]).tolist()
            spans.append(ends)
        cuts = sorted(set(spans[0]) & set(spans[1]))
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            for i, end in zip(ids[k].tolist(), spans[k], strict=True):
                groups[next(g for g, c in enumerate(cuts) if end <= c)][k].append(i)
        links = collections.Counter((x, y) for one, other in groups for x in one for y in other)
        held.update(links.keys())
        total.append(links)
        joined = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups)
        rows.append((len(ids[0]), len(ids[1]), len(cuts), links.total(), joined))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    sums = [(sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items())) for links in total]
    counts = {(x, y): (n, sum(t[x, y] for t in total), n == most[x]) for (x, y), n in held.items()}
    return [(*r, *s) for r, s in zip(rows, sums, strict=True)], counts


SIGNS = ["<|endoftext|> in a text", "</s> <s>", "日本語のテキスト", "a▁b", "  two  spaces ", "tab\there", "é combining", " x", "ﬁ ligature", "Ａ wide", "\x00\x01", "😀😀😀" * 30, "x" * 500, "ab" * 300, "Ω≈ç√∫", "a\r\nb", "﻿bom", "0" * 400]


def test_alignment_equals_brute_force(spark, monkeypatch):
    texts = [t[:1500] if t else t for _, t in corpus()] + SIGNS + [SIGNS[2]] * 3
    monkeypatch.setattr(alignment, "_PAIRS_AT_ONCE", 50)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_block", T.StringType()), T.StructField("n_a", T.StringType())])
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(texts)], schema).repartition(4)
    want, counts = brute_alignment(texts)
    found = alignment.alignment(df, *vocabularies())
    assert "_block" in found.docs.columns and "text" not in found.docs.columns
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")) for r in found.docs.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(r[0] > 0 for r in want) > 100 and sum(bool(t) and r[0] == 0 for t, r in zip(texts, want, strict=True)) >= 1
    assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"], r["is_best"]) for r in found.pairs.collect()} == counts


def test_alignment_over_several_blocks(spark, rows):  # noqa: F811
    """Blocks of a few entries, in the process itself: Spark's workers keep the bound of the module."""
    _, want = brute_alignment([t for _, t in rows[:60]])
    sides = alignment.byte_side(vocabularies()[0], vocabularies()[2]), alignment.piece_side(vocabularies()[1])
    held, links = collections.Counter(), collections.Counter()
    for part in ([t for _, t in rows[:20]], [t for _, t in rows[20:60]]):
        block = alignment.Block(0, np.frombuffer("".join(t or "" for t in part).encode(), np.uint8), np.cumsum([0, *(len((t or "").encode()) for t in part)]), np.ones(len(part), bool))
        found = alignment.align(block, *sides)
        lists = alignment.Lists.merged([(found.pair, found.row, found.links)], len(part))
        again = alignment.Lists.load(lists.dump())
        at, row, n = again.entries()
        assert (again.pairs[at] << 20 | row).tolist() == sorted((found.pair << 20 | found.row).tolist())
        assert n.sum() == found.links.sum() == found.counts[:, 3].sum()
        held.update(dict(zip(lists.pairs.tolist(), lists.docs.counts().tolist(), strict=True)))
        links.update(dict(zip(lists.pairs.tolist(), again.links().tolist(), strict=True)))
    assert {(p >> 15, p & 0x7FFF): (held[p], links[p]) for p in held} == {p: v[:2] for p, v in want.items()}


def test_both_encoders_give_the_same_ids(rows):  # noqa: F811
    path, _, pattern = vocabularies()
    rng = random.Random(4)
    raw = alignment.byte_side(path).raw
    odd = ["".join(rng.choices("ab  éß日😀\n\t\x1c\x85\u2003'’.,0123Αб\u0301", k=80)) for _ in range(500)]
    odd += [b"".join(rng.choices(raw, k=8)).decode("utf-8", "ignore") for _ in range(2000)]
    texts = [t for _, t in rows if t] + SIGNS + odd
    for one, other in zip(alignment.byte_side(path).encode(texts), alignment.byte_side(path, pattern).encode(texts), strict=True):
        assert one.tolist() == other.tolist()


def test_planes_mark_and_count():
    rng = np.random.default_rng(1)
    lists, marks = np.concatenate([np.full(900, 2), rng.integers(0, 40, 500)]), np.concatenate([rng.integers(0, 1000, 900), rng.integers(0, 1000, 500)])
    plane = alignment.Plane.of(lists, marks, 41, 1000)
    want = sorted({(int(a), int(b)) for a, b in zip(lists, marks, strict=True)})
    assert len(plane.dense) and plane.marks().tolist() == [a << 16 | b for a, b in want]
    assert plane.counts().tolist() == [sum(a == k for a, _ in want) for k in range(41)]


def test_alignment_of_nothing(spark, empty):  # noqa: F811
    found = alignment.alignment(empty, *vocabularies(), digest=True)
    assert found.docs.collect() == [] and found.pairs.collect() == []
    only = alignment.alignment(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string"), *vocabularies(), digest=True)
    assert [tuple(r) for r in only.docs.select("n_a", "n_links", "count_sum", "groups").collect()] == [(0, 0, 0, "")] * 2


def test_queries_of_new_operators(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    want, _ = brute_alignment(list(texts.values()))
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_token_alignment"](spark, folder).collect()}
    for i, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) in zip(texts, want, strict=True):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert len(got) == len(texts)


@pytest.mark.parametrize("nulls,repeats,n_ranges", [(0, 0, 8), (25, 0, 8), (60, 0, 1), (60, 30, 8), (3, 30, 40)])
def test_next_documents_with_null_and_repeated_ids(spark, nulls, repeats, n_ranges):
    """The edited text of every row takes its end from the next one by descending id, then text; null ids come last."""
    rng = random.Random(nulls)
    word = lambda: "".join(rng.choices("abcdef ", k=rng.randint(3, 60)))
    rows = [(i, word()) for i in rng.sample([-(2**63) + 5, 2**63 - 5, *range(-50, 10**6)], 40)]
    rows += [(None, word()) for _ in range(nulls)] + [(7, word()) for _ in range(repeats)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = sorted(hashlib.sha256(fingerprint.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["edited_sha256"] for r in fingerprint.with_next(df, n_ranges=n_ranges).collect()) == want
