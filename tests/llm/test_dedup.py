"""Jaccard join, word windows and byte strings against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import docs, empty, rows  # noqa: F401  fixtures

from cartlens.llm import components, jaccard, packs, suffixes, windows
from cartlens.llm.packs import Strings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def test_groups_equal_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("frequent,tile", [(2, 2), (10**9, 3)])
def test_groups_do_not_depend_on_marks_or_tiles(docs, rows, monkeypatch, frequent, tile):
    """Also when most elements count as frequent, and when most shared elements are too common for pairs."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert got == brute_groups(rows)


def test_links_at_exactly_three_quarters(spark):
    base, other = [f"w{i}" for i in range(104)], [f"v{i}" for i in range(104)]  # 100 shingles each
    rows = [(5, base), (3, base[:79]), (9, base[25:]), (7, other), (1, other[:78]), (None, base), (5, "one id twice".split())]
    got = jaccard.groups(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert found == {(5, 100): 3, (3, 75): 3, (9, 75): 3, (7, 100): 7, (1, 74): 1, (None, 100): None, (5, 1): 5}


@pytest.mark.parametrize("n_bits", [64, 1 << 22])
def test_copies_give_one_array_per_set(spark, monkeypatch, n_bits):
    """Also when the bitmap of wanted documents lets every copy through, and where rows repeat."""
    monkeypatch.setattr(jaccard, "WANTED_BITS", n_bits, raising=False)
    a, b = [f"w{i}" for i in range(104)], [f"w{i}" for i in range(90)] + [f"v{i}" for i in range(14)]
    rows = [(i, a) for i in range(100)] + [(i, b) for i in range(100, 200)] + [(0, a), (0, a), (100, b), (None, a)]
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "_id long, text string").repartition(7)
    heads = {r["_id"]: r["sid"] for r in jaccard.describe(texts, "text", 5).filter("_id in (0, 100) and n >= 0").collect()}
    low, high = sorted((sid, first) for first, sid in heads.items())
    pairs = spark.createDataFrame([(low[0], high[0], low[1], high[1])], "a long, b long, first_a long, first_b long")
    # Any real bitmap passes all where it is full; 64 bits hold two ids, so fill it with ids of other pairs.
    fill = spark.createDataFrame([(k, k + 1, k + 10**6, k + 2 * 10**6) for k in range(2000)], pairs.schema)
    links = jaccard.linked(pairs.union(fill), texts, "text", 5).collect()
    assert [tuple(r) for r in links] == [(low[0], high[0])]


def test_tiles_are_banded_by_size(spark, monkeypatch):
    """Every pair of fitting size meets in a tile, and no tile joins bands out of each other's reach."""
    monkeypatch.setattr(jaccard, "BAND", 8, raising=False)
    rng = np.random.default_rng(5)
    n = np.concatenate([rng.integers(20, 2000, 150), np.full(40, 300)])
    members = spark.createDataFrame([(1, i, int(k), 0) for i, k in enumerate(n)], "key long, sid long, n int, rare int")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "node long, component long")
    cells = {}
    for r in jaccard.tiles(members, labels).collect():
        cells.setdefault((r["band"], r["against"]), ([], []))[r["outside"]].append(r["sid"])
    met = set()
    for every, outside in cells.values():
        assert every and outside
        assert 4 * n[every].max() >= 3 * n[outside].min() and 4 * n[outside].max() >= 3 * n[every].min()
        met |= {(min(a, b), max(a, b)) for a in every for b in outside}
    fits = {(a, b) for b in range(30, len(n)) for a in range(len(n)) if a != b and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b])}
    assert {(min(p), max(p)) for p in fits} <= met
    assert len(met) < 0.6 * len(n) * (len(n) - 1) / 2


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        sig = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        apart = jaccard.bits_apart([sig[0]], [sig[1]])[0]
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        n, m = max(len(a), len(b)), min(len(a), len(b))
        common = len(set(a.tolist()) & set(b.tolist()))
        if 7 * common >= 3 * (n + m):
            assert common >= jaccard.overlap_needed(np.int64(n), np.int64(m))
            assert set(np.sort(a)[: jaccard.prefix_length(np.int64(len(a)))].tolist()) & set(np.sort(b)[: jaccard.prefix_length(np.int64(len(b)))].tolist())


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7), (200, 199), (200, 199)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100, 199: 199, 200: 199}


def brute_windows(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 4000])
def test_windows_equal_brute_force(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(windows, "FREQUENT", 2 if chunk == 4000 else 256)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in windows.without_repeats(docs, n_buckets=7).collect()}
    assert got == brute_windows(rows, 20)


def brute_bytes(rows, size):
    count = Counter()
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        count.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = b"\x01" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 4000])
def test_byte_strings_equal_brute_force(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixes, "FREQUENT", 2 if chunk == 4000 else 256)
    small = [(i, t) for i, t in rows if len(t or "") < 20000]
    ids = [i for i, _ in small]
    kept = suffixes.without_repeats(docs.filter(F.col("doc_id").isin(ids)), n_buckets=5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in kept.collect()}
    assert got == brute_bytes(small, 400)


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 600)
    at = np.sort(rng.choice(590, 80, replace=False))
    group = np.sort(rng.integers(0, 3, 80))
    end = np.minimum(at + 200, 600)
    order, shared = suffixes.sorted_suffixes(data, at, end, group, 150)
    raw = data.tobytes()
    for g in range(3):
        mine = [raw[at[k] : end[k]][:150] for k in order if group[k] == g]
        assert mine == sorted(mine)
    for k in range(1, 80):
        if group[order[k]] == group[order[k - 1]]:
            x, y = (raw[at[i] : end[i]][:150] for i in (order[k - 1], order[k]))
            assert shared[k] == next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y)))


def test_identical_pieces_count_once_per_document():
    data = np.frombuffer(b"abcdefgh" * 100, np.uint8)
    one = np.array([4, 4]), np.array([9, 9]), np.array([0, 0])
    s = Strings(*one, np.array([0, 400, 800]), data)
    assert len(suffixes.settle(s.take(np.array([0])), 400)[0]) == 0
    assert len(suffixes.settle(s, 400)[0]) == 0  # the same piece of the same document, read twice


def test_repeated_rows_and_null_ids_count_as_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in windows.without_repeats(df, n_buckets=3).collect())
    assert got == [(-1, 0, 0), (-1, 200, 0), (1, 200, 200), (1, 200, 200), (2, 0, 0)]
    got = sorted((r["doc_id"] or -1, r["n_removed"] > 0) for r in suffixes.without_repeats(df, n_buckets=3).collect())
    assert got == [(-1, False), (-1, True), (1, True), (1, True), (2, False)]


def test_empty_tables(empty):
    assert jaccard.groups(empty).count() == 0
    assert windows.without_repeats(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == 0


def test_buckets_follow_the_text(docs, rows, monkeypatch):
    """More buckets and tasks than shuffle partitions, by the bytes of text; the rows stay the same."""
    sizes = sum(len((t or "").encode()) for _, t in rows)
    marks, n_bytes = packs.surveyed(windows.count_minimisers(docs, 20, "text"), 256)
    assert n_bytes == sizes and packs.surveyed(suffixes.count_anchors(docs, 400, "text"), 256)[1] == sizes
    assert packs.bucket_count(docs.sparkSession, n_bytes, 2) == 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = lambda df, c: sorted((r["doc_id"] or -1, r["n_removed"], bytes(r[c], "utf-8") if isinstance(r[c], str) else bytes(r[c])) for r in df.select("doc_id", "n_removed", c).collect())
    few = digest(windows.without_repeats(docs), "kept_text"), digest(suffixes.without_repeats(docs), "kept_bytes")
    monkeypatch.setattr(packs, "BUCKET_BYTES", sizes // 90)
    monkeypatch.setattr(packs, "TASK_BYTES", sizes // 20)
    assert packs.bucket_count(docs.sparkSession, n_bytes, 2) >= 90
    many = windows.without_repeats(docs)
    assert few == (digest(many, "kept_text"), digest(suffixes.without_repeats(docs), "kept_bytes"))


def test_no_text_has_no_bytes(empty):
    assert packs.surveyed(windows.count_minimisers(empty, 20, "text"), 256)[1] == 0


def test_bitmaps_turn_down_pairs_well_below_the_bound():
    """Sets of 400 with 0.68 in common lie further apart than (n + m) / 7 bits, not only in elements."""
    rng = np.random.default_rng(5)
    common, n = 324, 400
    far = 0
    for _ in range(50):
        every = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        x, y = np.sort(every[:n]), np.sort(np.concatenate([every[:common], every[n:]]))
        maps = jaccard.signatures(np.concatenate([x, y]), np.array([0, n, 2 * n]))
        far += int(7 * jaccard.bits_apart(maps[:1], maps[1:])[0] > 2 * n)
    assert far >= 45
