"""Factors against a dense solve, and lists against a full product."""

import dataclasses
import random

import numpy as np
import pytest

from cartlens import session
from cartlens.config import AlsConfig
from cartlens.functions import joins
from cartlens.operators import als, matrix

PAIRS = "user_idx bigint, item_idx bigint, rating double"


def ratings(seed=1, users=120, items=60):
    """A user and an item hold a large share; some ratings are weak, some are dislikes, some say nothing."""
    rnd = random.Random(seed)
    return [
        (u, i, rnd.choice([1e-9, 0.1, 1.0, 4.0, 9.0, -1.0, 0.0]))
        for u in range(users)
        for i in range(items)
        if rnd.random() < (0.9 if u == 3 or i == 7 else 0.1)
    ]


def as_arrays(factors):
    return {r["idx"]: np.array(r["features"], np.float64) for r in factors.collect()}


def dense(rows, config, start):
    """The normal equations row by row, straight from the objective."""
    by_user, by_item = {}, {}
    for u, i, r in rows:
        if r:
            by_user.setdefault(u, []).append((i, r))
            by_item.setdefault(i, []).append((u, r))

    def half(other, groups):
        gram = sum(np.outer(v, v) for v in other.values())
        out = {}
        for k, mine in groups.items():
            left, right = gram + config.regularization * np.eye(config.factors), np.zeros(config.factors)
            for j, r in mine:
                c = config.alpha * abs(r)
                left = left + (c - 1) * np.outer(other[j], other[j])
                right = right + (c * other[j] if r > 0 else 0)
            out[k] = np.linalg.solve(left, right)
        return out

    x, y = {}, start
    for _ in range(config.iterations):
        x = half(y, by_user)
        y = half(x, by_item)
    return x, y


@pytest.mark.parametrize("block_mb,precision,factors", [(64, "float64", 5), (64, "float64", 24), (0, "float64", 5), (64, "float32", 5)])
def test_factors_equal_a_dense_solve(spark, frame, monkeypatch, block_mb, precision, factors):
    """Rows shorter and longer than the factors. With blocks of one rating every row is split, and added from parts."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1000 if block_mb else 0)
    config = AlsConfig(factors=factors, iterations=2, alpha=2.0, block_mb=block_mb, precision=precision)
    rows = ratings()
    df = frame(rows, PAIRS)
    start = as_arrays(als.train_als(df, dataclasses.replace(config, iterations=0)).item_factors)
    assert set(start) == {i for _, i, r in rows if r} and 0 < max(abs(v).max() for v in start.values()) < 0.01
    model = als.train_als(df, config)
    want = dense(rows, config, start)
    near = 1e-9 if precision == "float64" else 1e-4
    for got, expected in zip((as_arrays(model.user_factors), as_arrays(model.item_factors)), want, strict=True):
        assert set(got) == set(expected)
        assert max(abs(got[k] - expected[k]).max() for k in got) < near


def test_a_vector_is_scaled_once_and_sent_with_others(spark, frame):
    """Each block gets the vectors it needs in few rows, already in terms of the shared matrix."""
    config = AlsConfig(factors=3)
    vectors = np.random.default_rng(4).normal(size=(40, 3))
    to = {k: sorted({k % 4, (k + 1) % 4, 0}) for k in range(40)}
    scaling = als._scaling(vectors.T @ vectors, config)
    df = frame([(k, to[k], bytearray(v.tobytes())) for k, v in enumerate(vectors)], "idx bigint, to array<bigint>, data binary")
    rows = df.coalesce(1).mapInArrow(als._sent(scaling[0], config), "to long, ids binary, data binary").collect()
    assert len(rows) <= 4 * 4  # blocks x batches, not vectors
    got = {}
    for r in rows:
        ids, data = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"]).reshape(-1, 3)
        got |= {(int(k), r["to"]): z for k, z in zip(ids, data, strict=True)}
    assert set(got) == {(k, b) for k, blocks in to.items() for b in blocks}
    root = np.linalg.cholesky(vectors.T @ vectors + config.regularization * np.eye(3))
    assert all(np.allclose(root @ z, vectors[k]) for (k, _), z in got.items())


@pytest.mark.parametrize("block_mb", [64, 0])
def test_a_half_step_that_sends_much_is_written_in_turns(spark, frame, monkeypatch, block_mb):
    """No write serves all blocks, so what is sent to some is gone before the next; the factors stay the same."""
    config = AlsConfig(factors=5, iterations=2, alpha=2.0, block_mb=block_mb)
    df = frame(ratings(), PAIRS)
    whole = als.train_als(df, config)
    solved, write = [], als.stage_at

    def counted(step, label):
        out = write(step, label)
        if label == "factors":
            solved.append(out[0].select("idx").distinct().count())
        return out

    monkeypatch.setattr(als, "stage_at", counted)
    monkeypatch.setattr(als, "_TURN_BYTES", 1, raising=False)
    turned = als.train_als(df, config)
    first, *_, last = solved
    assert first == 60 and len(solved) == 2 + 3 * 4 and max(solved[2:]) < 120
    for side in ("user_factors", "item_factors"):
        got, want = as_arrays(getattr(turned, side)), as_arrays(getattr(whole, side))
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in got)


def test_factors_without_regularization(spark, frame):
    config = AlsConfig(factors=4, iterations=2, regularization=0.0)
    rows = ratings(seed=5, users=30, items=20)
    df = frame(rows, PAIRS)
    start = as_arrays(als.train_als(df, dataclasses.replace(config, iterations=0)).item_factors)
    model = als.train_als(df, config)
    for got, want in zip((as_arrays(model.user_factors), as_arrays(model.item_factors)), dense(rows, config, start), strict=True):
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-6) for k in got)


def test_split_rows_spread_over_blocks(spark, frame):
    """A row with more ratings than a block takes is in several blocks, none above twice the bound."""
    rows = [(0, i, 1.0) for i in range(3000)] + [(u, 0, 1.0) for u in range(1, 50)]
    config = AlsConfig(factors=1024, block_mb=4)  # 512 vectors
    blocks, _, split = als._blocks(frame(rows, PAIRS), "user_idx", "item_idx", len(rows), config)
    sizes = [len(r["ratings"]) // 8 for r in blocks.collect()]
    assert split and sum(sizes) == len(rows) and len(sizes) > 6 and max(sizes) <= 1024


def test_nothing_to_train_on(frame):
    model = als.train_als(frame([(1, 1, 0.0)], PAIRS), AlsConfig(factors=3, iterations=2))
    assert model.user_factors.collect() == model.item_factors.collect() == []
    users = frame([(1,)], "user_idx bigint")
    assert als.top_unseen_by_index(model, frame([], PAIRS), users, 5).collect() == []


def test_lists_equal_a_full_product(spark, frame, monkeypatch):
    """Users with 31 to 4,097 seen items, blocks smaller than the tables, ties, and users without factors."""
    monkeypatch.setattr(als, "USER_BLOCK", 4)
    monkeypatch.setattr(als, "ITEM_BLOCK", 700)
    rng = np.random.default_rng(2)
    n_items, sizes = 4100, [0, 1, 31, 32, 33, 1023, 1024, 1025, 4095, 4096, 4097, 4100]
    x, y = rng.integers(-3, 4, (len(sizes), 4)).astype(float), rng.integers(-3, 4, (n_items, 4)).astype(float)
    vectors = lambda m: frame([(k, v.tolist()) for k, v in enumerate(m)], "idx bigint, features array<double>")
    model = als.FactorModel(vectors(x), vectors(y))
    seen = {u: set(rng.choice(n_items, k, replace=False).tolist()) for u, k in enumerate(sizes)}
    pairs = frame([(u, i, 1.0) for u, items in seen.items() for i in items], PAIRS)
    for n in (1, 7, 25):
        got = {}
        for r in als.top_unseen_by_index(model, pairs, frame([(u,) for u in [*range(len(sizes)), 99, 2]], "user_idx bigint"), n).collect():
            got.setdefault(r["user_idx"], []).append((r["rank"], r["item_idx"], r["score"]))
        scores = x @ y.T
        for u in range(len(sizes)):
            order = sorted((i for i in range(n_items) if i not in seen[u]), key=lambda i: (-scores[u, i], i))[:n]
            assert sorted(got.get(u, [])) == [(k + 1, i, scores[u, i]) for k, i in enumerate(order)]
        assert 99 not in got


def test_trained_lists_equal_a_full_product(spark, frame):
    sizes = {1: 31, 2: 32, 3: 33, 4: 127, 5: 128, 6: 129, 7: 200, 8: 1}
    rows = [(u, i, float(1 + (u * i) % 5)) for u, n in sizes.items() for i in range(1, n + 1)]
    rows += [(9, i, 1.0) for i in range(1, 260, 7)]
    built = matrix.build_user_item_matrix(frame(rows, "user_id bigint, item_id bigint, rating double"))
    model = als.train_als(built.coordinates, AlsConfig(factors=6, iterations=3))
    got = {}
    for r in als.top_unseen(model, built, built.users.select("user_id"), 5).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["score"]))
    users = {r["user_idx"]: r["user_id"] for r in built.users.collect()}
    items = {r["item_idx"]: r["item_id"] for r in built.items.collect()}
    left = {users[k]: v for k, v in as_arrays(model.user_factors).items()}
    right = {items[k]: v for k, v in as_arrays(model.item_factors).items()}
    seen = {(u, i) for u, i, _ in rows}
    for u, vector in left.items():
        scores = sorted(((float(vector @ f), i) for i, f in right.items() if (u, i) not in seen), reverse=True)[:5]
        assert [s for s, _ in scores] == pytest.approx([s for _, _, s in sorted(got[u])], abs=1e-9)
        assert not seen & {(u, i) for _, i, _ in got[u]}


def test_weak_observations_stay_in_training(frame):
    """Pairs whose decayed rating is below 1 / alpha keep factors, and their items can be recommended."""
    rows = [(u, i, 0.01 if i > 6 else 2.0) for u in range(1, 9) for i in range(1, 10) if (u + i) % 3]
    built = matrix.build_user_item_matrix(frame(rows, "user_id bigint, item_id bigint, rating double"))
    model = als.train_als(built.coordinates, AlsConfig(factors=4, iterations=3, alpha=4.0))
    norms = [float(np.linalg.norm(v)) for v in as_arrays(model.item_factors).values()]
    assert len(norms) == 9 and min(norms) > 0


def test_blocks_list_little_below_the_best(spark, frame, monkeypatch):
    """With many blocks of items, only scores near a user's n best leave them, not n of every block."""
    monkeypatch.setattr(als, "USER_BLOCK", 40)
    monkeypatch.setattr(als, "ITEM_BLOCK", 100)
    left = []
    merge = als.top_per_group
    monkeypatch.setattr(als, "top_per_group", lambda df, *a: left.append(df.count()) or merge(df, *a))
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=(4000, 6)) * rng.gamma(2.0, size=(4000, 1))
    vectors = lambda m: frame([(k, v.tolist()) for k, v in enumerate(m)], "idx bigint, features array<double>")
    monkeypatch.setattr(als, "HEAD", 400, raising=False)
    users = frame([(u,) for u in range(80)], "user_idx bigint")
    got = als.top_unseen_by_index(als.FactorModel(vectors(x), vectors(y)), frame([], PAIRS), users, 10).count()
    assert got == 800 and left[0] < 3 * 800  # 40 blocks of items give 32,000 without floors


def test_only_the_factors_stay_written(frame, tmp_path, monkeypatch):
    """Pairs, blocks and routes are of the size of the ratings, so they go when training ends."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    model = als.train_als(frame(ratings(), PAIRS), AlsConfig(factors=3, iterations=2))
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "cartlens").iterdir())
    assert left == ["item-factors", "user-factors"] and model.user_factors.count() > 0


def test_blocks_are_few_where_lists_are_long():
    """What is exchanged is a side's factors times the other side's blocks."""
    for n, most in ((20, 2.2e9), (100, 1e9)):
        n_users, n_items = (900_000, 1_200_000) if n == 20 else (90_000, 1_200_000)
        users, items = als._grid(n_users, n_items, 16, n, 48)
        assert users * items >= 48 and 128 * (n_users * items + n_items * users) < most
        assert n_users / users * 8 * 2 * n <= als.BLOCK_BYTES and n_items / items * 8 * 16 <= als.BLOCK_BYTES


def test_vectors_are_read_from_files_where_workers_can_open_them(frame, monkeypatch):
    """No vector is sent to a block then; without such a folder they are, and the factors are the same."""
    config = AlsConfig(factors=5, iterations=2, alpha=2.0)
    df = frame(ratings(), PAIRS)
    labels, write = [], als.stage
    monkeypatch.setattr(als, "stage", lambda step, label: labels.append(label) or write(step, label))
    read = als.train_als(df, config)
    assert not [label for label in labels if label.startswith("routes")]
    monkeypatch.setattr(als, "local_stages", lambda spark: None, raising=False)
    sent = als.train_als(df, config)
    assert [label for label in labels if label.startswith("routes")]
    for side in ("user_factors", "item_factors"):
        got, want = as_arrays(getattr(read, side)), as_arrays(getattr(sent, side))
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in got)


@pytest.mark.parametrize("step", [2, 7, -1])
def test_laid_vectors_are_taken_by_id(spark, frame, tmp_path, step):
    """From several files, one of them empty, in the order asked for and each changed once."""
    from cartlens.operators.vectors import WRITTEN, Vectors, writer

    data = np.random.default_rng(6).normal(size=(50, 3))
    df = frame([(step * k, bytearray(v.tobytes())) for k, v in enumerate(data)], "idx bigint, data binary")
    laid = df.repartition(3).unionByName(df.limit(0)).mapInArrow(writer(str(tmp_path), 3, "float64", lambda v: 2.0 * v), WRITTEN)
    files = [(r["path"], r["n"]) for r in laid.collect()]
    assert sum(n for _, n in files) == 50
    wanted = np.array([step * k for k in (49, 3, 3, 0, 21)])
    assert np.array_equal(Vectors(files, 3, "float64").take(wanted), 2.0 * data[wanted // step])
    assert Vectors(files, 3, "float64").take(wanted[:0]).shape == (0, 3)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_lists_from_files_equal_sent_blocks_and_a_full_product(spark, frame, monkeypatch, tmp_path, kind):
    """Several blocks of items and groups of users; a vector without end, users with all seen, repeated pairs, ties."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(als, "ITEM_BLOCK", 700)
    monkeypatch.setattr(als, "_GROUP_BYTES", 16 * 14 * 9, raising=False)
    rng = np.random.default_rng(8)
    x, y = rng.integers(-3, 4, (40, 5)).astype(float), rng.integers(-3, 4, (2500, 5)).astype(float)
    x[7], y[3] = 0.0, np.nan
    vectors = lambda m: frame([(k, v.tolist()) for k, v in enumerate(m)], f"idx bigint, features array<{kind}>")
    model = als.FactorModel(vectors(x), vectors(y))
    seen = {u: {int(i) for i in rng.choice(2500, 3 * u, replace=False)} for u in range(39)} | {39: set(range(2500)), 77: {1}}
    pairs = frame([(u, i, 1.0) for u, items in seen.items() for i in items for _ in range(1 + i % 2)], PAIRS)
    users = frame([(u,) for u in range(45)], "user_idx bigint")
    scores = x @ y.T
    want = []
    for u in range(40):
        order = sorted((i for i in range(2500) if i != 3 and i not in seen[u]), key=lambda i: (-scores[u, i], i))[:7]
        want += [(u, k + 1, i, scores[u, i]) for k, i in enumerate(order)]
    read = als.top_unseen_by_index(model, pairs, users, 7)
    assert len(list(tmp_path.glob("cartlens/items-*/*.npz"))) == 4  # written once, not once for each group of users
    assert sorted((r["user_idx"], r["rank"], r["item_idx"], r["score"]) for r in read.collect()) == want
    monkeypatch.setattr(als, "local_stages", lambda spark: None, raising=False)
    sent = als.top_unseen_by_index(model, pairs, users, 7)
    assert sorted((r["user_idx"], r["rank"], r["item_idx"], r["score"]) for r in sent.collect()) == want
