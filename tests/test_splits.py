import random

import pytest
from conftest import values

from cartlens.functions import joins, ranking
from cartlens.functions.ranking import dense_index, positions_in_time, top_per_group
from cartlens.operators import splits
from cartlens.operators.transforms import filter_purchased_items, subsample_views
from pyspark.sql import functions as F

INTER = "user_id bigint, item_id bigint, rating double, timestamp bigint"


def test_null_times_count_but_land_nowhere(frame):
    rows = [(1, i, 1.0, i) for i in range(1, 9)] + [(1, 100, 1.0, None), (1, 101, 1.0, None)] + [(2, 5, 1.0, 7)]
    train, test = splits.temporal_split_per_user(frame(rows, INTER), 0.5)
    # ten rows of user 1 give a cut at five
    assert values(train, "user_id", "item_id") == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 5)]
    assert values(test, "user_id", "item_id") == [(1, 6), (1, 7), (1, 8)]


@pytest.mark.parametrize("share", [0.0, 1.0, -1, 2])
def test_share_must_be_inside(frame, share):
    with pytest.raises(ValueError):
        splits.temporal_split_per_user(frame([], INTER), share)
    with pytest.raises(ValueError):
        splits.temporal_split_global(frame([], INTER), share)


WIDE = "user_id bigint, item_id bigint, timestamp bigint, note string"


def skewed(kind):
    """A heavy user's rows in one hour, at one time, or without an id; all with nulls, ties and equal rows."""
    rnd = random.Random(3)
    hot = {"hour": lambda: (1, rnd.randrange(9), 3_600_000 + rnd.randrange(50)), "time": lambda: (1, rnd.randrange(300), 7), "null": lambda: (None, rnd.randrange(40), rnd.randrange(10**7)), "equal": lambda: (2, 5, 11)}[kind]
    rows = [(*hot(), rnd.choice("ab")) for _ in range(400)]
    rows += [(rnd.choice([3, 4, None]), rnd.randrange(5), rnd.randrange(40) if rnd.random() > 0.1 else None, "c") for _ in range(120)]
    return rows + [(1, 1, None, "d")] * 3


def placed(df):
    """Places as far as the order decides them: rows that tie get the set of their places."""
    out = {}
    for r in df.collect():
        out.setdefault((r["user_id"], r["timestamp"], r["item_id"]), []).append((r["_r"], r["_n"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("kind", ["hour", "time", "null", "equal"])
@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_heavy_keys_rank_like_light_ones(spark, frame, monkeypatch, kind, broadcast_rows):
    rows = skewed(kind)
    df = frame(rows, WIDE).repartition(5)
    light = positions_in_time(df, "user_id", "timestamp", ["item_id"])
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    heavy = positions_in_time(df, "user_id", "timestamp", ["item_id"], heavy_rows=60)
    assert placed(heavy) == placed(light)
    assert values(heavy, *df.columns) == values(light, *df.columns) == sorted((r for r in rows if r[2] is not None), key=lambda t: tuple((v is None, str(type(v)), v) for v in t))


def test_parts_of_a_heavy_key_stay_below_the_bound(frame, monkeypatch):
    """No window over a heavy key's rows is larger than its bound, whatever they share; equal rows count once."""
    seen = []
    real = ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, label: seen.append((label, out := real(df, label))) or out)
    for kind in ("hour", "time", "null", "equal"):
        positions_in_time(frame(skewed(kind), WIDE), "user_id", "timestamp", ["item_id"], heavy_rows=60).count()
    parts = [df.groupBy("_part").count().agg(F.max("count")).first()[0] for label, df in seen if label == "heavy-ranges"]
    assert len(parts) == 4 and max(parts) <= 60


def test_parts_do_not_follow_the_rows_under_a_low_bound(frame, monkeypatch):
    """A low bound makes no task for every few rows of a large key, and the places stay right."""
    monkeypatch.setattr(ranking, "_FEW_PARTS", 3, raising=False)
    seen = []
    real = ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, label: seen.append((label, out := real(df, label))) or out)
    df = frame(skewed("hour"), WIDE).repartition(5)
    heavy = positions_in_time(df, "user_id", "timestamp", ["item_id"], heavy_rows=20)
    assert placed(heavy) == placed(positions_in_time(df, "user_id", "timestamp", ["item_id"]))
    ranges = next(df for label, df in seen if label == "heavy-ranges")
    assert 1 < ranges.select("_part").distinct().count() <= 3
    assert ranking._range_parts(10**9, 2000) == 2000 and ranking._range_parts(10**9, 10**7) == 200


@pytest.mark.parametrize("share,cut", [(0.01, 20), (0.99, 20), (0.5, 20)])
def test_global_cut_is_clamped(frame, share, cut):
    df = frame([(1, 1, 1.0, 10), (1, 2, 1.0, 20), (1, 3, 1.0, None)], INTER)
    assert splits.global_cut_timestamp(df, share).first()["value"] == cut
    train, test = splits.temporal_split_global(df, share)
    assert (train.count(), test.count()) == (1, 1)


def test_global_cut_matches_sorting(frame):
    rnd = random.Random(5)
    times = [rnd.randrange(30) * 2_000_000 + rnd.randrange(5) for _ in range(500)]
    df = frame([(1, i, 1.0, t) for i, t in enumerate(times)], INTER)
    for share in (0.1, 0.15, 0.33, 0.9):
        assert splits.global_cut_timestamp(df, share).first()["value"] == sorted(times)[int(500 * (1.0 - share))]


def test_global_split_of_nothing(frame):
    train, test = splits.temporal_split_global(frame([], INTER), 0.2)
    assert train.count() == test.count() == 0


def test_date_split(frame):
    df = frame([(1, 1, 1.0, 1388534399999), (1, 2, 1.0, 1388534400000)], INTER)
    train, test = splits.global_time_split(df, df, "2014-01-01")
    assert values(train, "item_id") == [(1,)] and values(test, "item_id") == [(2,)]


def test_dense_index_is_gapless_for_far_apart_ids(frame):
    ids = [5, -7, 2**40, 3, 2**62, 65536, 65537, 1]
    indexed = dense_index(frame([(i,) for i in ids + ids], "user_id bigint"), "user_id")
    assert dict(tuple(r) for r in indexed.collect()) == {v: i for i, v in enumerate(sorted(ids))}


def test_top_per_group_beyond_the_pruning_limit(frame):
    df = frame([(1, i) for i in range(3000)], "k bigint, v bigint")
    top = top_per_group(df, ["k"], [F.desc("v")], 1500)
    assert sorted(r["v"] for r in top.collect()) == list(range(1500, 3000))


def test_view_sampling(frame):
    rows = [(1, i, "view", i) for i in range(25)] + [(1, 90, "addtocart", 1), (1, 91, "addtocart", 2), (1, 92, None, 3)]
    events = frame(rows, "user_id bigint, item_id bigint, event string, timestamp bigint")
    last = subsample_views(events, 10, "last")
    assert sorted(r["item_id"] for r in last.collect()) == list(range(15, 25)) + [90, 91]
    first = subsample_views(events, 10, "first")
    assert sorted(r["item_id"] for r in first.collect()) == list(range(10)) + [90, 91]
    assert subsample_views(events, 10, "random").count() == 12
    with pytest.raises(ValueError):
        subsample_views(events, 10, "middle")


def test_purchases_are_required(frame):
    with pytest.raises(ValueError):
        filter_purchased_items(frame([], INTER), None)


@pytest.mark.parametrize("heavy", (3, 1000))
def test_bounds_given_with_the_rows(frame, heavy):
    """Upper bounds of the users' rows settle whether any is heavy; too high ones change nothing."""
    rows = [(u, i, 1.0, None if i == 2 else 10 * i % 7) for u in (1, 2, None) for i in range(3 + (u or 4) * 2)]
    df = frame(rows, "user_id bigint, item_id bigint, rating double, timestamp bigint")
    at_most = frame([(1, 9), (2, 9), (None, 50)], "user_id bigint, _n bigint")
    want = splits.mark_split_per_user(df, 0.3, heavy_rows=heavy)
    got = splits.mark_split_per_user(df.repartition(3, "user_id"), 0.3, heavy_rows=heavy, at_most=at_most)
    assert values(got) == values(want)
    if heavy > 50:
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange ") == 1  # the repartition alone: nothing is counted first, nothing dealt again
