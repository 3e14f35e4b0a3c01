from conftest import values

from cartlens.config import InteractionConfig
from cartlens.operators import features as f

EVENTS = "user_id bigint, item_id bigint, event string, timestamp bigint"
PROPS = "item_id bigint, property string, value string, timestamp bigint"
TREE = "category_id bigint, parent_id bigint"


def test_counts_are_taken_once_on_all_pairs(frame):
    # item 9 has two pairs only through user 3, who is dropped for having one pair: item 9 still stays
    rows = [(1, 9, "view", 1), (1, 8, "addtocart", 2), (1, 8, "view", 5), (3, 9, "transaction", 3), (2, 8, "other", 4), (2, 7, "view", 4)]
    kept = f.build_interactions(frame(rows, EVENTS), InteractionConfig(2, 2))
    assert values(kept) == [(1, 8, 5.0, 5), (1, 9, 1.0, 1), (2, 8, 1.0, 4)]


def test_latest_values_and_ties(frame):
    props = frame(
        [
            (1, "categoryid", "5", 10),
            (1, "categoryid", "7", 20),
            (2, "categoryid", "5", 10),
            (2, "categoryid", "6", 10),
            (1, "available", "1", 10),
            (1, "available", None, 20),
            (3, "other", "x", 1),
        ],
        PROPS,
    )
    assert values(f.latest_categories(props)) == [(1, 7), (2, 6)]
    assert values(f.item_availability(props)) == [(1, None)]


def test_depth_of_roots_children_orphans_and_cycles(frame):
    tree = frame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (50, 51), (51, 50)], TREE)
    levels = dict(tuple(r) for r in f.category_levels(tree).collect())
    assert levels == {1: 1, 2: 2, 3: 3, 4: None, 5: None, 50: None, 51: None}
    rooted = dict(tuple(r) for r in f.category_levels(tree, orphan_as_root=True).collect())
    assert (rooted[4], rooted[5], rooted[50]) == (2, 3, None)


def test_depth_stops_after_twenty_rounds(frame):
    chain = frame([(1, None)] + [(i, i - 1) for i in range(2, 26)], TREE)
    levels = dict(tuple(r) for r in f.category_levels(chain).collect())
    assert levels[21] == 21 and levels[22] is None


def test_metadata_fills_counts(frame):
    built = f.item_metadata(
        frame([(1, 10), (2, 11)], "item_id bigint, category_id bigint"),
        frame([(10, 1)], "category_id bigint, level int"),
        frame([(1, "1")], "item_id bigint, available_value string"),
        frame([(1, 3, 2, 4.0)], "item_id bigint, n_events bigint, n_users bigint, weighted_score double"),
    )
    assert values(built) == [(1, 10, 1, "1", 3, 2, 4.0), (2, 11, None, None, 0, 0, 0.0)]


def test_written_pairs_serve_interactions_and_category_counts(frame):
    """Nothing is aggregated from the events again: here they are empty."""
    rows = [(u, i, "view", t) for t, u, i in ((1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 2, 2), (6, 3, 3))]
    events, categories = frame(rows, EVENTS), frame([(1, 7), (2, 7), (3, 8)], "item_id bigint, category_id bigint")
    pairs = f.user_item_pairs(events)
    assert values(f.build_interactions(frame([], EVENTS), InteractionConfig(2, 2), pairs)) == values(f.build_interactions(events, InteractionConfig(2, 2)))
    assert values(f.category_stats(frame([], EVENTS), categories, pairs=pairs)) == [(7, 5, 2, 2), (8, 1, 1, 1)]
    assert values(f.item_popularity(frame([], EVENTS), pairs=pairs)) == values(f.item_popularity(events))
