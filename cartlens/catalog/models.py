"""ALS: training, lists, re-ranking, serving and metrics. Factors differ between solvers, so what has a SQL twin is
the part that must not: who gets a list, how long it is, and that nothing seen or bought is in it."""

from functools import cached_property

from pyspark.sql import functions as F

from cartlens.catalog.quality import _catalogue
from cartlens.catalog.registry import query
from cartlens.config import PRODUCTION, AlsConfig
from cartlens.functions.columns import distinct_total
from cartlens.operators import features, metrics, recommend, rerank, serving, transforms
from cartlens.operators.als import FactorModel, top_unseen, train_als
from cartlens.operators.matrix import build_user_item_matrix
from cartlens.session import stage
from cartlens.sources import artifacts
from cartlens.catalog.files import new_folder

QUERY_ALS = AlsConfig(factors=16, iterations=5, regularization=0.1, alpha=4.0)


class Trained:
    """A model fitted on the training side of one folder."""

    def __init__(self, s, config: AlsConfig = QUERY_ALS) -> None:
        self.s = s
        built = build_user_item_matrix(s.train)
        self.matrix = type(built)(stage(built.coordinates, "coordinates"), built.users, built.items)
        self.model = train_als(self.matrix.coordinates, config)

    @cached_property
    def lists(self):
        return stage(recommend.als_recommendations(self.model, self.matrix, self.s.test, 5), "als-lists")


@query("als_top_n")
def _(s):
    return Trained(s).lists


_LENGTHS = """
SELECT user_id, least({n}, (SELECT count(DISTINCT item_id) FROM train) - count(*)) AS n_items, 0 AS n_seen, 0 AS n_gaps
FROM train WHERE user_id IN (SELECT user_id FROM test) GROUP BY 1"""


def _shape(lists, train):
    seen = train.select("user_id", "item_id", F.lit(1).alias("_seen"))
    return (
        lists.join(seen, ["user_id", "item_id"], "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.count("_seen").cast("int").alias("n_seen"),
            (F.max("rank") - F.count_distinct("rank")).cast("int").alias("n_gaps"),
        )
    )


@query(
    "planted_top_n",
    """
SELECT user_id, item_id, score, rank FROM (
  SELECT u.user_id, i.item_id, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY score DESC, i.item_id) AS INTEGER) AS rank, score
  FROM (SELECT DISTINCT user_id FROM test WHERE user_id IN (SELECT user_id FROM train)) u
  CROSS JOIN (SELECT DISTINCT item_id FROM train) i
  CROSS JOIN LATERAL (SELECT ((u.user_id % 5 - 2) * (i.item_id % 7 - 3) + (u.user_id % 11 - 5) * (i.item_id % 13 - 6)
                              + (u.user_id % 3 - 1) * (i.item_id % 17 - 8))::DOUBLE AS score)
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = i.item_id))
WHERE rank <= 20""",
)
def _(s):
    """Block products and their masks against all pairs, on factors whose scores are whole numbers with many ties."""
    built = build_user_item_matrix(s.train)

    def factors(ids, key: str, moduli: tuple[int, ...]):
        vector = F.array(*((F.col(f"{key}_id") % m - m // 2).cast("double") for m in moduli))
        return ids.select(F.col(f"{key}_idx").alias("idx"), vector.alias("features"))

    planted = FactorModel(factors(built.users, "user", (5, 11, 3)), factors(built.items, "item", (7, 13, 17)))
    return top_unseen(planted, built, s.test.select("user_id"), recommend.MIN_LIST)


@query("als_production_list_shape", _LENGTHS.format(n=20))
def _(s):
    """The production setting: 256 factors in 25 iterations."""
    return _shape(Trained(s, PRODUCTION.als).lists, s.train)


@query("als_list_shape", _LENGTHS.format(n=20))
def _(s):
    return _shape(Trained(s).lists, s.train)


@query("als_trainer_list_shape", _LENGTHS.format(n=10))
def _(s):
    t = Trained(s)
    lists = recommend.als_recommendations(t.model, t.matrix, s.test, 5, least=recommend.MIN_TRAINER_LIST)
    return _shape(lists, s.train)


@query(
    "generated_recommendation_counts",
    """
SELECT count(*) FILTER (user_id IN (SELECT user_id FROM train)) AS warm_users,
       count(*) FILTER (user_id NOT IN (SELECT user_id FROM train)) AS cold_users
FROM (SELECT DISTINCT user_id FROM clean_events)""",
)
def _(s):
    t = Trained(s)
    _, counts = recommend.generate_recommendations(t.model, t.matrix, s.stored_events, s.popular, 5)
    return counts


@query("generated_recommendations")
def _(s):
    """Lists for every user with valid events: ALS for known users, category fallback for the others."""
    t = Trained(s)
    recs, _ = recommend.generate_recommendations(t.model, t.matrix, s.stored_events, s.popular, 5, s.categories, s.stored_events)
    return recs


def _reranked(s):
    return rerank.category_rerank(
        Trained(s).lists, s.history, s.categories, s.category_stats, s.tree, top_k=20, alpha=0.6, beta=0.4
    )


@query("als_reranked")
def _(s):
    return _reranked(s)


@query("als_metrics")
def _(s):
    return metrics.compute_all_metrics(
        s.test, Trained(s).lists, s.train, _catalogue(s), 5, s.categories, s.targets, s.test_events, s.item_totals
    )


@query("als_reranked_metrics")
def _(s):
    """Train, recommend, re-rank and score."""
    recs = stage(_reranked(s), "reranked")
    return metrics.compute_all_metrics(
        s.test, recs, s.train, _catalogue(s), 5, s.categories, s.targets, s.test_events, s.item_totals
    )


def _als_served(s):
    t = Trained(s)
    people = s.routed.filter(F.col("model_type").isin("als", "rerank")).select("user_id")
    candidates = stage(top_unseen(t.model, t.matrix, people, serving.batch_depth(s.routed)), "candidates")
    history = s.train.join(s.categories, "item_id", "left").select("user_id", "item_id", "category_id")
    lists = serving.personal_lists(
        s.routed,
        candidates.withColumnRenamed("rank", "cand_rank"),
        features.purchases(s.stored_events),
        F.lit(_catalogue(s).scalar()),
        history,
        s.categories,
        s.category_stats,
        s.tree,
    )
    return serving.answer_requests(s.routed, lists, s.popular)


@query("als_served_requests")
def _(s):
    return _als_served(s).select("request_id", "model_type", "cold", F.size("recommendations").alias("n_recs"))


@query(
    "als_served_routes",
    """
SELECT r.request_id, r.status, r.model_type, r.ab_test_group, r.model_type IN ('baseline', 'fallback') AS cold,
       CASE WHEN r.model_type IN ('baseline', 'fallback') THEN least(r.top_k, (SELECT count(*) FROM popular)) END AS popular_recs,
       0 AS too_many
FROM routed r""",
)
def _(s):
    """What an answer has whatever the factors are; no list is longer than asked for."""
    size = F.coalesce(F.size("recommendations"), F.lit(0))
    is_popular = F.col("model_type").isin("baseline", "fallback")
    return _als_served(s).select(
        "request_id",
        "status",
        "model_type",
        "ab_test_group",
        "cold",
        F.when(is_popular, size).cast("long").alias("popular_recs"),
        (size > F.greatest("top_k", F.lit(0))).cast("int").alias("too_many"),
    )


@query(
    "als_decayed_training_pairs",
    """
SELECT count(*) AS pairs, count(*) AS positive_pairs, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
       count(DISTINCT user_id) AS users_with_factors, count(DISTINCT item_id) AS items_with_factors
FROM train""",
)
def _(s):
    """No pair leaves training when its rating has decayed."""
    built = build_user_item_matrix(transforms.apply_time_decay(s.train))
    coordinates = stage(built.coordinates, "decayed")
    model = train_als(coordinates, QUERY_ALS)
    nonzero = lambda factors: factors.filter(F.exists("features", lambda x: x != 0)).agg(F.count(F.lit(1))).scalar()
    return coordinates.agg(
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("rating") > 0, F.lit(1))).alias("positive_pairs")
    ).select(
        "*",
        distinct_total(coordinates, "user_idx").alias("users"),
        distinct_total(coordinates, "item_idx").alias("items"),
        F.lit(nonzero(model.user_factors)).alias("users_with_factors"),
        F.lit(nonzero(model.item_factors)).alias("items_with_factors"),
    )


@query(
    "als_served_bought_items",
    """
SELECT model_type, count(*) AS requests, 0::BIGINT AS bought_items FROM routed
WHERE model_type IN ('als', 'rerank') GROUP BY 1""",
)
def _(s):
    """Personal answers hold nothing the user bought."""
    served = _als_served(s).filter(F.col("model_type").isin("als", "rerank"))
    flat = served.select("request_id", "user_id", "model_type", F.explode("recommendations").alias("r"))
    bought = features.purchases(s.stored_events).withColumn("_b", F.lit(1))
    return (
        flat.select("request_id", "user_id", "model_type", F.col("r.item_id").alias("item_id"))
        .join(bought, ["user_id", "item_id"], "left")
        .groupBy("model_type")
        .agg(F.count_distinct("request_id").alias("requests"), F.count("_b").alias("bought_items"))
    )


@query(
    "model_artifacts_roundtrip",
    """
SELECT 'user_index' AS part, count(DISTINCT user_id) AS n FROM train
UNION ALL SELECT 'item_index', count(DISTINCT item_id) FROM train
UNION ALL SELECT 'user_item', count(*) FROM train
UNION ALL SELECT 'popular', 100
UNION ALL SELECT 'purchases', count(*) FROM purchased
UNION ALL SELECT 'user_factors', count(DISTINCT user_id) FROM train
UNION ALL SELECT 'item_factors', count(DISTINCT item_id) FROM train""",
)
def _(s):
    t = Trained(s)
    folder = new_folder(s, "model")
    artifacts.save_model_artifacts(folder, t.model, t.matrix, s.popular, {"k": 5}, features.purchases(s.stored_events))
    saved = artifacts.load_model_artifacts(s.spark, folder)
    parts = {
        "user_index": saved.matrix.users,
        "item_index": saved.matrix.items,
        "user_item": saved.matrix.coordinates,
        "popular": saved.popular,
        "purchases": saved.purchases,
        "user_factors": saved.model.user_factors,
        "item_factors": saved.model.item_factors,
    }
    out = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
