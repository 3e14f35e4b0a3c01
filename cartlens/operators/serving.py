"""Batch answers to recommendation requests.

Requests: request_id, user_id, top_k, use_rerank, use_baseline, ab_test_group. Each gets a status, a route and a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.columns import md5_bucket
from cartlens.operators.popular import popular_array
from cartlens.operators.rerank import category_rerank

MAX_TOP_K = 500
# Blend used when lists are re-ranked for serving.
SERVING_ALPHA, SERVING_BETA = 0.6, 0.4
_LIST = ("user_id", "top_k", "reranked")


def request_status(requests: DataFrame) -> DataFrame:
    """200, 400 for top_k outside 1..500, 404 for a negative user."""
    return requests.withColumn(
        "status",
        F.when(~F.col("top_k").between(1, MAX_TOP_K), F.lit(400)).when(F.col("user_id") < 0, F.lit(404)).otherwise(F.lit(200)),
    )


def assign_group(requests: DataFrame) -> DataFrame:
    """``arm`` (als or baseline) and the reported group.

    "auto" draws a fair, repeatable side from the request key; "baseline" or use_baseline picks the baseline.
    """
    drawn = F.when(md5_bucket(F.col("request_id").cast("string"), 2) == 0, F.lit("baseline")).otherwise(F.lit("als"))
    group = F.when(F.col("ab_test_group") == "auto", drawn).otherwise(F.col("ab_test_group"))
    baseline = F.coalesce(group == "baseline", F.lit(False)) | F.coalesce(F.col("use_baseline"), F.lit(False))
    arm = F.when(baseline, F.lit("baseline")).otherwise(F.lit("als"))
    return requests.withColumn("arm", arm).withColumn("ab_test_group", F.coalesce(group, arm))


def route_requests(requests: DataFrame, known_users: DataFrame, rerank_enabled: bool = True) -> DataFrame:
    """Adds ``model_type``: baseline, fallback (unknown user), rerank or als; null for rejected requests."""
    flags = known_users.select("user_id").distinct().withColumn("_known", F.lit(True))
    wants_rerank = F.coalesce(F.col("use_rerank"), F.lit(rerank_enabled))
    return (
        assign_group(request_status(requests))
        .join(flags, "user_id", "left")
        .withColumn(
            "model_type",
            F.when(F.col("status") != 200, F.lit(None).cast("string"))
            .when(F.col("arm") == "baseline", F.lit("baseline"))
            .when(F.col("_known").isNull(), F.lit("fallback"))
            .when(wants_rerank, F.lit("rerank"))
            .otherwise(F.lit("als")),
        )
        .drop("_known")
    )


def popular_answer() -> Column:
    """The first top_k items of the ``_popular`` array with score 0; a slice, no join."""
    return F.transform(
        F.slice(F.col("_popular"), F.lit(1), F.greatest(F.col("top_k"), F.lit(0))),
        lambda e: F.struct(e["item_id"].alias("item_id"), F.lit(0.0).alias("score")),
    )


def candidate_depth(top_k: int) -> int:
    """Unseen candidates a request can need: three lists, and two more to make up for bought items."""
    return 5 * top_k


def batch_depth(routed: DataFrame) -> int:
    """Candidates that the longest personal list of a batch can need."""
    personal = routed.filter(F.col("model_type").isin("als", "rerank"))
    return candidate_depth(personal.agg(F.coalesce(F.max("top_k"), F.lit(1)).alias("k")).first()["k"])


def personal_lists(
    routed: DataFrame,
    candidates: DataFrame,
    purchases: DataFrame | None,
    n_items: Column,
    history: DataFrame,
    metadata: DataFrame,
    stats: DataFrame,
    tree: DataFrame,
) -> DataFrame:
    """(user_id, top_k, reranked, item_id, score, rank) for every distinct list the requests ask for.

    ``candidates`` are unseen items (user_id, item_id, score, cand_rank), at least ``candidate_depth(top_k)`` deep.
    Requests collapse to distinct lists first, so a user asking a million times is worked out once. Of ``history`` only
    the rows of users who ask for a re-ranked list are looked at.
    """
    lists = (
        routed.filter(F.col("model_type").isin("als", "rerank"))
        .select("user_id", "top_k", (F.col("model_type") == "rerank").alias("reranked"))
        .distinct()
    )
    first = F.when(F.col("reranked"), F.col("top_k") * 2).otherwise(F.col("top_k")) if purchases is None else F.col("top_k") * 3
    # no list takes more: at most top_k items are missing, and two more candidates make up for each
    if purchases is None:
        candidates = candidates.withColumn("_bought", F.lit(False))
    else:
        # before the lists, which share candidates; after them all that follows stays by user
        bought = purchases.select("user_id", "item_id").distinct().withColumn("_bought", F.lit(True))
        candidates = candidates.join(bought, ["user_id", "item_id"], "left").fillna({"_bought": False})
    pool = lists.join(candidates, "user_id").filter(F.col("cand_rank") <= first + 2 * F.greatest(F.col("top_k"), F.lit(0)))
    # One window per list: at most five list lengths of candidates.
    one_list = Window.partitionBy(*_LIST)
    free = pool.withColumn("_first", first.cast("long")).withColumn(
        "_got", F.count(F.when(~F.col("_bought") & (F.col("cand_rank") <= F.col("_first")), F.lit(1))).over(one_list)
    )
    missing = F.greatest(F.col("top_k") - F.col("_got"), F.lit(0))
    depth = F.when(F.col("_first") < n_items, F.col("_first") + 2 * missing).otherwise(F.col("_first"))
    in_order = one_list.orderBy("cand_rank")
    taken = (
        free.filter(~F.col("_bought") & (F.col("cand_rank") <= depth))
        .withColumn("rank", F.row_number().over(in_order))
        # deeper candidates only fill up to top_k
        .filter((F.col("cand_rank") <= F.col("_first")) | (F.col("rank") <= F.col("top_k")))
        .select(*_LIST, "item_id", "score", "rank")
    )
    plain = taken.filter(~F.col("reranked") & (F.col("rank") <= F.col("top_k")))
    asking = lists.filter("reranked").select("user_id").distinct()
    reordered = category_rerank(
        taken.filter(F.col("reranked")),
        history.join(asking, "user_id", "left_semi"),
        metadata,
        stats,
        tree,
        top_k=F.col("top_k"),
        alpha=SERVING_ALPHA,
        beta=SERVING_BETA,
        list_keys=_LIST,
    )
    return plain.unionByName(reordered)


def answer_requests(routed: DataFrame, lists: DataFrame, popular: DataFrame) -> DataFrame:
    """One row per request: recommendations, cold, model_type, ab_test_group, status.

    Popular and rejected answers need no join. Personal answers meet their requests as one array per distinct list.
    """
    nested = lists.groupBy(*_LIST).agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("_ranked")
    ).select(*_LIST, F.transform("_ranked", lambda e: F.struct(e["item_id"].alias("item_id"), e["score"].alias("score"))).alias("_personal"))
    is_popular = F.col("model_type").isin("baseline", "fallback")
    is_personal = F.coalesce(F.col("model_type").isin("als", "rerank"), F.lit(False))
    personal = routed.filter(is_personal).withColumn("reranked", F.col("model_type") == "rerank")
    others = routed.filter(~is_personal).withColumn("_personal", F.lit(None).cast(nested.schema["_personal"].dataType))
    return (
        personal.join(nested, list(_LIST), "left")
        .drop("reranked")
        .unionByName(others)
        .withColumn("_popular", popular_array(popular))  # after the join, so that no array is shuffled
        .withColumn("recommendations", F.when(is_popular, popular_answer()).otherwise(F.col("_personal")))
        .withColumn("cold", F.when(F.col("model_type").isNotNull(), is_popular))
        .select("request_id", "user_id", "top_k", "status", "recommendations", "cold", "model_type", "ab_test_group")
    )


def impressions(served: DataFrame) -> DataFrame:
    """Impressions per model type: popular answers count top_k, personal ones the items returned."""
    shown = F.when(F.col("model_type").isin("baseline", "fallback"), F.col("top_k")).otherwise(
        F.coalesce(F.size("recommendations"), F.lit(0))
    )
    return served.filter(F.col("status") == 200).groupBy("model_type").agg(F.sum(shown).alias("impressions"))
