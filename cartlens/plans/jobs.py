"""Artifact, training, validation, A/B and experiment jobs."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.config import PRODUCTION, EventWeights, JobConfig
from cartlens.operators import abtest, features, metrics, popular, recommend, rerank, serving, splits, validation
from cartlens.operators.als import top_unseen, train_als
from cartlens.operators.matrix import build_user_item_matrix
from cartlens.sources import artifacts, readers
from cartlens.session import cleans_up, configure, stage


def clean_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """Validated events, written once because every job reads them several times."""
    return stage(validation.clean_events(readers.load_events(spark, data_dir)), "clean-events")


@cleans_up
def create_artifacts(
    spark: SparkSession, data_dir: str, artifacts_dir: str, weights: EventWeights = EventWeights()
) -> dict[str, Any]:
    """Five catalogue tables from the raw files; returns their paths and the counts of the report."""
    configure(spark)
    readers.check_data_folder(spark, data_dir).collect()  # one row per required file
    events = clean_events(spark, data_dir)
    properties = stage(
        validation.clean_item_properties(readers.load_item_properties(spark, data_dir)), "properties"
    )
    pairs = stage(features.user_item_pairs(events, weights), "pairs")
    # Written once: the walk down the tree reads it level by level.
    tree = stage(validation.clean_category_tree(readers.load_category_tree(spark, data_dir)), "tree")
    tables = {
        "item_availability": features.item_availability(properties),
        "item_popularity": features.item_popularity(events, weights, pairs),
        "category_tree": features.tree_with_levels(tree),
    }
    paths = artifacts.save_artifact_tables(tables, artifacts_dir)
    # The remaining tables read the ones just written instead of working them out again.
    saved = {name: spark.read.parquet(path) for name, path in paths.items()}
    categories = stage(features.latest_categories(properties), "categories")
    paths |= artifacts.save_artifact_tables(
        {
            "category_stats": features.category_stats(events, categories, pairs=pairs),
            "item_metadata": features.item_metadata(
                categories,
                saved["category_tree"].select("category_id", "level"),
                saved["item_availability"],
                saved["item_popularity"],
            ),
        },
        artifacts_dir,
    )
    artifacts.clear_artifact_cache()
    counts = features.artifact_counts(categories, saved["item_availability"]).first().asDict()
    return {"paths": paths, "counts": counts}


def _params(config: JobConfig) -> dict[str, Any]:
    return dataclasses.asdict(config)


@cleans_up
def train_and_report(
    spark: SparkSession,
    data_dir: str,
    artifacts_dir: str,
    config: JobConfig = JobConfig(),
    split_mode: str = "user",
    run_id: str = "run",
) -> dict[str, Any]:
    """Split, train, score and save: the training command."""
    configure(spark)
    events = clean_events(spark, data_dir)
    interactions = stage(features.build_interactions(events, config.interactions), "interactions")
    if split_mode == "user":
        marked = stage(splits.mark_split_per_user(interactions, config.test_size), "split")
        train, test = marked.filter("is_train").drop("is_train"), marked.filter("NOT is_train").drop("is_train")
    else:
        train, test = splits.temporal_split_global(interactions, config.test_size)
    matrix = build_user_item_matrix(train)
    model = train_als(matrix.coordinates, config.als)
    k = config.evaluation.k
    recs = stage(
        recommend.als_recommendations(model, matrix, test, k, least=recommend.MIN_TRAINER_LIST), "recommendations"
    )
    catalogue = train.agg(F.count_distinct("item_id").alias("n"))
    scored = [
        metrics.precision_recall_ndcg_at_k(test, recs, k),
        metrics.hit_rate_at_k(test, recs, k),
        metrics.coverage_at_k(recs, catalogue, k),
        metrics.novelty_at_k(recs, train, k),
    ]
    values = {r["metric"]: r["value"] for frame in scored for r in metrics.as_rows(frame).collect()}
    top = popular.top_popular_items(train, config.evaluation.popular_k)
    artifacts.save_model_artifacts(artifacts_dir, model, matrix, top, _params(config))
    report = {
        "run_id": run_id,
        "parameters": _params(config) | {"split_mode": split_mode},
        "metrics": values,
        "data_stats": features.split_stats(train, test).first().asDict(),
    }
    artifacts.save_json(spark, report, f"{artifacts_dir}/metrics/{run_id}_metrics.json")
    return report


@cleans_up
def train_production(
    spark: SparkSession, data_dir: str, artifacts_dir: str, config: JobConfig = PRODUCTION
) -> dict[str, Any]:
    """Train on all interactions and save everything serving needs."""
    configure(spark)
    events = clean_events(spark, data_dir)
    interactions = stage(features.build_interactions(events, config.interactions), "interactions")
    matrix = build_user_item_matrix(interactions)
    # training and the saved model read them
    matrix = dataclasses.replace(matrix, coordinates=stage(matrix.coordinates, "coordinates"))
    model = train_als(matrix.coordinates, config.als)
    top = popular.top_popular_items(interactions, config.evaluation.popular_k)
    artifacts.save_model_artifacts(artifacts_dir, model, matrix, top, _params(config), features.purchases(events))
    return artifacts.load_json(spark, f"{artifacts_dir}/metadata.json")


@cleans_up
def validate_model(
    spark: SparkSession,
    data_dir: str,
    catalogue_dir: str,
    report_path: str,
    config: JobConfig = PRODUCTION,
    model_dir: str | None = None,
    previous_metrics_path: str | None = None,
    threshold: float = 0.1,
    validation_size: float = 0.15,
    targets_after_cutoff: bool = False,
) -> dict[str, Any]:
    """Score a saved model, or one trained here, and stop on degradation.

    The previous metrics are read before the new ones are written, so both may use one path. Target pairs and the
    cold users' recent events come from before the cutoff unless ``targets_after_cutoff`` asks for later events.
    """
    configure(spark)
    previous = artifacts.previous_metrics(spark, previous_metrics_path) if previous_metrics_path else None
    events = clean_events(spark, data_dir)
    before, after = splits.validation_cutoff_split(events, validation_size)
    interactions = stage(features.build_interactions(before, config.interactions), "interactions")
    marked = stage(splits.mark_split_per_user(interactions, validation_size), "split")
    train, held_out = marked.filter("is_train").drop("is_train"), marked.filter("NOT is_train").drop("is_train")
    if model_dir:
        saved = artifacts.load_model_artifacts(spark, model_dir)
        model, matrix = saved.model, saved.matrix
    else:
        matrix = build_user_item_matrix(train)
        model = train_als(matrix.coordinates, config.als)
    top = popular.top_popular_items(train, config.evaluation.popular_k)
    metadata = artifacts.get_item_metadata(spark, catalogue_dir)
    stats = artifacts.get_category_stats(spark, catalogue_dir)
    tree = artifacts.get_category_tree(spark, catalogue_dir)
    source = after if targets_after_cutoff else before
    actions = source.filter(F.col("event").isin("addtocart", "transaction"))
    k = config.evaluation.k
    n = max(config.evaluation.recall_k, 4 * k)
    recs, counts = recommend.generate_recommendations(model, matrix, held_out, top, n, metadata, features.events_of_pairs(before, train))
    recs = rerank.category_rerank(
        recs,
        features.user_history(train, metadata),
        metadata,
        stats,
        tree,
        top_k=n,
        alpha=config.rerank.alpha,
        beta=config.rerank.beta,
        adaptive=config.rerank.adaptive,
    )
    recs = stage(recs, "recommendations")
    target = stage(features.target_pairs(held_out, actions), "targets")
    catalogue = train.agg(F.count_distinct("item_id").alias("n"))
    scored = metrics.compute_all_metrics(held_out, recs, train, catalogue, k, metadata, target, actions)
    artifacts.save_metrics(scored, report_path)
    current = artifacts.load_metrics(spark, report_path)
    if previous is not None:
        metrics.degradation_gate(metrics.check_degradation(current, previous, threshold), target)
    return {"metrics": {r["metric"]: r["value"] for r in current.collect()}, **counts.first().asDict()}


@cleans_up
def serve_requests(
    spark: SparkSession, model_dir: str, catalogue_dir: str, requests_path: str, answers_path: str, config: JobConfig = PRODUCTION
) -> dict[str, int]:
    """Answer a table of requests from a saved model and catalogue; returns the answers by route.

    Candidates go as deep as the longest list that the batch asks for.
    """
    configure(spark)
    saved = artifacts.load_model_artifacts(spark, model_dir)
    matrix, metadata = saved.matrix, artifacts.get_item_metadata(spark, catalogue_dir)
    routed = stage(serving.route_requests(spark.read.parquet(requests_path), matrix.users), "routed")
    people = routed.filter(F.col("model_type").isin("als", "rerank")).select("user_id")
    best = stage(top_unseen(saved.model, matrix, people, serving.batch_depth(routed)), "candidates")
    pairs = matrix.coordinates.join(matrix.users.join(people.distinct(), "user_id", "left_semi"), "user_idx").join(matrix.items, "item_idx")
    lists = serving.personal_lists(
        routed,
        best.withColumnRenamed("rank", "cand_rank"),
        saved.purchases,
        F.lit(matrix.items.agg(F.count(F.lit(1)).alias("n")).scalar()),
        features.user_history(pairs, metadata),
        metadata,
        artifacts.get_category_stats(spark, catalogue_dir),
        artifacts.get_category_tree(spark, catalogue_dir),
    )
    serving.answer_requests(routed, lists, saved.popular).write.mode("overwrite").parquet(answers_path)
    answers = spark.read.parquet(answers_path)
    counts = answers.groupBy(F.coalesce("model_type", F.lit("rejected")).alias("route")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["route"]: r["n"] for r in counts}  # one row per route


@cleans_up
def ab_report(spark: SparkSession, events_path: str, output_path: str | None = None) -> dict[str, Any]:
    """Metrics by arm, their comparison and the text summary, saved as JSON when a path is given."""
    events = abtest.adapt_service_log(readers.load_ab_events(spark, events_path))
    # Two rows of totals: everything after them is tiny.
    totals = stage(abtest.business_metrics(events), "ab-totals")
    comparison = abtest.compare_arms(totals)
    report = {
        "metrics": [r.asDict() for r in totals.collect()],
        "comparison": [r.asDict() for r in comparison.collect()],
        "summary": abtest.summary_text(abtest.summary_lines(totals, comparison)).first()["summary"],
    }
    if output_path:
        artifacts.save_json(spark, report, output_path)
    return report


def run_experiments(
    spark: SparkSession, data_dir: str, catalogue_dir: str, config: JobConfig = PRODUCTION
) -> dict[str, DataFrame]:
    """The three compared models on one split: popularity, ALS, and re-ranked ALS; metrics per model."""
    configure(spark)
    events = clean_events(spark, data_dir)
    interactions = stage(features.build_interactions(events, config.interactions), "interactions")
    marked = stage(splits.mark_split_per_user(interactions, config.test_size), "split")
    train, test = marked.filter("is_train").drop("is_train"), marked.filter("NOT is_train").drop("is_train")
    ties = ("item_id", "event", "transaction_id")
    test_events = stage(splits.temporal_split_per_user(events, config.test_size, ties)[1], "test-events")
    target = stage(features.target_pairs(test, test_events), "targets")
    metadata = artifacts.get_item_metadata(spark, catalogue_dir)
    catalogue = train.agg(F.count_distinct("item_id").alias("n"))
    k = config.evaluation.k
    best = popular.top_popular_items_by_cart(features.events_of_pairs(events, train), config.evaluation.popular_k)
    matrix = build_user_item_matrix(train)
    model = train_als(matrix.coordinates, config.als)
    als = stage(recommend.als_recommendations(model, matrix, test, k), "als-lists")
    reranked = rerank.category_rerank(
        als,
        features.user_history(train, metadata),
        metadata,
        artifacts.get_category_stats(spark, catalogue_dir),
        artifacts.get_category_tree(spark, catalogue_dir),
        top_k=recommend.MIN_LIST,
        alpha=config.rerank.alpha,
        beta=config.rerank.beta,
        adaptive=config.rerank.adaptive,
    )
    lists = {
        "baseline": stage(popular.popular_for_users(test, best, recommend.MIN_LIST), "baseline-lists"),
        "als": als,
        "rerank": stage(reranked, "reranked-lists"),
    }
    return {
        name: stage(
            metrics.compute_all_metrics(test, recs, train, catalogue, k, metadata, target, test_events), f"metrics-{name}"
        )
        for name, recs in lists.items()
    }
