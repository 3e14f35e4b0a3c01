import json
import os
import random

import numpy as np
import pytest

from cartlens import __main__ as command
from cartlens.config import AlsConfig, EvalConfig, InteractionConfig, JobConfig
from cartlens.operators import popular
from cartlens.plans import jobs
from cartlens.session import shared_folder
from cartlens.sources import artifacts, readers

START = 1_400_000_000_000
CONFIG = JobConfig(
    interactions=InteractionConfig(2, 2),
    als=AlsConfig(factors=8, iterations=6, regularization=0.05, alpha=4.0),
    evaluation=EvalConfig(popular_k=20),
    test_size=0.25,
)


def planted(users=60, groups=5, items=12):
    """Users keep to one of five item groups, with an occasional view outside."""
    rnd = random.Random(7)
    rows = []
    for user in range(1, users + 1):
        own = [100 * (user % groups + 1) + i for i in range(items)]
        for step, item in enumerate(rnd.sample(own, 9)):
            event = ("view", "addtocart", "transaction")[step % 3]
            rows.append((START + user * 1000 + step * 86_400_000, user, item, event, "7" if event == "transaction" else ""))
        rows.append((START + user, user, 100 * rnd.randint(1, groups) + rnd.randrange(items), "view", ""))
    return rows


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shop")
    events = planted()
    lines = ["timestamp,visitorid,itemid,event,transactionid"] + [",".join(map(str, r)) for r in events]
    (folder / readers.EVENTS_FILE).write_text("\n".join(lines) + "\n")
    items = sorted({r[2] for r in events})
    head = "timestamp,itemid,property,value"
    first = [f"{START},{i},categoryid,{i // 100}" for i in items]
    second = [f"{START},{i},available,{i % 2}" for i in items] + [f"{START},{i},790,n1.000" for i in items]
    (folder / readers.PROPERTY_FILES[0]).write_text("\n".join([head, *first]) + "\n")
    (folder / readers.PROPERTY_FILES[1]).write_text("\n".join([head, *second]) + "\n")
    (folder / readers.TREE_FILE).write_text("categoryid,parentid\n9,\n" + "".join(f"{c},9\n" for c in range(1, 6)))
    return str(folder)


@pytest.fixture(scope="module")
def catalogue(spark, shop, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("catalogue"))
    made = jobs.create_artifacts(spark, shop, folder)
    assert made["counts"]["n_categories"] == 5
    assert set(made["paths"]) == set(artifacts.ARTIFACT_COLUMNS)
    return folder


def test_missing_input_is_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.check_data_folder(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.load_events(spark, str(tmp_path))


def test_malformed_events_fail(spark, tmp_path):
    (tmp_path / readers.EVENTS_FILE).write_text("timestamp,visitorid,itemid,event,transactionid\nx,1,1,view,\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.load_events(spark, str(tmp_path)).collect()


def test_artifacts_are_checked_and_cached(spark, catalogue):
    artifacts.clear_artifact_cache()
    one = artifacts.get_item_metadata(spark, catalogue)
    assert artifacts.load_artifact_cached(spark, f"{catalogue}/item_metadata.parquet") is one
    assert {r["level"] for r in artifacts.get_category_tree(spark, catalogue).collect()} == {1, 2}
    broken = f"{catalogue}/broken"
    spark.range(1).write.parquet(f"{broken}/category_stats.parquet")
    with pytest.raises(ValueError):
        artifacts.get_category_stats(spark, broken)
    for i in range(artifacts.CACHE_SIZE + 2):
        spark.range(1).write.parquet(f"{broken}/t{i}.parquet")
        artifacts.load_artifact_cached(spark, f"{broken}/t{i}.parquet")
    assert len(artifacts._cache) == artifacts.CACHE_SIZE
    artifacts.clear_artifact_cache()


@pytest.mark.parametrize("mode", ["user", "global"])
def test_training_report(spark, shop, tmp_path, mode):
    report = jobs.train_and_report(spark, shop, str(tmp_path), CONFIG, split_mode=mode)
    assert set(report["metrics"]) >= {"precision@k", "recall@k", "ndcg@k", "hit_rate@k", "coverage@k", "novelty@k"}
    assert report["data_stats"]["n_users_in_model"] == report["data_stats"]["train_users"]
    saved = artifacts.load_json(spark, f"{tmp_path}/metrics/run_metrics.json")
    assert saved["parameters"]["split_mode"] == mode


def test_production_model_round_trip(spark, shop, tmp_path):
    made = jobs.train_production(spark, shop, str(tmp_path), CONFIG)
    saved = artifacts.load_model_artifacts(spark, str(tmp_path))
    assert made["shape"]["n_users"] == saved.matrix.users.count() == 60
    assert made["has_purchases"] and saved.purchases.count() == 180
    assert saved.params["als"]["factors"] == 8


def test_models_beat_popularity_on_planted_groups(spark, shop, catalogue):
    scored = jobs.run_experiments(spark, shop, catalogue, CONFIG)
    recall = {name: {r["metric"]: r["value"] for r in df.collect()}["recall@20"] for name, df in scored.items()}
    assert recall["als"] > recall["baseline"] and recall["rerank"] > recall["baseline"]


def test_validation_reads_the_old_metrics_first(spark, shop, catalogue, tmp_path):
    report = f"{tmp_path}/metrics.json"
    spark.createDataFrame([("recall@20", 1e6)], artifacts.METRICS_SCHEMA).write.json(report)
    # fewer than 100 target pairs: degraded, but not blocked
    first = jobs.validate_model(spark, shop, catalogue, report, CONFIG, previous_metrics_path=report)
    assert first["warm_users"] > 0
    assert {"precision@10", "recall@10", "hit_rate@10"} <= set(first["metrics"])
    again = jobs.validate_model(spark, shop, catalogue, report, CONFIG, previous_metrics_path=report)
    assert again["metrics"].keys() == first["metrics"].keys()


def test_ab_report(spark, tmp_path):
    rows = [(1, 1, "impression", "als", 0.0), (1, 1, "click", "als", 0.0), (2, 1, "impression", "baseline", 0.0)]
    path = f"{tmp_path}/log.parquet"
    spark.createDataFrame(rows, "user_id bigint, item_id bigint, event_type string, model_type string, revenue double").write.parquet(path)
    report = jobs.ab_report(spark, path, f"{tmp_path}/report.json")
    assert report["summary"].count("\n") == 24
    assert artifacts.load_json(spark, f"{tmp_path}/report.json")["comparison"] == report["comparison"]


def test_artifact_cache_sees_rewritten_tables(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    first = artifacts.load_artifact_cached(spark, path)
    assert artifacts.load_artifact_cached(spark, path) is first and first.count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert artifacts.load_artifact_cached(spark, path).count() == 5
    artifacts.clear_artifact_cache()


def test_popular_list_of_unknown_users(spark, frame):
    lists = popular.popular_unseen(
        frame([(1,), (2,)], "user_id bigint"),
        frame([(1, 2.0, 1), (2, 1.0, 2)], "item_id bigint, score double, pop_rank int"),
        frame([(1, 1)], "user_id bigint, item_id bigint"),
        5,
    )
    assert sorted(tuple(r) for r in lists.collect()) == [(1, 2, 1), (2, 1, 1), (2, 2, 2)]


def test_served_requests_from_saved_artifacts(spark, shop, catalogue, tmp_path):
    jobs.train_production(spark, shop, f"{tmp_path}/model", CONFIG)
    rows = [(1, 1, 5, True, False, "als"), (2, 1, 500, False, False, "als"), (3, 10**6, 7, None, False, "als"), (4, 2, 3, None, True, None), (5, 2, 0, None, False, None), (6, -1, 5, None, False, None), (7, 3, 500, True, False, None)]
    schema = "request_id bigint, user_id bigint, top_k int, use_rerank boolean, use_baseline boolean, ab_test_group string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/requests")
    before = set(_staged(spark))
    counts = jobs.serve_requests(spark, f"{tmp_path}/model", catalogue, f"{tmp_path}/requests", f"{tmp_path}/answers", CONFIG)
    assert set(_staged(spark)) == before  # nothing is left behind
    assert counts == {"rerank": 2, "als": 1, "fallback": 1, "baseline": 1, "rejected": 2}
    saved = artifacts.load_model_artifacts(spark, f"{tmp_path}/model")
    bought = {(r["user_id"], r["item_id"]) for r in saved.purchases.collect()}
    n_items, seen = saved.matrix.items.count(), {}
    for r in saved.matrix.coordinates.join(saved.matrix.users, "user_idx").join(saved.matrix.items, "item_idx").collect():
        seen.setdefault(r["user_id"], set()).add(r["item_id"])
    answers = {r["request_id"]: r for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    for r in answers.values():
        items = [x["item_id"] for x in r["recommendations"] or []]
        assert len(items) == len(set(items)) <= max(r["top_k"], 0)
        if r["model_type"] in ("als", "rerank"):
            assert not {(r["user_id"], i) for i in items} & bought and not set(items) & seen[r["user_id"]]
            assert len(items) == min(r["top_k"], n_items - len(seen[r["user_id"]]))
    assert [answers[i]["status"] for i in range(1, 8)] == [200, 200, 200, 200, 400, 404, 200]
    assert [answers[i]["cold"] for i in range(1, 8)] == [False, False, True, True, None, None, False]


def _staged(spark):
    folder = f"{shared_folder(spark)}/cartlens"
    return os.listdir(folder) if os.path.isdir(folder) else []


def test_settings_from_file_and_command(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"als": {"factors": 12, "alpha": 3}, "interactions": {"weights": {"view": 2.0}}}))
    made = command.settings(spark, JobConfig(), str(tmp_path / "c.json"), ["als.factors=9", "rerank.adaptive=false", "test_size=0.5"])
    assert (made.als.factors, made.als.alpha, made.interactions.weights.view, made.rerank.adaptive, made.test_size) == (9, 3.0, 2.0, False, 0.5)
    assert made.als.iterations == JobConfig().als.iterations
    for wrong in ("als.factor=9", "als.factors=1.5", "rerank.adaptive=1", "test_size=true"):
        with pytest.raises(ValueError):
            command.settings(spark, JobConfig(), None, [wrong])


def test_commands_run(spark, shop, tmp_path, capsys):
    command.main(["artifacts", shop, f"{tmp_path}/catalogue"])
    small = [x for a in ("als.factors=4", "als.iterations=2", "interactions.min_user_interactions=2", "interactions.min_item_interactions=2") for x in ("--set", a)]
    command.main(["experiments", shop, f"{tmp_path}/catalogue", *small])
    command.main(["validate", shop, f"{tmp_path}/catalogue", f"{tmp_path}/report", "--targets-after-cutoff", "yes", *small])
    assert "recall@20" in capsys.readouterr().out
