"""Command line: ``spark-submit`` or ``python -m cartlens JOB ...``.

Every setting of ``config.JobConfig`` can come from a JSON file (``--config``) whose nesting is that of the classes, and
from ``--set section.name=value``, which wins. What neither names keeps the preset of the job.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from cartlens.config import PRODUCTION, JobConfig
from cartlens.plans import jobs
from cartlens.session import configure
from cartlens.streaming import monitors


def merged(settings: Any, changes: Mapping[str, Any]) -> Any:
    """A copy of a settings object with nested changes; unknown names and wrong types are refused."""
    known = {f.name: getattr(settings, f.name) for f in dataclasses.fields(settings)}
    new: dict[str, Any] = {}
    for name, value in changes.items():
        if name not in known:
            raise ValueError(f"{type(settings).__name__} has no setting {name}; it has {', '.join(known)}")
        old = known[name]
        if dataclasses.is_dataclass(old):
            new[name] = merged(old, value)
        elif isinstance(old, bool) != isinstance(value, bool) or not isinstance(value, (type(old), int) if isinstance(old, float) else type(old)):
            raise ValueError(f"{name} is a {type(old).__name__}, not {value!r}")
        else:
            new[name] = type(old)(value)
    return dataclasses.replace(settings, **new)


def nested(assignments: list[str]) -> dict[str, Any]:
    """``["als.factors=8"]`` as ``{"als": {"factors": 8}}``; values are JSON."""
    out: dict[str, Any] = {}
    for text in assignments:
        name, _, value = text.partition("=")
        at = out
        *path, last = name.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = json.loads(value)
    return out


def settings(spark: SparkSession, preset: JobConfig, file: str | None, assignments: list[str]) -> JobConfig:
    if file:
        text = "\n".join(r["value"] for r in spark.read.text(file, wholetext=True).collect())  # one small file
        preset = merged(preset, json.loads(text))
    return merged(preset, nested(assignments))


# Job: (preset, required paths, optional switches with their type, call). The switches of a job are passed on by name.
Job = tuple[JobConfig, tuple[str, ...], dict[str, Callable[[str], Any]], Callable[..., Any]]


def _flag(text: str) -> bool:
    return {"yes": True, "no": False}[text]


def _experiments(spark: SparkSession, data: str, catalogue: str, config: JobConfig) -> dict[str, Any]:
    scored = jobs.run_experiments(spark, data, catalogue, config)
    return {name: {r["metric"]: r["value"] for r in table.collect()} for name, table in scored.items()}  # a row per metric


def _minutes(spark: SparkSession, log: str, output: str, config: JobConfig) -> str:
    monitors.write_closed_windows(monitors.minute_counts(monitors.read_log(spark, log)), output, available_now=True).awaitTermination()
    return output


JOBS: dict[str, Job] = {
    "artifacts": (JobConfig(), ("data", "catalogue"), {}, lambda s, d, c, config: jobs.create_artifacts(s, d, c, config.interactions.weights)),
    "train": (JobConfig(), ("data", "model"), {"split_mode": str, "run_id": str}, jobs.train_and_report),
    "train-production": (PRODUCTION, ("data", "model"), {}, jobs.train_production),
    "validate": (
        PRODUCTION,
        ("data", "catalogue", "report"),
        {"model_dir": str, "previous_metrics_path": str, "threshold": float, "validation_size": float, "targets_after_cutoff": _flag},
        jobs.validate_model,
    ),
    "experiments": (PRODUCTION, ("data", "catalogue"), {}, _experiments),
    "serve": (PRODUCTION, ("model", "catalogue", "requests", "answers"), {}, jobs.serve_requests),
    "ab-report": (PRODUCTION, ("events", "report"), {}, lambda s, e, r, config: jobs.ab_report(s, e, r)),
    "minutes": (PRODUCTION, ("log", "output"), {}, _minutes),
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cartlens", description=__doc__)
    kinds = parser.add_subparsers(dest="job", required=True)
    for name, (_, paths, switches, _) in JOBS.items():
        job = kinds.add_parser(name)
        for path in paths:
            job.add_argument(path)
        job.add_argument("--config", help="JSON file of settings")
        job.add_argument("--set", action="append", default=[], metavar="SECTION.NAME=VALUE", dest="assignments")
        for switch, kind in switches.items():
            job.add_argument(f"--{switch.replace('_', '-')}", type=kind)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    preset, paths, switches, call = JOBS[args.job]
    spark = configure(SparkSession.builder.appName(f"cartlens-{args.job}").getOrCreate())
    config = settings(spark, preset, args.config, args.assignments)
    given = {k: getattr(args, k) for k in switches if getattr(args, k) is not None}
    result = call(spark, *(getattr(args, p) for p in paths), config=config, **given)
    print(json.dumps(result, ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
