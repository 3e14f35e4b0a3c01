"""Registered queries with their SQL twins."""

from __future__ import annotations

import importlib

from cartlens.catalog.registry import ORACLES, QUERIES

_AREAS = (
    "cleaning",
    "features",
    "splits",
    "popularity",
    "ranking",
    "serving",
    "quality",
    "abtest",
    "monitoring",
    "streams",
    "exploration",
    "files",
    "models",
    "jobs",
)
for _area in _AREAS:
    importlib.import_module(f"cartlens.catalog.{_area}")

__all__ = ["ORACLES", "QUERIES"]
