"""Registration of queries and assembly of their SQL twins from named views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.catalog.sqlviews import RECURSIVE_VIEWS, VIEWS
from cartlens.sources.views import ShopViews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def with_views(body: str) -> str:
    """``body`` behind the WITH list of every view it needs, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(_WORD.findall(text)) & VIEWS.keys() - needed:
            needed.add(word)
            visit(VIEWS[word])

    visit(body)
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    if not needed:
        return body
    parts = []
    for name in VIEWS:  # written in dependency order
        if name in needed:
            once = "" if name in RECURSIVE_VIEWS else "MATERIALIZED "
            parts.append(f"{name} AS {once}({VIEWS[name]})")
    head = "WITH RECURSIVE" if needed & RECURSIVE_VIEWS else "WITH"
    return head + " " + ",\n".join(parts) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register a function of the shop views as a query; ``oracle`` is its SQL over the named views."""

    def register(build: Callable[[ShopViews], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(build(ShopViews(spark, folder)))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return build

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns rounded so that the order of summing does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
