"""Connected components of a link table by alternating star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.session import stage

MAX_ROUNDS = 40
SMALL = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _unfolded(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each pair of columns; unlike a union it keeps the rows' partitions."""
    made = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))
    return rows.select(F.explode(made).alias("e")).select("e.u", "e.v")


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long). Returns node, component: the smallest node reachable, for every node with a link.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest neighbour it knows; the
    number of rounds grows with the logarithm of the longest path. A node's neighbours are reduced by aggregation and
    joined back, so none are gathered in one place. Every round is written to the shared folder. The rounds end when the
    number of edges and the sum of their hashes stay. Up to SMALL edges, a few megabytes, stay in one partition, which
    spares their exchanges.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    few = state[0] <= SMALL
    for _ in range(MAX_ROUNDS):
        edges = edges.coalesce(1) if few else edges
        both = _unfolded(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _unfolded(large.join(low, "u"), ("u", "m"), ("v", "m"))
            .filter("u <> v")
            .distinct()
        )
        edges, before = stage(small, "links"), state
        state = _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def slim(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast where it has at most SMALL rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs a, b with c_a and c_b, null for what has no label. labels: a written table."""
    few = slim(labels)
    side = lambda c: few.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of the links behind the labels together with more links.

    Only the links between different components are worked out, as links of the components.
    """
    known = with_components(links, labels)
    between = known.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    new = stage(components(between), "components")
    moved = labels.join(slim(new).select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = new.join(slim(labels).select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(alone.select("node", "component"))
