"""Registered query of the conversation trie, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import trie
from cartlens.llm.frames import table

#: Conversations of one hundred begin with turns of the first of them, fewer than HEADS.
FAMILY, HEADS = 100, 6


def rebuilt(paths: DataFrame) -> DataFrame:
    """Every conversation with its first h turns from the first conversation of its hundred, h by crc32 of its id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = paths.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    own = paths.withColumn("_first", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("_h", h)
    joined = own.join(heads.filter(F.col("_first") % FAMILY == 0), "_first", "left")
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return trie.nodes(rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH own AS MATERIALIZED (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce("text", '')} ORDER BY turn NULLS FIRST, role, "text") AS u,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
built AS MATERIALIZED (
  SELECT o.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE list_slice(b.u, 1, o.h) END, list_slice(o.u, o.h + 1, len(o.u))) AS u
  FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
pre AS MATERIALIZED (
  SELECT c, d, md5(to_json(list_slice(u, 1, d))::VARCHAR) AS p, len(u) = d AS ends, CASE WHEN d > 0 THEN length(u[d].t) ELSE 0 END AS size
  FROM (SELECT c, u, unnest(range(len(u) + 1)) AS d FROM built)),
node AS MATERIALIZED (
  SELECT p, d, min(c) AS k, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM pre GROUP BY p, d),
way AS MATERIALIZED (SELECT pre.c, pre.d, node.k FROM pre JOIN node USING (p, d)),
child AS MATERIALIZED (SELECT way.k, way.d, count(*) AS n FROM node JOIN way ON way.c = node.k AND way.d = node.d - 1 GROUP BY 1, 2),
below AS (
  SELECT way.k, way.d, count(*) FILTER (WHERE child.n IS NULL) AS n_leaves, sum((node.n - 1) * node.size)::BIGINT AS saved
  FROM node JOIN way ON way.c = node.k AND way.d <= node.d LEFT JOIN child ON child.k = node.k AND child.d = node.d GROUP BY 1, 2)
SELECT node.k AS conv_id, node.d AS depth, up.k AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children,
       n_leaves, saved AS saved_tokens, ends_sha256
FROM node JOIN below ON below.k = node.k AND below.d = node.d LEFT JOIN child ON child.k = node.k AND child.d = node.d
LEFT JOIN way up ON up.c = node.k AND up.d = node.d - 1
"""
