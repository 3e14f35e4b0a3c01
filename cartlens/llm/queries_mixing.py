"""Registered query of the source mix, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlens.llm import mixing
from cartlens.llm.frames import documents

#: Weights of the sources in order, over and over, and the most repetitions of a source.
WEIGHTS, MAX_EPOCHS, SEED = [1, 2, 3], 3.0, 12


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs, WEIGHTS), MAX_EPOCHS, SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS src, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('12|', coalesce(doc_id::VARCHAR, ''), '|', coalesce(md5(text), ''))) AS h FROM documents),
sources AS MATERIALIZED (
  SELECT src, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap,
         ((row_number() OVER (ORDER BY source IS NULL, src) - 1) % 3 + 1)::DOUBLE AS w FROM sized GROUP BY src, source),
total AS MATERIALIZED (SELECT sum(source_size)::DOUBLE AS t FROM sources),
rounds(k, rate, n) AS (
  SELECT 0, 0.0::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT k + 1, CASE WHEN f.weights > 0 THEN (t - f.used) / f.weights END, f.n
  FROM rounds, total, LATERAL (
    SELECT count(*) FILTER (WHERE rate * w >= cap) AS n, coalesce(sum(cap) FILTER (WHERE rate * w >= cap), 0) AS used,
           coalesce(sum(w) FILTER (WHERE rate * w < cap), 0) AS weights FROM sources) f
  WHERE f.n <> rounds.n AND rate IS NOT NULL),
plan AS MATERIALIZED (
  SELECT src, source_size, least(cap, coalesce((SELECT max(rate) FROM rounds), 0) * w) AS target FROM sources),
parts AS MATERIALIZED (
  SELECT src, source_size, target, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM plan),
hashes AS (
  SELECT src, h, count(*) AS n, sum(size) AS s, coalesce(sum(sum(size)) OVER (
    PARTITION BY src ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized GROUP BY 1, 2)
SELECT d.doc_id, d.size, p.source_size, p.target, (whole * d.size +
  greatest(least(floor(target + 0.5)::BIGINT - whole * source_size - before, s), 0) // n)::BIGINT AS taken
FROM sized d JOIN parts p USING (src) JOIN hashes USING (src, h)
"""
