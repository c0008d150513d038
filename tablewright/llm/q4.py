"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.embedding_dedup import near_vectors


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links within labels at a cosine of 0.98 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
good AS (
  SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT * FROM v)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.k AS a, b.k AS b FROM good a JOIN good b
    ON a.label = b.label AND a.k <> b.k AND len(a.x) = len(b.x)
    AND list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
reach AS (
  SELECT k AS a, k AS b FROM good
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN good ON b = k GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id,
  coalesce(v.vec_id = coalesce(component_id, v.vec_id), false) AS kept
FROM v LEFT JOIN good ON good.vec_id = v.vec_id AND good.label = v.label AND good.x = v.x
LEFT JOIN least ON least.a = k LEFT JOIN n ON n.a = k
"""
