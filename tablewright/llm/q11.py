"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.centroids import cluster_vectors


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 40 clusters after 5 rounds."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(clusters: int, rounds: int, dims: int) -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT * FROM (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS c, x AS y FROM v) WHERE c < {clusters})""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, c, d FROM (
    SELECT r, c, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM (
    SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{k} JOIN v USING (r), range(1, {dims + 1}) t(i) GROUP BY c, i) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} USING (c))""")
    return f"""WITH {", ".join(parts)},
t AS (SELECT c, sum(d) AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN t USING (c) JOIN c{rounds} USING (c)
"""


SQL = _sql(40, 5, 64)
