"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.suffix_dedup import cut_repeats


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a smaller doc_id has."""
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
seg AS (SELECT doc_id, n, k, substr(h, 2000 * k + 1, 2098) AS s FROM d, range((SELECT max(n) // 1000 + 1 FROM d)) r(k) WHERE k * 1000 < n - 49),
p AS (SELECT doc_id, k * 1000 + j AS i, substr(s, 2 * j + 1, 100) AS w FROM seg, range(1000) r(j) WHERE k * 1000 + j <= n - 50),
m AS (SELECT w, min(doc_id) AS first FROM p GROUP BY w HAVING max(doc_id) > min(doc_id)),
hit AS (SELECT doc_id, i FROM p JOIN m USING (w) WHERE first < doc_id),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS f FROM hit),
run AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, g),
gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * gap.a + 1, 2 * (coalesce(z, n) - gap.a)), '' ORDER BY gap.a) AS k FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id),
total AS (SELECT doc_id, sum(b - a) AS r, count(*) AS c FROM span GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
