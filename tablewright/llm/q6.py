"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.license_scan import marks_of, scan_licenses, template_rows


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    known = ", ".join(
        f"('{name}', [{', '.join(repr(p) for p in pairs)}], " + ", ".join(f"CAST({words} AS VARCHAR[])" for words in marks_of(name)) + ")" for name, pairs in template_rows()
    )
    return rf"""
WITH known(license, pairs, needed, refused) AS (VALUES {known}),
d AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, 'line' AS unit_kind, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS unit_no FROM d),
paragraphs AS (
  SELECT doc_id, 'paragraph' AS unit_kind, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS x,
    unnest(range(len(regexp_split_to_array(text, '\n[ \t]*\n')))) AS unit_no FROM d),
units AS (SELECT * FROM lines UNION ALL SELECT * FROM paragraphs WHERE contains(trim(x), chr(10))),
words AS (
  SELECT doc_id, unit_kind, unit_no, string_split(trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
paired AS (
  SELECT doc_id, unit_kind, unit_no, list_distinct(w) AS own, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
  FROM words WHERE len(w) >= 2)
SELECT doc_id, unit_kind, CAST(unit_no AS INTEGER) AS unit_no, license,
  max(2.0::DOUBLE * len(list_intersect(paired.pairs, known.pairs)) / (len(paired.pairs) + len(known.pairs))) AS dice
FROM paired JOIN known ON 3 * len(paired.pairs) >= 2 * len(known.pairs) AND 2 * len(paired.pairs) <= 3 * len(known.pairs)
  AND len(list_intersect(own, needed)) = len(needed) AND len(list_intersect(own, refused)) = 0
GROUP BY ALL HAVING dice >= 0.8
"""


SQL = _sql()
