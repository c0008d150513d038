"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.secret_scan import KINDS, LEAST_RUN, LEAST_VALUE, NEEDS, PATTERNS, REACH, ROLE, SCOPE_END, scan_secrets


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the spans of their secrets."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _matches(place: int, pattern: str) -> str:
    """Rows (r, place, a, b, m, g) of a pattern: matches are marked in the text, which is then cut at the marks."""
    quoted = pattern.replace("'", "''")
    group = f"regexp_extract(m, '{quoted}', 2)" if "])" in pattern and pattern.startswith("(") and "://" not in pattern else "''"
    return f"""
  SELECT r, {place} AS place, a, a + length(m) AS b, m, {group} AS g FROM (
    SELECT r, i, split_part(piece, chr(2), 1) AS m,
      CAST(sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) - length(piece) + 1 AS BIGINT) AS a
    FROM (SELECT r, unnest(s) AS piece, generate_subscripts(s, 1) AS i
      FROM (SELECT r, string_split(regexp_replace(text, '{quoted}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS s FROM d))
    ) WHERE i > 1"""


def _sql() -> str:
    hits = " UNION ALL ".join(_matches(p, pattern) for p, (_, pattern, _) in enumerate(PATTERNS))
    kinds = ", ".join(f"({p}, {kind}, {ROLE[kind]})" for p, (kind, _, _) in enumerate(PATTERNS))
    needs = ", ".join(f"({kind}, {role})" for kind, roles in NEEDS.items() for role in roles)
    names = ", ".join(f"'{k}'" for k in KINDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text FROM documents),
kinds(place, kind, role) AS (VALUES {kinds}), needs(kind, role) AS (VALUES {needs}),
hits AS ({hits}),
hit AS (SELECT * FROM hits JOIN kinds USING (place) WHERE CASE place WHEN 1 THEN b - a >= 20 WHEN 2 THEN b - a >= 24 WHEN 3 THEN true WHEN 4 THEN true
  WHEN 6 THEN b - a >= {LEAST_RUN} AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE length(g) >= {LEAST_VALUE} END),
free AS (SELECT * FROM hit h WHERE place < 3 OR NOT EXISTS (SELECT 1 FROM hit o WHERE o.r = h.r AND o.place < h.place AND o.a < h.b AND h.a < o.b)),
blanks AS ({_matches(9, SCOPE_END)}),
part AS (SELECT r, kind, role, a, b, (SELECT count(*) FROM blanks WHERE blanks.r = free.r AND blanks.a < free.a) AS scope FROM free),
kept AS (SELECT r, kind, a, b FROM part p WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM needs n WHERE n.kind = p.kind AND NOT EXISTS (
  SELECT 1 FROM part o WHERE o.r = p.r AND o.scope = p.scope AND o.role = n.role AND o.a - p.b <= {REACH} AND p.a - o.b <= {REACH}))),
said AS (SELECT r, string_agg([{names}][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
  string_agg([{names}][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
  count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2 FROM kept GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (r)
"""


SQL = _sql()
