"""Query of operator 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.conversation_repair import repair_conversations


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after damage, conv_id of the dropped rows). The fault is crc32(`conv_id:turn`) % 20, nulls as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("fault", F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20)
    kept = rows.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return kept.drop("col"), rows.filter("fault = 0").select("conv_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    kept, dropped = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return repair_conversations(kept, dropped)


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
f AS (
  SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[1 + CAST(xor(a, b) & 255 AS INTEGER)])), 4294967295) % 20 AS fault FROM c, bits),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, range(2) t(i) WHERE fault <> 0 AND (i = 0 OR fault = 3)),
o AS (
  SELECT *, row_number() OVER w AS t, coalesce(lag(role[1]) OVER w || role[1] NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY t) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(q, i, z, line) AS (VALUES (0, '', 0, ''), (1, '', 1, ''), (2, '', 2, ''), (3, '', 3, ''), (0, 'I', 2, chr(10) || 'user:'), (1, 'I', 2, chr(10) || 'user:'),
  (3, 'I', 2, chr(10) || 'user:'), (2, 'I', 3, chr(10) || 'assistant:'), (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
step(z, a, y) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
act AS (
  SELECT conv_id, t, s.z, s.y, role || ':' || text AS line, 'K' AS e, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS p FROM r JOIN step s ON s.a = role[1] WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, t, s.z, s.y, CASE s.a WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 1 END FROM r, step s WHERE s.a <> 's' AND fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, t, z, z, NULL, 'D', 2 FROM r, range(4) x(z)),
moves AS (
  SELECT conv_id, t, q, y, 5 * length(i) + p AS p, i || e AS e, ins.line || coalesce(chr(10) || act.line, '') AS line FROM act JOIN ins ON ins.z = act.z),
dp AS (
  SELECT DISTINCT conv_id, 0 AS t, 0 AS q, {'p': 0, 'e': '', 'line': ''} AS b FROM d
  UNION ALL
  SELECT dp.conv_id, dp.t + 1, y, min({'p': b.p + m.p, 'e': b.e || m.e, 'line': b.line || m.line}) FROM dp
  JOIN moves m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.t = dp.t + 1 AND m.q = dp.q GROUP BY dp.conv_id, dp.t, y),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY conv_id),
ends AS (
  SELECT n.conv_id, min({'p': b.p + 5 * length(i), 'e': b.e || i, 'line': b.line || ins.line}) AS b
  FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.t = n.n JOIN ins ON ins.q = dp.q AND ins.z IN (0, 3) GROUP BY n.conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.p, 0) AS BIGINT) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(b.line[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id
"""
