"""Queries of matching, compression, policy, reasoning and quotes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import contracts
from tablewright.operators import matching as m
from tablewright.operators import policy as p
from tablewright.operators import quote as q
from tablewright.plans.base import duck, spread, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, build, sql: str) -> None:
    QUERIES[name], SQL[name] = build, sql


CATALOG = """SELECT p_partkey AS pos, p_partkey AS id, p_name AS name, p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'https://shop.example/p/' || CAST(p_partkey AS STRING) END AS url,
  '{"brand":"' || p_brand || '","size":"' || CAST(p_size AS STRING) || '"' || CASE WHEN p_partkey % 5 = 0 THEN ',"SKU":"S-' || CAST(p_partkey AS STRING) || '"' ELSE '' END || '}' AS params_json,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE '1.' || CAST(100 + p_partkey % 900 AS STRING) || ',50' END AS price, CASE WHEN p_partkey % 2 = 0 THEN ' AX ' ELSE '' END AS sku,
  p_brand AS request_id FROM {part}"""
K = duck(CATALOG)


def tokens():
    return F.array(*map(F.lit, ["red", "widget", "brand", "econ"]))


TOK_SQL = r"""list_filter(string_split_regex(regexp_replace(lower(X), '[_.,;:/\\()|\[\]{}"“”’''!?+\-*@#%^&=]+', ' ', 'g'), '\s+'), lambda t: t <> '')"""
SCORE_SQL = f"""WITH k AS ({K}), t AS (SELECT *, {TOK_SQL.replace("X", "name || ' ' || description || ' ' || params_json")} AS own, {TOK_SQL.replace("X", "name")} AS nt, ['red', 'widget', 'brand', 'econ'] AS q FROM k),
h AS (SELECT *, len(list_filter(q, lambda x: list_contains(own, x))) AS e, len(list_filter(q, lambda x: NOT list_contains(own, x) AND contains(array_to_string(own, ' '), x))) AS s,
  len(list_filter(q, lambda x: list_contains(nt, x))) AS n FROM t),
r AS (SELECT pos, request_id, CAST(floor(least(least((3 * e + 2 * s + 3 * n) / 24, 1.0::DOUBLE) * 100 + CASE WHEN url <> '' THEN 2 ELSE 0 END, 100.0::DOUBLE) + 0.5) AS INTEGER) AS score FROM h)"""
add(
    "x22_match_score",
    lambda s, d: view(s, d, CATALOG).select("pos", m.match_score(tokens(), c("name"), c("description"), c("params_json"), c("url")).alias("score")),
    SCORE_SQL + " SELECT pos, score FROM r",
)
add(
    "k01_ranked_matches", lambda s, d: m.ranked(view(s, d, CATALOG), tokens(), within=["request_id"], limit=10).select("request_id", "pos", "score", "rank"),
    SCORE_SQL + " SELECT request_id, pos, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM r QUALIFY rank <= 10",
)
add(
    "k01_top_matches", lambda s, d: m.ranked(view(s, d, CATALOG), tokens(), limit=50).select("pos", "score", "rank"),
    SCORE_SQL + " SELECT pos, score, CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 50",
)
add(
    "x23_query_tokens",
    lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(m.query_tokens(c("p_name"), F.concat(F.lit("https://x.example/"), c("p_brand")), F.lit(None).cast("string"), F.array(F.lit("Tag-One"))), " ").alias("tokens")),
    "SELECT p_partkey, p_name || ' https x example ' || replace(lower(p_brand), '#', ' ') || ' tag-one' AS tokens FROM part",
)
add(
    "m01_bundle_items", lambda s, d: m.bundle_items(view(s, d, CATALOG)).select("pos", "item_id", "sku", "price", "currency"),
    f"""WITH k AS ({K}) SELECT pos, CAST(pos AS VARCHAR) AS item_id, CASE WHEN pos % 2 = 0 THEN 'AX' WHEN pos % 5 = 0 THEN 'S-' || pos END AS sku, price,
      CASE WHEN price IS NOT NULL THEN 'EUR' END AS currency FROM k""",
)


def _bundle(s, d):
    kind = "array<struct<value:string,confidence:double,source:string>>"
    one = lambda v, conf: F.struct(v.cast("string").alias("value"), F.lit(conf).alias("confidence"), F.lit("card").alias("source"))
    none = F.lit(None).cast(kind)
    return m.bundle_items(view(s, d, CATALOG)).withColumns(
        {
            "price_explicit": F.when(c("pos") % 7 == 0, F.array(one(c("price"), 0.9), one(F.lit("x"), 0.1))),
            "price_evidence": F.when(c("pos") % 3 == 0, F.array(one(c("pos"), 0.8))),
            "sku_explicit": none, "sku_evidence": F.when(c("pos") % 11 == 0, F.array(one(F.lit("AX"), 0.7))),
        }
    )


CHANGES_SQL = f"""WITH k AS ({K}), b AS (SELECT pos, request_id, price, CASE WHEN pos % 2 = 0 THEN 'AX' WHEN pos % 5 = 0 THEN 'S-' || pos END AS sku FROM k),
n AS (SELECT *, CASE WHEN pos % 7 = 0 THEN [price] ELSE [] END AS a1, CASE WHEN pos % 3 = 0 THEN [CAST(pos AS VARCHAR)] ELSE [] END AS a2, CASE WHEN price IS NULL THEN [] ELSE [price] END AS a3,
  CASE WHEN pos % 11 = 0 THEN ['AX'] ELSE [] END AS s1, CASE WHEN sku IS NULL THEN [] ELSE [sku] END AS s2 FROM b),
f AS (SELECT *, list_concat(list_concat(a1, a2), a3) AS pc, list_concat(s1, s2) AS sc FROM n),
x AS (SELECT pos, request_id, 'price.amount' AS field, CASE WHEN len(pc) = 0 THEN 'pass_through' WHEN len(pc) = 1 THEN 'canonicalize' WHEN pc[1] <> pc[2] THEN 'conflict_resolve' ELSE 'canonicalize' END AS decision, 0.01::DOUBLE AS loss FROM f
  UNION ALL SELECT pos, request_id, 'sku', CASE WHEN len(sc) = 1 THEN 'canonicalize' WHEN sc[1] <> sc[2] THEN 'conflict_resolve' ELSE 'canonicalize' END, 0.0::DOUBLE FROM f WHERE len(sc) > 0)"""
add(
    "m05_field_changes", lambda s, d: m.compress(_bundle(s, d)).select("pos", F.explode("changes").alias("x")).select("pos", "x.field", "x.decision", "x.loss"),
    CHANGES_SQL + " SELECT pos, field, decision, loss FROM x",
)
add(
    "m02_compressed_items", lambda s, d: m.compress(_bundle(s, d)).select("pos", "amount", "sku"),
    CHANGES_SQL + " SELECT pos, TRY_CAST(replace(replace(price, '.', ''), ',', '.') AS DOUBLE) AS amount, sku FROM b",
)
add(
    "m03_candidates", lambda s, d: _bundle(s, d).select("pos", F.array_join(F.transform(m.candidates(c("price_explicit"), c("price_evidence"), c("price")), lambda x: F.coalesce(x["value"], F.lit("?"))), "|").alias("found")),
    CHANGES_SQL + " SELECT pos, array_to_string(list_transform(pc, lambda v: coalesce(v, '?')), '|') AS found FROM f",
)
add(
    "m04_decision", lambda s, d: _bundle(s, d).select("pos", m.decision(m.candidates(c("price_explicit"), c("price_evidence"), c("price"))).alias("decision")),
    CHANGES_SQL + " SELECT pos, decision FROM x WHERE field = 'price.amount'",
)
QUERIES["w04_best_candidate"] = lambda s, d: _bundle(s, d).select("pos", F.get(m.candidates(c("price_explicit"), c("price_evidence"), c("price")), F.lit(0))["value"].alias("best"))
SQL["w04_best_candidate"] = CHANGES_SQL + " SELECT pos, pc[1] AS best FROM f"
add(
    "a04_loss_totals", lambda s, d: m.loss_totals(m.compress(_bundle(s, d))).select("pos", "loss_sum", "loss_count", "avg_field_loss"),
    CHANGES_SQL + " SELECT pos, sum(loss) AS loss_sum, CAST(count(*) AS INTEGER) AS loss_count, round(avg(loss), 6) AS avg_field_loss FROM x GROUP BY pos",
)
add(
    "a05_manifest_summary", lambda s, d: m.manifest_summary(m.compress(_bundle(s, d))),
    CHANGES_SQL + """ SELECT request_id, count(DISTINCT pos) AS items_in, count(*) FILTER (decision = 'canonicalize') AS fields_canonicalized, count(*) FILTER (decision = 'conflict_resolve') AS conflicts_resolved,
      CAST(0 AS BIGINT) AS fields_dropped, round(avg(loss), 6) AS avg_loss_score FROM x GROUP BY request_id""",
)
add(
    "m09_schema_errors", lambda s, d: m.schema_errors(m.compress(_bundle(s, d))).select("pos", F.array_join("errors", "|").alias("errors")),
    f"WITH k AS ({K}) SELECT pos, CASE WHEN url = '' THEN 'url: pattern' ELSE '' END AS errors FROM k",
)

#: A manifest for each part: valid, or with one fault by the part's number.
MANIFEST_JSON = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN m WHEN 1 THEN replace(m, '"requestId":', '"request":') WHEN 2 THEN replace(m, 'dedupe', 'merge') WHEN 3 THEN replace(m, '"avgLossScore":0.5', '"avgLossScore":1.5')
  WHEN 4 THEN replace(m, '2024-02-29', '2023-02-29') WHEN 5 THEN replace(m, '"itemsIn":1', '"itemsIn":"1"') WHEN 6 THEN replace(m, '"field":"title"', '"field":""') WHEN 7 THEN replace(m, 'sha256:', 'md5:') ELSE substr(m, 2) END AS j
  FROM (SELECT p_partkey, '{"manifestVersion":"1.0","requestId":"' || CAST(p_partkey AS STRING) || '","schemaVersion":"1","engineVersion":"1","createdAt":"2024-02-29T10:00:00Z","hashes":{"inputBundleHash":"' || h
    || '","compressedBundleHash":"' || h || '"},"summary":{"itemsIn":1,"itemsOut":1,"fieldsCanonicalized":0,"conflictsResolved":0,"fieldsDroppedLowConfidence":0,"avgLossScore":0.5},"items":[{"itemId":"' || p_brand
    || '","fieldChanges":[{"field":"title","decision":"dedupe","beforeCandidates":[{"value":"' || p_name || '","confidence":0.5,"source":"dom","evidenceId":"e1"}],"afterCanonical":{"value":null,"confidence":1,"source":"dom"},"loss":{"score":0.01,"type":"format_loss"},"rationale":"r"}],'
    || '"evidenceAnchors":[],"lossTotals":{"fieldLossScoreSum":0.01,"fieldCount":1,"avgFieldLoss":0.01}}]}' AS m FROM (SELECT *, 'sha256:' || lower(sha256(p_name)) AS h FROM {part}) p) q"""
add(
    "m09_manifest_contract", lambda s, d: spread(view(s, d, MANIFEST_JSON.replace("sha256(p_name)", "sha2(p_name, 256)"))).select("p_partkey", F.array_join(contracts.contract_errors("j", contracts.MANIFEST), "|").alias("errors")),
    """SELECT p_partkey, ['', '$.requestId: required|$.request: additionalProperties', '$.items[0].fieldChanges[0].decision: enum', '$.summary.avgLossScore: maximum', '$.createdAt: format', '$.summary.itemsIn: type',
      '$.items[0].fieldChanges[0].field: minLength', '$.hashes.inputBundleHash: pattern|$.hashes.compressedBundleHash: pattern', '$: json'][p_partkey % 9 + 1] AS errors FROM part""",
)

CONTEXT = """SELECT o_orderkey AS request_id, CAST(o_orderkey % 50 AS DOUBLE) / 100 AS loss, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 4 END AS conflicts,
  CASE WHEN o_orderkey % 2 = 0 THEN 'S' || CAST(o_orderkey AS STRING) END AS sku, o_orderstatus AS kind FROM {orders}"""


def paths(**more):
    return {"$.loss.avgLossScore": c("loss"), "$.manifest.summary.conflictsResolved": c("conflicts"), **more}


O = duck(CONTEXT)
POLICY_SQL = f"""WITH o AS ({O}), h AS (SELECT *, loss > 0.3 AS a, coalesce(conflicts > 0, false) AS b FROM o)"""
add(
    "r04_policy_state", lambda s, d: p.apply_rules(view(s, d, CONTEXT), p.RULESET, paths()).select("request_id", F.round("confidence", 6).alias("confidence"), "status", F.array_join("applied", "|").alias("applied"), F.array_join("trace", "|").alias("trace")),
    POLICY_SQL + """ SELECT request_id, round(1 - CASE WHEN a THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN b THEN 0.1::DOUBLE ELSE 0 END, 6) AS confidence, 'needs_review' AS status,
      CASE WHEN a THEN 'G-LOSS-PENALTY|' ELSE '' END || 'G-MISSING-SKU' || CASE WHEN b THEN '|G-PRICE-CONFLICT' ELSE '' END AS applied,
      CASE WHEN a THEN 'G-LOSS-PENALTY:penalize_confidence|G-LOSS-PENALTY:set_status|G-LOSS-PENALTY:emit_trace|' ELSE '' END || 'G-MISSING-SKU:require_review|G-MISSING-SKU:emit_trace'
      || CASE WHEN b THEN '|G-PRICE-CONFLICT:penalize_confidence|G-PRICE-CONFLICT:emit_trace' ELSE '' END AS trace FROM h""",
)
add(
    "r07_shadow_policy", lambda s, d: p.apply_rules(view(s, d, CONTEXT), p.shadowed(p.RULESET, "shadow"), paths(**{"$.items[*].normalized.sku": c("sku")})).select("request_id", "confidence", "status", F.array_join("applied", "|").alias("applied")),
    POLICY_SQL + """ SELECT request_id, 1.0::DOUBLE AS confidence, 'ok' AS status, array_to_string(list_filter([CASE WHEN a THEN 'G-LOSS-PENALTY' END, CASE WHEN sku IS NULL THEN 'G-MISSING-SKU' END,
      CASE WHEN b THEN 'G-PRICE-CONFLICT' END], lambda x: x IS NOT NULL), '|') AS applied FROM h""",
)
RICH = {"op": "all", "conditions": [
    {"op": "any", "conditions": [{"op": "gte", "path": "$.loss", "value": 0.4}, {"op": "in", "path": "$.kind", "value": ["F", "P"]}]},
    {"op": "not", "conditions": [{"op": "between", "path": "$.conflicts", "value": [2, 3]}]}, {"op": "regex", "path": "$.sku", "value": "[13579]$|0$"}, {"op": "ne", "path": "$.kind", "value": "P"},
    {"op": "lt", "path": "$.loss", "value": 0.48}, {"op": "lte", "path": "$.loss", "value": 0.47}, {"op": "exists", "path": "$.kind"},
]}


def rich_paths():
    return {f"$.{n}": c(n) for n in ("loss", "kind", "conflicts", "sku")}


add(
    "r03_condition_grammar", lambda s, d: view(s, d, CONTEXT).select("request_id", p.condition(RICH, rich_paths(), strict=False).alias("hit"), p.condition(RICH, rich_paths()).alias("strict_hit")),
    f"""WITH o AS ({O}) SELECT request_id, (loss >= 0.4 OR kind IN ('F', 'P')) AND NOT coalesce(conflicts BETWEEN 2 AND 3, false) AND coalesce(regexp_matches(sku, '[13579]$|0$'), false)
      AND kind <> 'P' AND loss < 0.48 AND loss <= 0.47 AS hit, false AS strict_hit FROM o""",
)
add(
    "r02_conditions", lambda s, d: view(s, d, CONTEXT).select("request_id", *[p.condition({"op": o, "path": "$.conflicts", "value": 1}, rich_paths()).alias(f"is_{o}") for o in ("gt", "eq", "exists", "missing", "lt")]),
    f"WITH o AS ({O}) SELECT request_id, coalesce(conflicts > 1, false) AS is_gt, coalesce(conflicts = 1, false) AS is_eq, conflicts IS NOT NULL AS is_exists, conflicts IS NULL AS is_missing, false AS is_lt FROM o",
)
REASON = """SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS item_id, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'T' END AS title, CASE WHEN l_partkey % 8 = 0 THEN CAST(NULL AS STRING) ELSE 'u' END AS url,
  l_partkey % 6 <> 0 AS has_price, CASE l_partkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '-1' WHEN 2 THEN '' WHEN 3 THEN CAST(NULL AS STRING) ELSE '9.5' END AS price_text,
  CASE WHEN l_partkey % 10 = 0 THEN 'x' ELSE 'SK' END AS sku, CAST(l_orderkey % 40 AS DOUBLE) / 100 AS avg_loss_score, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey % 60 AS DOUBLE) / 100 END AS item_loss,
  CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS violations FROM {lineitem}"""
N = duck(REASON)
ITEM_SQL = f"""WITH n AS ({N}), g AS (SELECT *, trim(title) = '' AS g1, coalesce(url, '') = '' AS g2, has_price AND (price_text IS NULL OR price_text = 'abc') AS g3, has_price AND coalesce(price_text, 'x') IN ('-1', '') AS g4, length(sku) < 2 AS g5 FROM n),
b AS (SELECT *, greatest(0, 1 - 0.15::DOUBLE * (g1::INT + g2::INT + g4::INT) - 0.08::DOUBLE * g3::INT - 0.03::DOUBLE * g5::INT) AS base, g1 OR g2 OR g3 OR g4 OR g5 AS bad FROM g),
l AS (SELECT *, CASE WHEN NOT bad THEN 'valid' WHEN base < 0.6 THEN 'ambiguous' ELSE 'invalid' END AS base_label, least(1, coalesce(item_loss, 0) * 0.6 + avg_loss_score * 0.6) AS pen FROM b),
a AS (SELECT *, greatest(0.05, greatest(0, base - pen)) AS conf FROM l), z AS (SELECT *, CASE WHEN base_label = 'valid' AND conf < 0.6 THEN 'ambiguous' ELSE base_label END AS label FROM a)"""
add(
    "r09_item_rules", lambda s, d: p.item_issues(view(s, d, REASON)).select("request_id", "item_id", F.array_join(F.transform("issues", lambda x: x["rule"]), "|").alias("rules"), F.round("base_confidence", 6).alias("base_confidence"), "base_label"),
    ITEM_SQL + """ SELECT request_id, item_id, array_to_string(list_filter([CASE WHEN g1 THEN 'R-TITLE-REQUIRED' END, CASE WHEN g2 THEN 'R-URL-REQUIRED' END, CASE WHEN g3 THEN 'R-PRICE-NUMERIC' END,
      CASE WHEN g4 THEN 'R-PRICE-POSITIVE' END, CASE WHEN g5 THEN 'R-SKU-TOO-SHORT' END], lambda x: x IS NOT NULL), '|') AS rules, round(base, 6) AS base_confidence, base_label FROM l""",
)
add(
    "r11_loss_penalty", lambda s, d: p.with_loss(p.item_issues(view(s, d, REASON))).select("request_id", "item_id", F.round("loss_penalty", 6).alias("loss_penalty"), F.round("item_confidence", 6).alias("item_confidence"), "loss_severity"),
    ITEM_SQL + " SELECT request_id, item_id, round(pen, 6) AS loss_penalty, round(conf, 6) AS item_confidence, CASE WHEN round(pen, 9) >= 0.25 THEN 'high' WHEN pen > 0 THEN 'medium' END AS loss_severity FROM a",
)
SUMMARY_SQL = ITEM_SQL + """, s AS (SELECT request_id, least(1, min(conf)) AS worst, bool_or(label <> 'valid') AS inv, max(avg_loss_score) AS al, sum(violations) AS v FROM z GROUP BY request_id),
  t AS (SELECT *, (inv AND worst < 0.6) OR al >= 0.15 AS review FROM s)"""
add(
    "r13_summary", lambda s, d: p.summarize(p.with_loss(p.item_issues(view(s, d, REASON)))).select("request_id", F.round("worst", 6).alias("worst"), "any_invalid", "status", "decision", "loss_penalty"),
    SUMMARY_SQL + """ SELECT request_id, round(worst, 6) AS worst, inv AS any_invalid, CASE WHEN v > 0 THEN 'blocked' WHEN review THEN 'needs_review' ELSE 'ok' END AS status,
      CASE WHEN v > 0 THEN 'blocked' WHEN review THEN 'partial' ELSE 'exportable' END AS decision, round(al * 0.6, 4) AS loss_penalty FROM t""",
)
QUERIES["a06_worst_confidence"] = lambda s, d: p.summarize(p.with_loss(p.item_issues(view(s, d, REASON)))).select("request_id", F.round("worst", 6).alias("worst"), "any_invalid")
SQL["a06_worst_confidence"] = SUMMARY_SQL + " SELECT request_id, round(worst, 6) AS worst, inv AS any_invalid FROM s"


def _merged(s, d):
    summary = p.summarize(p.with_loss(p.item_issues(view(s, d, REASON))))
    return p.merge_policy(summary.withColumns({"policy_status": F.when(c("request_id") % 2 == 0, "ok").otherwise("needs_review"), "policy_confidence": F.lit(0.8)})).select("request_id", "status", "confidence")


add(
    "r13_policy_merge", _merged,
    SUMMARY_SQL + " SELECT request_id, CASE WHEN request_id % 2 = 1 THEN 'needs_review' WHEN v > 0 THEN 'blocked' WHEN review THEN 'needs_review' ELSE 'ok' END AS status, round(least(worst, 0.8), 4) AS confidence FROM t",
)
add(
    "r12_guardian", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(p.suggestions_allowed(F.array(F.lit("fix_field"), c("p_type"))), "|").alias("violations")),
    "SELECT p_partkey, p_type AS violations FROM part",
)


def _decided(s, d):
    state = p.apply_rules(view(s, d, CONTEXT), p.RULESET, paths()).withColumns({"request_id": c("request_id").cast("string"), "timestamp": F.lit("2026-01-01T00:00:00.000Z"), "avg_loss_score": c("loss")})
    return p.reports(p.decisions(state))


add(
    "r15_decisions", lambda s, d: _decided(s, d).select("decision_id", "action", "mode", "risk_level", "confidence_adjustment", "notes"),
    POLICY_SQL + """ SELECT 'dec_' || request_id AS decision_id, 'require_review' AS action, 'active' AS mode, CASE WHEN a AND b THEN 'high' ELSE 'medium' END AS risk_level,
      round(-CASE WHEN a THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN b THEN 0.1::DOUBLE ELSE 0 END, 4) + 0 AS confidence_adjustment,
      'Applied rules: ' || CASE WHEN a THEN 'G-LOSS-PENALTY, ' ELSE '' END || 'G-MISSING-SKU' || CASE WHEN b THEN ', G-PRICE-CONFLICT' ELSE '' END AS notes FROM h""",
)
add(
    "r16_reports", lambda s, d: _decided(s, d).select("report_id", "risk_score", "report_loss_penalty", F.array_join("actions_taken", "|").alias("actions_taken")),
    POLICY_SQL + """ SELECT 'gov-report-' || request_id AS report_id, round(greatest(loss, CASE WHEN a THEN 0.2 ELSE 0 END + CASE WHEN b THEN 0.1 ELSE 0 END), 4) AS risk_score,
      round(CASE WHEN a THEN 0.2 ELSE 0 END + CASE WHEN b THEN 0.1 ELSE 0 END, 4)::DOUBLE AS report_loss_penalty, 'set_status|' || CASE WHEN a OR b THEN 'penalize_confidence|' ELSE '' END || 'log_trace_event' AS actions_taken FROM h""",
)
QUOTES = """SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) * 100000 + l_partkey AS pos, ' n' || CAST(l_partkey AS STRING) || ' ' AS name, CAST(NULL AS STRING) AS sku,
  CASE WHEN l_partkey % 9 = 0 THEN 'free' ELSE CAST(l_partkey AS STRING) || ',5' END AS price, CASE WHEN l_suppkey % 4 = 0 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS moq,
  CASE l_suppkey % 3 WHEN 0 THEN '{"battery":"1200mAh","leds":30}' WHEN 1 THEN '{"LED":"4"}' ELSE 'bad' END AS params_json FROM {lineitem}"""
Q = duck(QUOTES)
add(
    "x33_quote_rows", lambda s, d: q.quote_rows(view(s, d, QUOTES)).select("request_id", "pos", "name", "sku", "price", "moq", F.map_contains_key("params", "battery").alias("has_battery")),
    f"WITH r AS ({Q}) SELECT request_id, pos, trim(name) AS name, '' AS sku, coalesce(TRY_CAST(replace(price, ',', '.') AS DOUBLE), 0) AS price, CAST(moq AS DOUBLE) AS moq, contains(params_json, 'battery') AS has_battery FROM r",
)
add(
    "a03_quote_totals", lambda s, d: q.totals(q.quote_rows(view(s, d, QUOTES)), ["request_id"]),
    f"WITH r AS ({Q}) SELECT request_id, sum(coalesce(TRY_CAST(replace(price, ',', '.') AS DOUBLE), 0) * greatest(1, CAST(moq AS DOUBLE))) AS total, count(*) AS n FROM r GROUP BY request_id",
)
add(
    "x34_format_params", lambda s, d: q.quote_rows(view(s, d, QUOTES)).select("request_id", "pos", *[q.format_params(c("params"), g).alias(g) for g in ("de", "en", "zh")]),
    f"""WITH r AS ({Q}) SELECT request_id, pos, CASE WHEN params_json LIKE '%bat%' THEN 'Batterie: 1200mAh; LEDs: 30' WHEN params_json LIKE '%LED%' THEN 'LEDs: 4' ELSE '-' END AS de,
      CASE WHEN params_json LIKE '%bat%' THEN 'Battery: 1200mAh; LEDs: 30' WHEN params_json LIKE '%LED%' THEN 'LEDs: 4' ELSE '-' END AS en,
      CASE WHEN params_json LIKE '%bat%' THEN '电池: 1200mAh；LEDs: 30 个' WHEN params_json LIKE '%LED%' THEN 'LEDs: 4 个' ELSE '-' END AS zh FROM r""",
)
add(
    "x35_labels", lambda s, d: table(s, d, "nation").select("n_nationkey", F.element_at(F.array(*[F.array_join(F.array(*map(F.lit, q.HEADERS[g])), "|") for g in ("de", "en", "zh")]), (c("n_nationkey") % 3 + 1).cast("int")).alias("headers")),
    "SELECT n_nationkey, ['#|Name|SKU|Preis|MOQ|Parameter', '#|Name|SKU|Price|MOQ|Params', '#|名称|SKU|价格|MOQ|参数'][n_nationkey % 3 + 1] AS headers FROM nation",
)
add(
    "x46_fill_from_scrape",
    lambda s, d: q.fill_from_scrape(q.quote_rows(view(s, d, QUOTES)).withColumns({"scraped_title": F.lit("T"), "scraped_sku": c("pos").cast("string"), "scraped_price": F.lit("7,25")})).select("request_id", "pos", "name", "sku", "price", c("params")["scraped"].alias("scraped")),
    f"""WITH r AS ({Q}) SELECT request_id, pos, trim(name) AS name, CAST(pos AS VARCHAR) AS sku,
      CASE WHEN coalesce(TRY_CAST(replace(price, ',', '.') AS DOUBLE), 0) = 0 THEN 7.25 ELSE TRY_CAST(replace(price, ',', '.') AS DOUBLE) END AS price, 'T' AS scraped FROM r""",
)
