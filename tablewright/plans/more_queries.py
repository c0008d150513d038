"""Queries of the remaining extraction, governance and log operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import ids, jsons, text
from tablewright.functions.html import html_nodes, node_url, visible
from tablewright.functions.images import by_width, image_extension
from tablewright.operators import classify, matching, policy, relational
from tablewright.operators import extract as x
from tablewright.plans import flow_queries, governance_queries
from tablewright.plans.base import TITLES, duck, table, view
from tablewright.sources import exports
from tablewright.streaming import diagnostics

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, build, sql: str | None) -> None:
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


add(
    "s12_image_rows", lambda s, d: view(s, d, "SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg; q=1' END AS kind FROM {part}").select("p_partkey", image_extension(F.regexp_extract("kind", r"image/(\w+)", 1)).alias("ext"), F.base64(c("p_name").cast("binary")).alias("data")),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'png' ELSE 'jpeg' END AS ext, base64(encode(p_name)) AS data FROM part",
)
BOXES = """SELECT p_partkey AS page_id, 'https://demo.shop/list' AS url, '<div class="x"><div class="product"><h2>' || p_name || ' ' || CAST(1000 + p_partkey AS STRING) || '</h2><img src="/a.png"><b class="price">€ ' ||
  CAST(p_partkey AS STRING) || '.25</b><a href="/product/' || CAST(p_partkey AS STRING) || '">go</a></div><p style="display: none">hid</p><p></p><aside class="rec"><div class="product"><h2>r</h2></div></aside><a href="/product/z">Link 7777</a></div>' AS html FROM {part}"""
add(
    "c14_card_counts", lambda s, d: x.card_counts(html_nodes(view(s, d, BOXES)), [".product", "img", "li"], 2),
    "SELECT p_partkey AS page_id, CAST(2 AS BIGINT) AS cards, true AS ok FROM part",
)
add(
    "f08_outside_blocks", lambda s, d: x.outside(html_nodes(view(s, d, BOXES)), ".rec").groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if(c("tag") == "h2").alias("titles")),
    "SELECT p_partkey AS page_id, CAST(9 AS BIGINT) AS nodes, CAST(1 AS BIGINT) AS titles FROM part",
)
add(
    "f13_visible_nodes", lambda s, d: html_nodes(view(s, d, BOXES)).filter(c("tag") == "p").groupBy("page_id").agg(F.count_if(visible()).alias("shown"), F.count("*").alias("n")),
    "SELECT p_partkey AS page_id, CAST(0 AS BIGINT) AS shown, CAST(2 AS BIGINT) AS n FROM part",
)
add(
    "x49_node_urls", lambda s, d: html_nodes(view(s, d, BOXES)).filter(node_url() != "").select("page_id", "node", node_url().alias("u")),
    """SELECT p_partkey AS page_id, CAST(n AS INTEGER) AS node, u FROM (SELECT p_partkey, unnest([3, 5, 11]) AS n, unnest(['/a.png', '/product/' || p_partkey, '/product/z']) AS u FROM part)""",
)
add(
    "g20_minimal_rows", lambda s, d: x.minimal_rows(x.outside(html_nodes(view(s, d, BOXES)), ".rec")).drop("pos"),
    "SELECT p_partkey AS page_id, p_name || ' ' || (1000 + p_partkey) AS name, '/a.png' AS image, p_partkey + 0.25::DOUBLE AS price FROM part",
)
add(
    "g04_generic_links", lambda s, d: x.generic_links(view(s, d, BOXES)).select("page_id", "pos", "url"),
    "SELECT p_partkey AS page_id, CAST(n AS INTEGER) AS pos, CASE n WHEN 1 THEN 'https://demo.shop/product/' || p_partkey ELSE 'https://demo.shop/product/z' END AS url FROM part, range(1, 3) r(n)",
)
add(
    "g06_product_links", lambda s, d: x.product_links(view(s, d, "SELECT p_partkey AS page_id, 'https://demo.shop/' AS url, '<a href=\"/products/' || CAST(p_partkey AS STRING) || '\">a</a><a href=\"/products/1/reviews\">r</a><a href=\"/x\">x</a>' AS html FROM {part}"), classify.is_shopify_product),
    "SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS pos, 'https://demo.shop/products/' || p_partkey AS url, 'a' AS title FROM part",
)
add(
    "g11_static_cards", lambda s, d: x.card_rows(x.outside(html_nodes(view(s, d, BOXES)), ".rec"), view(s, d, BOXES), x.PROFILES["static"]).select("page_id", "title", "url", "price"),
    "SELECT p_partkey AS page_id, p_name || ' ' || (1000 + p_partkey) AS title, 'https://demo.shop/product/' || p_partkey AS url, p_partkey || '.25' AS price FROM part",
)
SITE = {"card": "li[class*=box]", "title": ["[data-name]"], "price": [".p"], "keep": lambda u: ~u.contains("/no/")}
SITE_PAGES = """SELECT p_partkey AS page_id, 'https://site.example/l' AS url, '<ul><li class="list-box"><i data-name>' || p_name || '</i><a href="/d/' || CAST(p_partkey AS STRING) || '">x</a><u class="p">3,50</u></li>
  <li class="list-box"><i data-name>n</i><a href="/no/1">x</a></li></ul>' AS html FROM {part}"""
add(
    "g17_site_profile", lambda s, d: x.card_rows(html_nodes(view(s, d, SITE_PAGES)), view(s, d, SITE_PAGES), SITE).select("page_id", "title", "url", "price"),
    "SELECT p_partkey AS page_id, p_name AS title, 'https://site.example/d/' || p_partkey AS url, '3.50' AS price FROM part",
)
add(
    "g12_universal", lambda s, d: x.universal(view(s, d, flow_queries.DETAIL)).select("page_id", "pos", "url", "sku"),
    "SELECT p_partkey AS page_id, CAST(1 AS INTEGER) AS pos, 'https://demo.shop/x' AS url, 'S' || p_partkey AS sku FROM part",
)
add(
    "g18_dedupe_filter", lambda s, d: relational.row_index(relational.keep_first(view(s, d, TITLES).withColumn("g", c("p_partkey") % 10), ["g", "u"], ["p_partkey"]), ["p_partkey"], ["g"]).filter("idx <= 200").select("g", "p_partkey"),
    f"SELECT g, p_partkey FROM (SELECT p_partkey % 10 AS g, p_partkey, u FROM ({duck(TITLES)}) QUALIFY row_number() OVER (PARTITION BY p_partkey % 10, u ORDER BY p_partkey) = 1) QUALIFY row_number() OVER (PARTITION BY g ORDER BY p_partkey) <= 200",
)
add(
    "g24_id_bag", lambda s, d: view(s, d, "SELECT p_partkey, '<table><tr><td>EAN</td><td>4006381333931</td></tr></table><p>SKU: AB-' || CAST(p_partkey AS STRING) || '</p>' AS html FROM {part}").select("p_partkey", F.array_join(ids.eans(text.strip_markup(c("html"))), "|").alias("eans"), F.array_join(ids.skus(text.strip_markup(c("html"))), "|").alias("skus")),
    "SELECT p_partkey, '4006381333931' AS eans, 'AB-' || p_partkey AS skus FROM part",
)
add(
    "x16_document_sku", lambda s, d: x.document_sku(html_nodes(view(s, d, "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN '<div><b itemprop=\"sku\">I' || CAST(p_partkey AS STRING) || '</b></div>' WHEN 1 THEN '<dl><dt>Artikel-Nr.:</dt><dd>D' || CAST(p_partkey AS STRING) || '</dd></dl>' ELSE '<div><p>Bestellnummer: T-' || CAST(1000 + p_partkey AS STRING) || '</p></div>' END AS html FROM {part}"))),
    "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'I' || p_partkey WHEN 1 THEN 'D' || p_partkey ELSE 'T-' || (1000 + p_partkey) END AS sku FROM part",
)
add(
    "f10_check_numbers", lambda s, d: table(s, d, "part").select("p_partkey", ids.is_check_number((c("p_partkey") * 977 + 48000000).cast("string")).alias("loose"), ids.is_check_number((c("p_partkey") * 977 + 48000000).cast("string"), True).alias("strict")),
    "SELECT p_partkey, true AS loose, CAST(p_partkey * 977 + 48000000 AS VARCHAR) LIKE '48%' AS strict FROM part",
)
add("f16_status_window", lambda s, d: table(s, d, "events").filter(relational.status_ok(c("user_id") % 500 + 100)).select("event_id"), "SELECT event_id FROM events WHERE user_id % 500 + 100 BETWEEN 200 AND 399")
add(
    "j05_by_position", lambda s, d: view(s, d, "SELECT p_partkey, split(p_name, ' ') AS a, split(upper(p_name), ' ') AS b FROM {part}").transform(lambda x: matching.by_position(x, "p_partkey", "a", "b")),
    "SELECT p_partkey, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INTEGER) AS pos, unnest(string_split(p_name, ' ')) AS a, unnest(string_split(upper(p_name), ' ')) AS b FROM part",
)
add(
    "j07_evidence_by_field", lambda s, d: view(s, d, "SELECT p_partkey, array(named_struct('field', 'title', 'v', p_name), named_struct('field', 'sku', 'v', p_brand)) AS e FROM {part}").select("p_partkey", matching.evidence_of(c("e"), "sku", "v").alias("sku_evidence")),
    "SELECT p_partkey, p_brand AS sku_evidence FROM part",
)
add("k03_early_limit", lambda s, d: relational.at_most(table(s, d, "part").select("p_partkey"), 7).agg(F.count("*").alias("n")), "SELECT least(count(*), 7) AS n FROM part")
add(
    "k08_images_by_size", lambda s, d: view(s, d, "SELECT p_partkey, array('/a_100x100.jpg', '/b_' || CAST(p_size * 30 AS STRING) || 'x200.jpg', '/c.jpg') AS i FROM {part}").select("p_partkey", F.array_join(by_width(c("i")), "|").alias("images")),
    "SELECT p_partkey, CASE WHEN p_size * 30 > 100 THEN '/b_' || (p_size * 30) || 'x200.jpg|/a_100x100.jpg' ELSE '/a_100x100.jpg|/b_' || (p_size * 30) || 'x200.jpg' END || '|/c.jpg' AS images FROM part",
)
DOCS = """SELECT p_partkey, '{ "b": [1, 2.50, 10.0, 0.00001, 1e-7, 1152921504606846976, 1e21, -0.0], "a": {"Token": "x", "n": null}, "c": "' || p_name || '" }' AS j FROM {part}"""
add("x38_canonical_json", lambda s, d: view(s, d, DOCS).select("p_partkey", jsons.canonical_json(c("j")).alias("j")), """SELECT p_partkey, '{"a":{"Token":"x","n":null},"b":[1,2.5,10,0.00001,1e-7,1152921504606847000,1e+21,0],"c":"' || p_name || '"}' AS j FROM part""")
add("m08_bundle_hash", lambda s, d: view(s, d, DOCS).select("p_partkey", jsons.bundle_hash(c("j")).alias("h")), """SELECT p_partkey, 'sha256:' || sha256('{"a":{"Token":"x","n":null},"b":[1,2.5,10,0.00001,1e-7,1152921504606847000,1e+21,0],"c":"' || p_name || '"}') AS h FROM part""")
add("x44_redacted_json", lambda s, d: view(s, d, DOCS).select("p_partkey", jsons.redact_json(c("j")).alias("j")), """SELECT p_partkey, '{"a":{"Token":"[redacted]","n":null},"b":[1,2.5,10,0.00001,1e-7,1152921504606847000,1e+21,0],"c":"' || p_name || '"}' AS j FROM part""")
add("x40_json_path", lambda s, d: view(s, d, DOCS).select("p_partkey", jsons.path_value(c("j"), "$.c").alias("v"), jsons.path_value(c("j"), "$.b[*].x").alias("w")), "SELECT p_partkey, p_name AS v, CAST(NULL AS VARCHAR) AS w FROM part")
add("x45_translated", lambda s, d: table(s, d, "part").select("p_partkey", jsons.translated(c("p_name")).alias("same"), jsons.translated(c("p_name"), lambda xs: [y.upper() for y in xs]).alias("upper")), "SELECT p_partkey, p_name AS same, upper(p_name) AS upper FROM part")
add(
    "r01_policy_context", lambda s, d: view(s, d, governance_queries.CONTEXT).select("request_id", policy.context(c("loss"), c("conflicts")).alias("x")).select("request_id", "x.avgLossScore", "x.conflicts"),
    f"SELECT request_id, coalesce(loss, 0) AS avgLossScore, coalesce(conflicts, 0) AS conflicts FROM ({governance_queries.O})",
)
HARD = {"rules": [{"ruleId": "A", "enabled": True, "when": {"op": "gt", "path": "$.loss.avgLossScore", "value": 0.1}, "then": {"actions": [{"type": "penalize_confidence", "value": 0.7}, {"type": "odd"}]}},
                  {"ruleId": "B", "enabled": True, "when": {"op": "gt", "path": "$.loss.avgLossScore", "value": 0.2}, "then": {"actions": [{"type": "penalize_confidence", "value": 0.7}, {"type": "set_status", "value": "blocked"}]}},
                  {"ruleId": "C", "enabled": False, "when": {"op": "exists", "path": "$.loss.avgLossScore"}}]}
add(
    "r05_actions", lambda s, d: policy.apply_rules(view(s, d, governance_queries.CONTEXT), HARD, governance_queries.paths()).select("request_id", F.round("confidence", 6).alias("confidence"), "status", F.array_join("trace", "|").alias("trace")),
    f"""SELECT request_id, CASE WHEN loss > 0.2 THEN 0.0::DOUBLE WHEN loss > 0.1 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN loss > 0.2 THEN 'blocked' ELSE 'ok' END AS status,
      CASE WHEN loss > 0.1 THEN 'A:penalize_confidence|A:unknown_action' ELSE '' END || CASE WHEN loss > 0.2 THEN '|B:penalize_confidence|B:set_status' ELSE '' END AS trace FROM ({governance_queries.O})""",
)
add(
    "r14_shadow_override", lambda s, d: policy.apply_rules(view(s, d, governance_queries.CONTEXT), policy.shadowed(HARD, "shadow"), governance_queries.paths()).select("request_id", "confidence", "status", F.size("applied").alias("matched")),
    f"SELECT request_id, 1.0::DOUBLE AS confidence, 'ok' AS status, CAST((loss > 0.1)::INT + (loss > 0.2)::INT AS INTEGER) AS matched FROM ({governance_queries.O})",
)
RULES = """SELECT p_partkey AS rule_id, p_size % 3 AS state, p_size / 50 AS precision, 1 + p_partkey % 5 AS support FROM {part}"""
add(
    "r17_candidate_review", lambda s, d: policy.reviewed(view(s, d, RULES).withColumn("review", F.when(c("state") == 1, "approved").when(c("state") == 2, "rejected")), "review").groupBy("review").agg(F.count("*").alias("n"), F.sum("support").alias("support")),
    "SELECT CASE p_size % 3 WHEN 1 THEN 'approved' ELSE 'proposed' END AS review, count(*) AS n, CAST(sum(1 + p_partkey % 5) AS BIGINT) AS support FROM part WHERE p_size % 3 <> 2 GROUP BY 1",
)
add(
    "m06_evidence_anchors", lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("e_"), F.substring(F.sha2("p_name", 256), 1, 10)).alias("evidence_id"), text.tagged_sha256(c("p_type")).alias("snippet_hash"), F.least(F.greatest(c("p_size") / 40, F.lit(0.0)), F.lit(1.0)).alias("weight")),
    "SELECT p_partkey, 'e_' || substr(sha256(p_name), 1, 10) AS evidence_id, 'sha256:' || sha256(p_type) AS snippet_hash, least(p_size / 40, 1.0::DOUBLE) AS weight FROM part",
)
add(
    "o06_pdf_cells", lambda s, d: exports.table_lines(view(s, d, governance_queries.QUOTES).withColumn("name", F.trim("name")), "request_id", "pos", ["name", "price"]),
    f"""SELECT request_id, CAST(k AS INTEGER) AS idx, CAST((k - 1) // 40 + 1 AS INTEGER) AS page, k || '  |  ' || trim(name) || '  |  ' || price AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS k FROM ({governance_queries.Q}))""",
)
add(
    "o12_cluster_report", lambda s, d: relational.cluster_report(table(s, d, "part"), "p_brand"),
    """SELECT '{"label":"' || p_brand || '","n":' || count(*) || '}' AS j FROM part GROUP BY p_brand""",
)
ERRORS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'getaddrinfo ENOTFOUND x' WHEN 2 THEN 'HTTP 503  now' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'status 404' END AS e FROM {events}"
add(
    "t11_captured_errors", lambda s, d: diagnostics.captured(view(s, d, ERRORS), "e").select("event_id", "code", "message", "retry"),
    """SELECT event_id, ['timeout', 'dns', 'server', NULL, 'client'][event_id % 5 + 1] AS code, ['Request timed out', 'getaddrinfo ENOTFOUND x', 'HTTP 503 now', '', 'status 404'][event_id % 5 + 1] AS message,
      event_id % 5 IN (0, 2) AS retry FROM events""",
)
