"""Queries of list ladders, detail tests, artifacts, rule sets and charsets, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes
from tablewright.functions.prices import NEAR_PRICE
from tablewright.operators import classify, listing, matching, policy
from tablewright.operators import extract as x
from tablewright.plans import governance_queries as g
from tablewright.plans.base import spread, table, view
from tablewright.session import shared_dir
from tablewright.sources import charsets, inputs
from tablewright.streaming import diagnostics

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, build, sql: str) -> None:
    QUERIES[name], SQL[name] = build, sql


# Pages that differ by the part's number: two cards, a shop list without cards, plain links, and nothing.
LADDER = """SELECT p_partkey AS page_id, 'https://demo.shop/list/' AS url, CASE p_partkey % 4
  WHEN 0 THEN '<div class="my-product"><a href="/cart/add">in</a><a href="/d/' || k || '" title=" ">go</a><h3>' || p_name || ' ' || k || '</h3><img data-src="/i.jpg?w=1" alt="A"><span>ab 1.' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ',50 € x</span></div>' ||
    '<article class="product-card"><a href="e" title="T ' || k || '">x</a><b class="money">9,50 €</b><i class="model">M-' || k || '</i></article><div class="item"><a href="/login">l</a></div>'
  WHEN 1 THEN '<ul class="products"><LI class="x product"><a href="/first">f</a><a class="woocommerce-LoopProduct-link" href="/w/' || k || '">W ' || k || '</a><p class="price"><del>1</del><b class="amount">2,00</b></p></li></ul>'
  WHEN 2 THEN '<p><a href="/l/' || k || '">L ' || k || '</a><a href="/l/' || k || '">again</a><a href="/m"></a><a href="n" title="N">n</a></p>' ELSE '<p>no</p>' END AS html
  FROM (SELECT *, CAST(10000 + p_partkey AS STRING) AS k FROM {part}) q"""
add(
    "g13_fallback_ladder", lambda s, d: listing.server_ladder(spread(view(s, d, LADDER.replace("LI class=\"x product\"", "li class=\"x shop\"")))).select("page_id", "pos", "adapter", "title", "url", "img", "price", "sku"),
    """WITH q AS (SELECT *, CAST(10000 + p_partkey AS VARCHAR) AS k FROM part), r AS (
      SELECT p_partkey AS page_id, 1 AS pos, 'generic-cards' AS adapter, p_name || ' ' || k AS title, 'https://demo.shop/d/' || k AS url, 'https://demo.shop/i.jpg' AS img, '1.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ',50 €' AS price, k AS sku FROM q WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey, 2, 'generic-cards', 'T ' || k, 'https://demo.shop/list/e', '', '9,50 €', 'M-' || k FROM q WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey, 1, 'generic-links', 'f', 'https://demo.shop/first', '', '', '' FROM q WHERE p_partkey % 4 = 1
      UNION ALL SELECT p_partkey, 2, 'generic-links', 'W ' || k, 'https://demo.shop/w/' || k, '', '', k FROM q WHERE p_partkey % 4 = 1
      UNION ALL SELECT p_partkey, 1, 'generic-links', 'L ' || k, 'https://demo.shop/l/' || k, '', '', k FROM q WHERE p_partkey % 4 = 2
      UNION ALL SELECT p_partkey, 2, 'generic-links', 'N', 'https://demo.shop/list/n', '', '', '' FROM q WHERE p_partkey % 4 = 2)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, adapter, title, url, img, price, sku FROM r""",
)
LEGACY = """SELECT p_partkey AS page_id, 'https://demo.shop/' AS url, CASE p_partkey % 4
  WHEN 0 THEN '<body><div id="productlist"><ul><li><a href="/a/' || k || '">A  ' || k || '</a><img data-original="/o.png"></li><li></li></ul></div><ul><li>out</li></ul></body>'
  WHEN 1 THEN '<body><ul class="products"><li><img src="/p.png" alt=" P ' || k || ' "><h4>h</h4></li></ul><ul><li>out</li></ul></body>'
  WHEN 2 THEN '<body><main><div class="product-box"><h2>B ' || k || '</h2></div></main><div class="product-box">out</div></body>' ELSE '<p>none</p>' END AS html
  FROM (SELECT *, CAST(p_partkey AS STRING) AS k FROM {part}) q"""
add(
    "g15_legacy_list", lambda s, d: listing.legacy_items(view(s, d, LEGACY)).select("page_id", "pos", "title", "url", "img"),
    """SELECT p_partkey AS page_id, CAST(1 AS INTEGER) AS pos, ['A ', 'P ', 'B '][p_partkey % 4 + 1] || p_partkey AS title, CASE p_partkey % 4 WHEN 0 THEN 'https://demo.shop/a/' || p_partkey ELSE '' END AS url,
      ['https://demo.shop/o.png', 'https://demo.shop/p.png', ''][p_partkey % 4 + 1] AS img FROM part WHERE p_partkey % 4 < 3""",
)
MIXED = """SELECT p_partkey AS page_id, 'https://demo.shop/list' AS url, CASE p_partkey % 4
  WHEN 0 THEN '<div class="product"><h2>A 1001</h2><a href="/products/1">x</a></div><div class="product"><h2>B 1002</h2><a href="/products/2">x</a></div><div class="product"><h2>C ' || k || '</h2><a href="/products/3">x</a></div>'
  WHEN 1 THEN '<h1>D ' || k || '</h1><b itemprop="price" content="3.00"></b><i itemprop="sku">S' || k || '</i>'
  WHEN 2 THEN '<ul><li><img src="/q.png" alt="Q ' || k || '"></li></ul>' ELSE '' END AS html FROM (SELECT *, CAST(1000 + p_partkey AS STRING) AS k FROM {part}) q"""
add(
    "g16_extract_ladder", lambda s, d: listing.extract_list(spread(view(s, d, MIXED))).select("page_id", "pos", "adapter_used", "title"),
    """SELECT p_partkey AS page_id, CAST(n AS INTEGER) AS pos, ['template', 'universal', 'generic-legacy'][p_partkey % 4 + 1] AS adapter_used,
      CASE p_partkey % 4 WHEN 0 THEN ['A 1001', 'B 1002', 'C ' || (1000 + p_partkey)][n] WHEN 1 THEN 'D ' || (1000 + p_partkey) ELSE 'Q ' || (1000 + p_partkey) END AS title
      FROM part, range(1, 4) r(n) WHERE p_partkey % 4 = 0 OR (p_partkey % 4 < 3 AND n = 1)""",
)
SHOWN = """SELECT p_partkey AS page_id, CASE p_partkey % 6 WHEN 0 THEN '<meta property="og:type" content="og:Product"><p>x</p>' WHEN 1 THEN '<h1>h</h1><form action="/x/Cart/add"></form>' WHEN 2 THEN '<h1>h</h1><button>In den  Warenkorb</button>'
  WHEN 3 THEN '<ol class="breadcrumb"><li><a href="/">home</a></li><li>Part ' || p_name || '</li></ol>' WHEN 4 THEN '<dl><dt>Artikel-Nr.:</dt><dd>D' || CAST(p_partkey AS STRING) || '</dd></dl>'
  ELSE '<h1></h1><button>add to cart</button><ol class="breadcrumb"><li><a href="/">home</a></li></ol>' END AS html FROM {part}"""
add(
    "c12_detail_test", lambda s, d: listing.detail_test(html_nodes(view(s, d, SHOWN))),
    """SELECT p_partkey AS page_id, p_partkey % 6 = 0 AS by_type, p_partkey % 6 IN (1, 2) AS by_buy, p_partkey % 6 = 3 AS by_trail, p_partkey % 6 = 4 AS by_sku, p_partkey % 6 < 5 AS is_detail FROM part""",
)
add(
    "g25_code_lookup", lambda s, d: view(s, d, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '<td>other</td><td>x</td>' ELSE '<tr><td>Artikelnummer: </td> <td class=x><b>K' || CAST(p_partkey AS STRING) || '</b></td></tr>' END AS html FROM {part}").select("p_partkey", listing.code_lookup(c("html")).alias("code")),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'K' || p_partkey END AS code FROM part",
)
PREVIEW = """SELECT p_partkey AS page_id, 'https://demo.shop/' AS url, CASE WHEN p_partkey % 2 = 0 THEN '<script type="application/ld+json">{"@type": "Product"}</script>' ELSE '' END ||
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<a href="/product/1">One ' || CAST(p_partkey AS STRING) || '</a><a href="/product/2">Two</a><a href="/product/3">3 3</a><a href="/product/4">Four</a><a href="/product/5">Five</a><a href="/product/6">Six</a>' END AS html FROM {part}"""
add(
    "g26_detect_preview", lambda s, d: listing.detect_preview(view(s, d, PREVIEW), NEAR_PRICE).select("page_id", "type", "platform", F.array_join("titles", "|").alias("titles")),
    """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'detail' ELSE 'list' END AS type, '' AS platform, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'One ' || p_partkey || '|Two|3 3|Four|Five' END AS titles FROM part""",
)
add("g27_probe", lambda s, d: inputs.probe(s), "SELECT 'ok' AS status, CAST(1 AS INTEGER) AS version")

BYTES = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN encode(p_name || ' é', 'UTF-8') WHEN 1 THEN encode(p_name || ' é', 'ISO-8859-1') WHEN 2 THEN concat(unhex('BCDBB8F1'), encode(p_name, 'UTF-8')) ELSE unhex('FF61E9FF') END AS b,
  CASE p_partkey % 4 WHEN 1 THEN 'iso-8859-1' WHEN 0 THEN 'no-such' END AS n FROM {part}"""
add(
    "s05_decoded_bytes", lambda s, d: view(s, d, BYTES).select("p_partkey", inputs.decode_bytes(c("b"), c("n")).alias("text")),
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '价格' || p_name WHEN 3 THEN 'ÿaéÿ' ELSE p_name || ' é' END AS text FROM part",
)
#: Documents as bytes of four charsets, three of which nothing declares.
RAW = """SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN encode(coalesce(text, ''), 'UTF-8') WHEN 1 THEN encode(coalesce(text, ''), 'ISO-8859-1') WHEN 2 THEN encode(coalesce(text, ''), 'UTF-16LE')
  ELSE encode(coalesce(text, ''), 'UTF-16') END AS body FROM {documents}"""


def _raw(spark, sf_dir):
    # encode fails on what Latin-1 lacks, which is a question mark here, and gives an empty text no byte order mark.
    latin = F.when(c("doc_id") % 4 == 1, F.regexp_replace("text", r"[^\x00-\xFF]", "?")).otherwise(c("text"))
    raw = spark.sql(RAW, documents=table(spark, sf_dir, "documents").withColumn("text", latin))
    return raw.withColumn("body", F.when((F.length("body") == 0) & (c("doc_id") % 4 == 3), F.unhex(F.lit("FEFF"))).otherwise(c("body")))


add(
    "s05_detected_charset", lambda s, d: _raw(s, d).select("doc_id", charsets.page_read(c("body")).alias("r")).select("doc_id", "r.charset", F.length("r.text").alias("n"), F.sha2(F.encode("r.text", "UTF-8"), 256).alias("h")),
    r"""WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN regexp_replace(t, '[^\x00-\x{FF}]', '?', 'g') ELSE t END AS t FROM r)
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'utf-16be' WHEN t = '' THEN 'ascii' WHEN doc_id % 4 = 2 THEN 'utf-16le' WHEN NOT regexp_matches(t, '[^\x00-\x7F]') THEN 'ascii' WHEN doc_id % 4 = 0 THEN 'utf-8' ELSE 'windows-1252' END AS charset,
      CAST(length(CASE WHEN doc_id % 4 = 3 THEN chr(65279) || t ELSE t END) AS INTEGER) AS n, sha256(CASE WHEN doc_id % 4 = 3 THEN chr(65279) || t ELSE t END) AS h FROM l""",
)
RULESETS = [("none", None), ("bad", "{'a'"), ("list", "[1]"), ("good", '{"defaults": {"baseConfidence": 0.9}, "rules": [{"ruleId": "A", "enabled": true, "when": {"op": "exists", "path": "$.x"}}]}')]


def _rulesets(spark, sf_dir):
    loaded = [(name, policy.load_ruleset(text)) for name, text in RULESETS]
    return spark.createDataFrame([(n, float(r["defaults"]["baseConfidence"]), len(r["rules"])) for n, r in loaded], "name string, base_confidence double, rules int")


add("s10_rulesets", _rulesets, "SELECT name, base_confidence, CAST(rules AS INTEGER) AS rules FROM (VALUES ('none', 1.0::DOUBLE, 0), ('bad', 1.0::DOUBLE, 0), ('list', 1.0::DOUBLE, 0), ('good', 0.9::DOUBLE, 1)) v(name, base_confidence, rules)")
FAMILY_LINES = """SELECT CASE p_partkey % 3 WHEN 0 THEN '{"pos":' || CAST(p_partkey AS STRING) || ',"family_id":"f' || CAST(p_partkey AS STRING) || '","selector":"li.a","fields":["' || p_brand || '","sku"]}' WHEN 1 THEN '{"pos":1}' ELSE 'no json' END AS value FROM {part}"""
add(
    "s11_family_scan", lambda s, d: inputs.families(view(s, d, FAMILY_LINES)).select("pos", "family_id", "selector", F.array_join("fields", "|").alias("fields")),
    "SELECT CAST(p_partkey AS INTEGER) AS pos, 'f' || p_partkey AS family_id, 'li.a' AS selector, p_brand || '|sku' AS fields FROM part WHERE p_partkey % 3 = 0",
)
NEAR = [(0, "grid", "div.grid", ["title", "price"]), (1, "list", "ul.list", ["title"])]


def _family_join(spark, sf_dir):
    samples = view(spark, sf_dir, "SELECT p_partkey AS sample_id, CASE p_partkey % 3 WHEN 0 THEN 'div.grid' WHEN 1 THEN 'ul.list' ELSE 'table' END AS selector, array('title') AS fields FROM {part}")
    known = spark.createDataFrame(NEAR, "pos int, family_id string, selector string, fields array<string>")
    return classify.predict_family(samples, known).groupBy("family_id").agg(F.count("*").alias("samples"), F.round(F.max("score"), 3).alias("best"))


add(
    "j06_family_join", _family_join,
    """SELECT CASE p_partkey % 3 WHEN 0 THEN 'grid' ELSE 'list' END AS family_id, count(*) AS samples, max(CASE p_partkey % 3 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) AS best FROM part GROUP BY 1""",
)
add(
    "r06_clamped_decision", lambda s, d: view(s, d, "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE p_size / 20 - 1 END AS v, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'blocked' END AS st FROM {part}").select("p_partkey", policy.normalized(c("v"), c("st"), F.lit(None)).alias("x")).select("p_partkey", F.round("x.confidence", 6).alias("confidence"), "x.status", F.size("x.reasons").alias("reasons")),
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1.0::DOUBLE ELSE round(least(greatest(p_size / 20 - 1, 0.0::DOUBLE), 1.0::DOUBLE), 6) END AS confidence, CASE WHEN p_size % 3 = 1 THEN 'blocked' ELSE 'ok' END AS status, CAST(0 AS INTEGER) AS reasons FROM part",
)
add(
    "r08_active_ruleset", lambda s, d: policy.rule_rows(s, policy.RULESET).select("rule_id", "pos", "enabled", "op", "path", F.array_join("actions", "|").alias("actions")),
    """SELECT rule_id, CAST(pos AS INTEGER) AS pos, true AS enabled, op, path, actions FROM (VALUES ('G-LOSS-PENALTY', 0, 'gt', '$.loss.avgLossScore', 'penalize_confidence|set_status|emit_trace'),
      ('G-MISSING-SKU', 1, 'missing', '$.items[*].normalized.sku', 'require_review|emit_trace'), ('G-PRICE-CONFLICT', 2, 'gt', '$.manifest.summary.conflictsResolved', 'penalize_confidence|emit_trace')) v(rule_id, pos, op, path, actions)""",
)
add(
    "r10_base_confidence", lambda s, d: policy.item_issues(view(s, d, g.REASON)).groupBy("base_label").agg(F.count("*").alias("n"), F.round(F.min("base_confidence"), 6).alias("least"), F.round(F.max("base_confidence"), 6).alias("most")),
    g.ITEM_SQL + " SELECT base_label, count(*) AS n, round(min(base), 6) AS least, round(max(base), 6) AS most FROM l GROUP BY base_label",
)
add(
    "m07_manifest_totals", lambda s, d: matching.loss_totals(matching.compress(g._bundle(s, d))).groupBy("request_id").agg(F.round(F.sum("loss_sum"), 6).alias("loss_sum"), F.sum("loss_count").alias("loss_count")),
    g.CHANGES_SQL + " SELECT request_id, round(sum(loss), 6) AS loss_sum, count(*) AS loss_count FROM x GROUP BY request_id",
)


def _required(spark, sf_dir):
    rows = []
    for name, given in (("all", ("r", "1", "e")), ("request", (None, "1", "e")), ("schema", ("r", "", "e")), ("engine", ("r", "1", None))):
        try:
            made = matching.compression_manifest(matching.compress(g._bundle(spark, sf_dir)), *given).first()
            rows.append((name, "", int(made.items_in)))
        except ValueError as e:
            rows.append((name, str(e), 0))
    return spark.createDataFrame(rows, "name string, error string, items_in long")


add(
    "m10_required_params", _required,
    """SELECT name, error, CASE WHEN error = '' THEN (SELECT count(*) FROM part) ELSE 0 END AS items_in FROM (VALUES ('all', ''), ('request', 'manifest: request_id required'), ('schema', 'manifest: schema_version required'), ('engine', 'manifest: engine_version required')) v(name, error)""",
)
OFFERS = """SELECT p_partkey AS page_id, 'https://demo.shop/x' AS url, '<script type="application/ld+json">{"@type":"Product","name":"n","offers":' || CASE p_partkey % 4 WHEN 0 THEN '[{"price":"1.' || k || ',50"}]' WHEN 1 THEN '{"lowPrice":' || k || '.25,"highPrice":9}'
  WHEN 2 THEN '{"highPrice":"' || k || '","priceCurrency":"EUR"}' ELSE '{"priceSpecification":{"price":"' || k || ',10"}}' END || '}</script>' AS html FROM (SELECT *, CAST(100 + p_partkey % 900 AS STRING) AS k FROM {part}) q"""
add(
    "x09_jsonld_price", lambda s, d: x.jsonld_items(view(s, d, OFFERS)).select("page_id", "price"),
    "SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN '1' || k || '.50' WHEN 1 THEN k || '.25' WHEN 2 THEN k ELSE k || '.10' END AS price FROM (SELECT *, CAST(100 + p_partkey % 900 AS VARCHAR) AS k FROM part)",
)
CODES = """SELECT p_partkey AS page_id, 'https://demo.shop/x' AS url, '<script type="application/ld+json">' || CASE p_partkey % 3 WHEN 0 THEN '[{"@graph":[{"@type":"Thing"},{"@type":["Product","X"],"productID":"G' || k || '"}]}]' WHEN 1 THEN '{"@type":"Product","offers":[{"a":1},{"sku":"O' || k || '"}]}'
  ELSE '{"@type":"Product","sku":"","mpn":"M' || k || '"}' END || '</script>' AS html FROM (SELECT *, CAST(p_partkey AS STRING) AS k FROM {part}) q"""
add(
    "x41_jsonld_sku", lambda s, d: x.jsonld_items(view(s, d, CODES)).select("page_id", "sku"),
    "SELECT p_partkey AS page_id, ['G', 'O', 'M'][p_partkey % 3 + 1] || p_partkey AS sku FROM part",
)


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _artifacts(spark, sf_dir):
    state = policy.apply_rules(view(spark, sf_dir, g.CONTEXT), policy.RULESET, g.paths()).withColumn("timestamp", F.lit("t"))
    made = policy.decisions(state).select((c("request_id") % 4).alias("run_id"), "decision_id", "action", "risk_level")
    path = _folder(spark, "artifacts")
    inputs.write_artifacts(made, path)
    back = spark.read.schema("decision_id string, action string, risk_level string, run_id int").json(path)
    return back.groupBy("run_id", "action").agg(F.count("*").alias("n"), F.min("decision_id").alias("first_id"))


add(
    "o07_run_artifacts", _artifacts,
    f"SELECT CAST(request_id % 4 AS INTEGER) AS run_id, 'require_review' AS action, count(*) AS n, min('dec_' || request_id) AS first_id FROM ({g.O}) GROUP BY 1",
)


def _report_files(spark, sf_dir):
    state = policy.apply_rules(view(spark, sf_dir, g.CONTEXT), policy.RULESET, g.paths()).withColumns({"timestamp": F.lit("t"), "avg_loss_score": c("loss")})
    made = policy.reports(policy.decisions(state)).select("decision_id", "risk_score", F.array_join("actions_taken", "|").alias("actions"), F.lit("demo").alias("run_id"))
    path = _folder(spark, "reports")
    inputs.write_artifacts(made, path)
    return spark.read.schema("decision_id string, risk_score double, actions string, run_id string").json(path).groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.max("risk_score"), 2).alias("most"))


add("o08_report_files", _report_files, f"SELECT 'demo' AS run_id, count(*) AS n, round(max(loss), 2) AS most FROM ({g.O})")


def _appended(spark, sf_dir):
    path, rows = _folder(spark, "log"), table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    inputs.append_by_day(rows.filter("event_id % 2 = 0"), path)
    inputs.append_by_day(rows.filter("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string, day date").json(path).groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


add("o09_daily_log", _appended, "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")


def _listened(spark, sf_dir):
    seen: list[tuple[str, int]] = []

    def first(batch, epoch):
        seen.append(("first", batch.count()))

    def broken(batch, epoch):
        raise RuntimeError("broken")

    def last(batch, epoch):
        seen.append(("last", batch.filter("event_type = 'error'").count()))

    run, errors = diagnostics.listeners([first, broken, last])
    run(table(spark, sf_dir, "events"), 1)
    rows = [(k, name, n, "") for k, (name, n) in enumerate(seen)] + [(-1, name, 0, error) for _, name, error in errors]
    return spark.createDataFrame(rows, "pos int, listener string, n long, error string")


add(
    "t09_listeners", _listened,
    """SELECT CAST(0 AS INTEGER) AS pos, 'first' AS listener, count(*) AS n, '' AS error FROM events UNION ALL SELECT CAST(1 AS INTEGER), 'last', count(*) FILTER (event_type = 'error'), '' FROM events
      UNION ALL SELECT CAST(-1 AS INTEGER), 'broken', CAST(0 AS BIGINT), 'broken'""",
)
