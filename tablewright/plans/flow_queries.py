"""Queries of diagnostics, paging and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes
from tablewright.operators import extract as x
from tablewright.operators import paging
from tablewright.plans.base import TITLES, duck, spread, table, view
from tablewright.streaming import diagnostics as t
from tablewright.streaming import stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col
HOUR = 3_600_000


def add(name: str, build, sql: str) -> None:
    QUERIES[name], SQL[name] = build, sql


def events(s, d):
    return table(s, d, "events").withColumn("ms", F.unix_millis(c("ts").cast("timestamp")))


FOLD = """WITH RECURSIVE e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events),
o AS (SELECT {key} AS k, ms, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ms, event_id) AS n FROM e),
w AS (SELECT k, ms, event_id, n, ms AS last, CAST(0 AS BIGINT) AS gap, true AS emitted FROM o WHERE n = 1
  UNION ALL SELECT o.k, o.ms, o.event_id, o.n, CASE WHEN o.ms - w.last >= {ms} THEN o.ms ELSE w.last END, CASE WHEN o.ms - w.last >= {ms} THEN o.ms - w.last END, o.ms - w.last >= {ms}
  FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1)
"""
add(
    "t01_debounce", lambda s, d: t.debounced(events(s, d), "user_id", "ms", "event_id", 24 * HOUR).select("user_id", "event_id", "emitted", "gap_ms"),
    FOLD.format(key="user_id", ms=24 * HOUR) + "SELECT k AS user_id, event_id, emitted, gap AS gap_ms FROM w",
)
add(
    "w07_gap_since_kept", lambda s, d: t.debounced(events(s, d), "user_id", "ms", "event_id", 12 * HOUR).filter("emitted").select("event_id", "gap_ms"),
    FOLD.format(key="user_id", ms=12 * HOUR) + "SELECT event_id, gap AS gap_ms FROM w WHERE emitted",
)
add(
    "t06_cache_use", lambda s, d: t.cache_use(events(s, d), "user_id", "ms", "event_id", 6 * HOUR).select("event_id", "reused"),
    FOLD.format(key="user_id", ms=6 * HOUR) + "SELECT event_id, NOT emitted AS reused FROM w",
)
add(
    "a10_stage_times", lambda s, d: t.stage_times(t.debounced(events(s, d), "user_id", "ms", "event_id", 24 * HOUR), "user_id", "ms"),
    FOLD.format(key="user_id", ms=24 * HOUR) + "SELECT k AS user_id, count(*) AS n, CAST(sum(gap) AS BIGINT) AS total_ms, arg_max(gap, ms) AS last_ms FROM w WHERE emitted GROUP BY k",
)


def metrics(s, d):
    return table(s, d, "events").withColumns({"kind": F.when(c("event_type") == "error", "gauge").otherwise("counter"), "cents": F.round(c("value") * 100).cast("long")})


add(
    "a09_metric_rollup", lambda s, d: t.rollup(metrics(s, d), "ts", "event_type", "kind", "cents"),
    """SELECT CAST(ts AS DATE) AS day, event_type, CASE WHEN event_type = 'error' THEN 'gauge' ELSE 'counter' END AS type,
      CASE WHEN event_type = 'error' THEN arg_max(CAST(round(value * 100) AS BIGINT), ts) ELSE CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) END AS value FROM events GROUP BY 1, 2""",
)
add(
    "t02_daily_counters", lambda s, d: metrics(s, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.sum("cents").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "value"),
    "SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1, 2",
)
REQUESTS = "SELECT event_id, user_id, CAST(100 + event_id % 500 AS INT) AS status, CAST(value * 20 AS BIGINT) AS latency FROM {events}"
add(
    "a11_request_counts", lambda s, d: t.request_counts(view(s, d, REQUESTS.replace("value * 20", "floor(value * 20)")), ["user_id"], "status", "latency"),
    "SELECT user_id, count(*) AS requests, count(*) FILTER (100 + event_id % 500 >= 500) AS errors_5xx, count(*) FILTER (floor(value * 20) > 1500) AS slow FROM events GROUP BY user_id",
)
add(
    "t10_latency_classes", lambda s, d: view(s, d, REQUESTS.replace("value * 20", "floor(value * 20)").replace("event_id % 500", "event_id % 403")).select("event_id", t.latency_class(c("status"), c("latency")).alias("class")),
    "SELECT event_id, CASE WHEN 100 + event_id % 403 >= 500 THEN 'error' WHEN floor(value * 20) > 1500 THEN 'slow' ELSE 'ok' END AS class FROM events",
)
add(
    "t04_ring_buffer", lambda s, d: t.ring(table(s, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id"),
    "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500",
)
#: CRC-32 of an ASCII text, bit by bit.
CRC = """WITH bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, tab[1 + CAST(xor(a, b) & 255 AS INTEGER)])), 4294967295) AS crc FROM events, bits)"""
add("t05_sampled_keys", lambda s, d: t.sampled(table(s, d, "events"), "event_id", 0.1).select("event_id", "user_id"), CRC + " SELECT event_id, user_id FROM c WHERE crc % 10000 < 1000")
add(
    "t14_request_pairs", lambda s, d: stateful.request_spans(table(s, d, "events").select(c("ts").cast("timestamp").alias("ts"), F.when(c("event_id") % 2 == 0, "http:req:start").otherwise("http:req:end").alias("tag"), F.floor(c("event_id") / 2).alias("req_id")), limit_ms=HOUR * 24 * 7).select("req_id", "span_ms", "status"),
    """WITH e AS (SELECT event_id // 2 AS req_id, event_id % 2 AS o, ts FROM events)
    SELECT s.req_id, epoch_us(f.ts) // 1000 - epoch_us(s.ts) // 1000 AS span_ms, CASE WHEN f.ts IS NULL THEN 'open' ELSE 'done' END AS status
    FROM (SELECT * FROM e WHERE o = 0) s LEFT JOIN (SELECT * FROM e WHERE o = 1) f ON f.req_id = s.req_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 7 DAY""",
)
add(
    "t07_retry_schedule", lambda s, d: t.retry_schedule(events(s, d), "event_id", "ms"),
    CRC.replace("CAST(event_id AS VARCHAR)", "name").replace("FROM events, bits", "FROM (SELECT *, event_id || ':' || i AS name FROM events, range(3) r(i)), bits")
    + """, w AS (SELECT event_id, i, epoch_us(ts) // 1000 AS ms, 800 * (1 << CAST(i AS INTEGER)) + crc % 401 AS wait_ms FROM c)
    SELECT event_id, CAST(i AS INTEGER) AS attempt, CAST(wait_ms AS BIGINT) AS wait_ms, CAST(ms + sum(wait_ms) OVER (PARTITION BY event_id ORDER BY i) AS BIGINT) AS at_ms FROM w""",
)
add(
    "t07_backoff", lambda s, d: s.createDataFrame([(i, w) for i, w in enumerate(t.backoff(5, 800))], "attempt int, wait_ms int"),
    "SELECT CAST(i AS INTEGER) AS attempt, CAST(800 * 2 ** i AS INTEGER) AS wait_ms FROM range(5) r(i)",
)
add(
    "t14_request_spans", lambda s, d: events(s, d).groupBy("user_id", F.to_date("ts").alias("day")).agg((F.max("ms") - F.min("ms")).alias("span_ms"), F.count_if(c("event_type") == "error").alias("errors")),
    "SELECT user_id, CAST(ts AS DATE) AS day, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS span_ms, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2",
)
add(
    "o10_merged_stages", lambda s, d: t.merged_stages(table(s, d, "events").select("user_id", "event_id", F.create_map("event_type", c("event_id").cast("string")).alias("stages")), "user_id", "event_id", "stages").select("user_id", F.to_json("stages").alias("stages")),
    """SELECT user_id, '{' || string_agg('"' || event_type || '":"' || i || '"', ',' ORDER BY event_type) || '}' AS stages
      FROM (SELECT user_id, event_type, max(event_id) AS i FROM events GROUP BY 1, 2) GROUP BY user_id""",
)
add(
    "t13_session_windows", lambda s, d: table(s, d, "events").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_millis(c("w.start").cast("timestamp")).alias("start_ms"), "n"),
    """SELECT user_id, min((epoch_us(ts) // 1000)) AS start_ms, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g""",
)
LINKS = "SELECT CAST(n_nationkey AS BIGINT) AS page, CASE WHEN n_nationkey % 6 = 5 THEN CAST(NULL AS BIGINT) ELSE CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) END AS next FROM {nation}"
add(
    "u05_page_walk", lambda s, d: paging.walk(view(s, d, LINKS).select("page"), view(s, d, LINKS), 6),
    f"""WITH RECURSIVE l AS ({duck(LINKS)}), w AS (SELECT page AS start, 1 AS depth, page, [page] AS seen FROM l
      UNION ALL SELECT w.start, w.depth + 1, l.next, list_append(w.seen, l.next) FROM w JOIN l ON l.page = w.page WHERE l.next IS NOT NULL AND NOT list_contains(w.seen, l.next) AND w.depth < 6)
      SELECT start, depth, page FROM w""",
)
#: Lists of pages that name their next page by each rung: rel, text, number, and the url itself.
PAGED = """SELECT p_partkey AS page_id, base || CASE p_partkey % 5 WHEN 3 THEN '?x=1&page=' || k ELSE '/' || k END AS url, CASE p_partkey % 5
  WHEN 0 THEN '<a rel="prev" href="/x">x</a><a rel="next" href="/l0/' || n || '">go</a><div class="pager"><a href="/no">next</a></div>'
  WHEN 1 THEN '<a href="/no">next</a><nav aria-label="Site pagination"><ul><li><a href="/no">1</a></li><li><a href="' || n || '">Nächste  »</a></li></ul></nav>'
  WHEN 2 THEN '<ul class="pagination"><li><a href="/no">' || CAST(p_partkey - 5 AS STRING) || '</a></li><li class="active"><a>' || k || '</a></li><li><a href="/l2/' || n || '">' || CAST(p_partkey + 1 AS STRING) || ' </a></li></ul>'
  WHEN 3 THEN '<p>no pager</p>' ELSE '<div class="pager"><a>next</a><a href="">more</a></div>' END AS html
  FROM (SELECT p_partkey, 'https://p.example/l' || CAST(p_partkey % 5 AS STRING) AS base, CAST(p_partkey AS STRING) AS k, CAST(p_partkey + 5 AS STRING) AS n FROM {part}) q"""
PAGED_SQL = """SELECT p_partkey AS page_id, 'https://p.example/l' || (p_partkey % 5) || CASE p_partkey % 5 WHEN 3 THEN '?x=1&page=' || p_partkey ELSE '/' || p_partkey END AS url,
  CASE p_partkey % 5 WHEN 3 THEN 'https://p.example/l3?x=1&page=' || (p_partkey + 1) WHEN 4 THEN '' ELSE 'https://p.example/l' || (p_partkey % 5) || '/' || (p_partkey + 5) END AS next_url,
  CAST([1, 2, 3, 4, 0][p_partkey % 5 + 1] AS INTEGER) AS rung FROM part"""
add("u05_next_pages", lambda s, d: paging.next_pages(spread(view(s, d, PAGED))), PAGED_SQL)
add(
    "u05_own_links_walk", lambda s, d: paging.page_walk(spread(view(s, d, PAGED)), view(s, d, PAGED).filter("page_id <= 40").select(c("url").alias("page")), 6),
    f"""WITH RECURSIVE l AS ({PAGED_SQL}), w AS (SELECT url AS start, 1 AS depth, url AS page FROM l WHERE page_id <= 40
      UNION ALL SELECT w.start, w.depth + 1, l.next_url FROM w JOIN l ON l.url = w.page WHERE l.next_url <> '' AND w.depth < 6) SELECT * FROM w""",
)
add(
    "u06_candidate_pages", lambda s, d: paging.candidate_pages(view(s, d, TITLES).withColumn("g", c("p_partkey") % 7), "u", "g"),
    f"""WITH src AS ({duck(TITLES)}), g AS (SELECT p_partkey % 7 AS g, max(CASE p_partkey % 7 WHEN 3 THEN p_partkey % 40 WHEN 6 THEN p_partkey % 30 END) AS top, min(regexp_replace(u, '[?#].*$', '')) AS base FROM src GROUP BY 1)
      SELECT g, CAST(n AS INTEGER) AS n, base || '?page=' || n AS url FROM g, range(2, 21) r(n) WHERE top >= 2 AND n <= top""",
)
add(
    "u06_next_page_url", lambda s, d: view(s, d, TITLES).select("p_partkey", paging.next_page_url(c("u")).alias("next_url")),
    f"""WITH src AS ({duck(TITLES)}) SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN regexp_replace(u, '\\d+$', CAST(p_partkey % 40 + 1 AS VARCHAR)) WHEN 6 THEN regexp_replace(u, '\\d+$', CAST(p_partkey % 30 + 1 AS VARCHAR))
      WHEN 2 THEN u || '&page=2' ELSE u || '?page=2' END AS next_url FROM src""",
)
add(
    "u07_path_pages", lambda s, d: view(s, d, "SELECT p_partkey, 'https://x.example/list/' || CAST(p_partkey % 9 AS STRING) || '_1.html' AS u FROM {part}").select("p_partkey", F.posexplode(paging.path_pages(c("u"), 3)).alias("n", "url")),
    "SELECT p_partkey, CAST(n AS INTEGER) AS n, 'https://x.example/list/' || (p_partkey % 9) || '_' || (n + 1) || '.html' AS url FROM part, range(3) r(n)",
)

CARD = {
    "shopify": """<div class="grid-product product-item"><a href="/products/' || k || '"><div class="product-title">' || p_name || ' ' || k || '</div></a><img src="/i/' || k || '.jpg"><span class="price">34,99€</span></div>""",
    "woocommerce": """<ul class="products"><li class="product"><a class="woocommerce-LoopProduct-link" href="/p/' || k || '"><h2>' || p_name || ' ' || k || '</h2></a><img src="/i/' || k || '.jpg"><span class="price">€34,99</span><li class="product">x</ul>""",
    "magento": """<li class="product-item"><a class="product-item-link" href="/p/' || k || '">' || p_name || ' ' || k || '</a><img src="/i/' || k || '.jpg"><span class="price">34,99 €</span></li>""",
    "shopware": """<div class="product-box"><a class="product-title" href="/p/' || k || '">' || p_name || ' ' || k || '</a><img data-src="/i/' || k || '.jpg" src="/x.gif"><span class="product-price">34,99 €</span></div>""",
}


def cards_of(name: str) -> str:
    body = CARD[name]
    return f"""SELECT p_partkey AS page_id, 'https://demo.shop/list' AS url, '<html><body><nav><a href="/cart">x</a></nav>{body}<div class="related product-box product-item">no</div></body></html>' AS html
      FROM (SELECT *, CAST(10000 + p_partkey AS STRING) AS k FROM {{part}}) q"""


for _i, _name in enumerate(CARD):
    _path = "products" if _name == "shopify" else "p"
    add(
        {"shopify": "g05_shopify", "woocommerce": "g08_woocommerce", "magento": "g09_magento", "shopware": "g10_shopware"}[_name] + "_cards",
        lambda s, d, n=_name: x.card_rows(html_nodes(view(s, d, cards_of(n))), view(s, d, cards_of(n)), x.PROFILES[n]).drop("pos"),
        f"SELECT p_partkey AS page_id, p_name || ' ' || (10000 + p_partkey) AS title, 'https://demo.shop/{_path}/' || (10000 + p_partkey) AS url, "
        "'https://demo.shop/i/' || (10000 + p_partkey) || '.jpg' AS img, '34.99' AS price, CAST(10000 + p_partkey AS VARCHAR) AS sku FROM part",
    )
LD = """SELECT p_partkey AS page_id, 'https://demo.shop/x' AS url, '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"' || p_name || '","url":"/p/' || CAST(p_partkey AS STRING) ||
  '","offers":{"@type":"Offer","price":"1.' || CAST(100 + p_partkey % 900 AS STRING) || ',50","priceCurrency":"EUR"},"mpn":"M' || CAST(p_partkey AS STRING) || '"}]}</script><script type="application/ld+json">{bad</script>' AS html FROM {part}"""
add(
    "g07_jsonld_items", lambda s, d: x.jsonld_items(view(s, d, LD)).select("page_id", "title", "url", "price", "sku"),
    "SELECT p_partkey AS page_id, p_name AS title, 'https://demo.shop/p/' || p_partkey AS url, '1' || (100 + p_partkey % 900) || '.50' AS price, 'M' || p_partkey AS sku FROM part",
)
DETAIL = """SELECT p_partkey AS page_id, 'https://demo.shop/x' AS url, '<head><title>t</title>' || CASE WHEN p_partkey % 2 = 0 THEN '<meta property="og:title" content="' || p_name || '"><meta property="og:type" content="product">' ELSE '' END ||
  '</head><body><h1>H ' || p_name || '</h1><img src="/a.png"><span itemprop="price" content="' || CAST(p_partkey AS STRING) || '.00"></span><b itemprop="sku">S' || CAST(p_partkey AS STRING) || '</b></body>' AS html FROM {part}"""
add(
    "g21_detail_fields", lambda s, d: x.detail_fields(html_nodes(view(s, d, DETAIL))).select("page_id", "title", "img", "price", "desc", "sku", "is_detail"),
    "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'H ' || p_name END AS title, '/a.png' AS img, p_partkey || '.00' AS price, '' AS \"desc\", 'S' || p_partkey AS sku, true AS is_detail FROM part",
)
ROOT = """SELECT p_partkey AS page_id, 'u' AS url, '<div class="content"><a href="/a"><img src="x"></a></div><div id="main"><div class="card"></div><a href="/b"><img src="y"></a><a href="/c"><img src="z"></a></div>' AS html FROM {part}"""
add(
    "c13_page_roots", lambda s, d: x.page_roots(html_nodes(view(s, d, ROOT))).drop("end"),
    "SELECT p_partkey AS page_id, CAST(3 AS INTEGER) AS root, CAST(8 AS BIGINT) AS score, 0.2 + 8 / 50 AS confidence FROM part",
)
add(
    "g02_node_table", lambda s, d: html_nodes(table(s, d, "pages")).filter("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("n")),
    r"SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*>')) AS n FROM pages WHERE n > 0",
)
MIXED = """SELECT p_partkey AS page_id, 'https://demo.shop/list' AS url, CASE WHEN p_partkey % 3 = 0 THEN '<script src="//cdn.shopify.com/a.js"></script>' ELSE '' END ||
  CASE WHEN p_partkey % 3 < 2 THEN '<div class="product-item item"><a href="/products/1">A 1001</a></div><div class="product-item item"><a href="/products/2">B 1002</a></div><div class="product-item item"><a href="/products/3">C 1003</a></div>'
  ELSE '<a href="/product/9">Only 9999</a>' END AS html FROM {part}"""
add(
    "g14_parse_catalog", lambda s, d: x.parse_catalog(spread(view(s, d, MIXED))).select("page_id", "pos", "adapter", "title", "url", "sku"),
    """SELECT p_partkey AS page_id, CAST(n AS INTEGER) AS pos, CASE p_partkey % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'static' ELSE 'links' END AS adapter,
      CASE WHEN p_partkey % 3 = 2 THEN 'Only 9999' ELSE ['A 1001', 'B 1002', 'C 1003'][n] END AS title, 'https://demo.shop/' || CASE WHEN p_partkey % 3 = 2 THEN 'product/9' ELSE 'products/' || n END AS url,
      CASE WHEN p_partkey % 3 = 2 THEN '9999' ELSE CAST(1000 + n AS VARCHAR) END AS sku FROM part, range(1, 4) r(n) WHERE p_partkey % 3 < 2 OR n = 1""",
)
