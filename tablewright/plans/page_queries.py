"""Queries that classify pages and links, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes
from tablewright.functions.prices import NEAR_PRICE
from tablewright.operators import classify as k
from tablewright.operators import relational, twig
from tablewright.plans.base import TITLES, duck, spread, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, source: str, build, select: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir, source))
    SQL[name] = f"WITH src AS ({duck(source)})\n{select}"


#: Pages of shops, rendered from parts.
SHOPS = """SELECT p_partkey, 'https://' || CASE p_partkey % 3 WHEN 0 THEN 'a.shop.example' WHEN 1 THEN 'shop.example' ELSE 'other.example' END
  || CASE p_partkey % 5 WHEN 0 THEN '/collections/x' WHEN 1 THEN '/category/y' ELSE '/z' END AS url,
  CASE p_partkey % 8 WHEN 0 THEN '<script src="//cdn.shopify.com/x.js"></script>' WHEN 1 THEN '<link href="/wp-content/plugins/woocommerce/a.css">'
  WHEN 2 THEN '<input name="form_key">' WHEN 3 THEN '<div class="sw-block">' WHEN 4 THEN '<script type="application/ld+json">{"@type" : "Product","name":"x"}</script>'
  WHEN 5 THEN '<script type="application/ld+json">{"@type":"Thing","offers":{"a":1,"price":"2"}}</script>' WHEN 6 THEN '<p class="product-grid">Preis 9,99 € In den Warenkorb</p>'
  ELSE '<p>' || p_name || '</p>' END AS html FROM {part}"""
add(
    "c01_platform", SHOPS, lambda d: d.select("p_partkey", k.platform(c("html")).alias("platform")),
    "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Shopify' WHEN 1 THEN 'WooCommerce' WHEN 2 THEN 'Magento' WHEN 3 THEN 'Shopware' ELSE '' END AS platform FROM src",
)
add(
    "c02_platform_flags", SHOPS, lambda d: d.select("p_partkey", *[f.alias(n.lower()) for n, f in k.platform_flags(c("html")).items()]),
    "SELECT p_partkey, p_partkey % 8 = 0 AS shopify, p_partkey % 8 = 1 AS woocommerce, p_partkey % 8 = 2 AS magento, p_partkey % 8 = 3 AS shopware FROM src",
)
add(
    "c03_product_jsonld", SHOPS, lambda d: d.select("p_partkey", k.has_product_jsonld(c("html")).alias("has")),
    "SELECT p_partkey, p_partkey % 8 IN (4, 5) AS has FROM src",
)
add(
    "c04_page_type", SHOPS,
    lambda d: d.select(
        "p_partkey", k.page_type(c("html")).alias("type"), c("html").rlike(k.PRICE_SIGNAL).alias("has_price"), c("html").rlike(k.CART_SIGNAL).alias("has_cart")
    ),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 8 IN (4, 5) THEN 'detail' ELSE 'list' END AS type,
      regexp_matches(html, '(?i)€|eur|preis|price|chf|\$|£') AS has_price, regexp_matches(html, '(?i)add-?to-?cart|warenkorb|detail-?btn|buy-?now') AS has_cart FROM src""",
)
add(
    "c05_product_path", TITLES, lambda d: d.select("p_partkey", k.is_product_path(c("u")).alias("product")),
    r"""SELECT p_partkey, regexp_matches(lower(u), '/products?/|/prod/|/item/|/p/|/details?/|/artikel/|/sku/|/dp/|/kaufen/|/buy/') AND NOT p_partkey % 7 IN (2, 4) AS product FROM src""",
)
add(
    "c06_contains_any", SHOPS,
    lambda d: d.select("p_partkey", k.contains_any(c("html"), k.PRICE_TOKENS).alias("price"), k.contains_any(c("html"), k.CART_TOKENS).alias("cart")),
    """SELECT p_partkey, regexp_matches(lower(html), 'price|preis|[€$¥]|eur|usd|mwst|uvp|sale|angebot') AS price,
      regexp_matches(lower(html), 'add[ -]to[ -]cart|cart/add|buy now|warenkorb|kaufen|einkaufswagen|checkout') AS cart FROM src""",
)
add(
    "c08_light_class", SHOPS,
    lambda d: d.select("p_partkey", k.light_class(c("url"), c("html")).alias("x")).select("p_partkey", "x.platform", "x.type", "x.adapter_hint"),
    """SELECT *, CASE WHEN platform = '' THEN '' WHEN type = '' THEN platform ELSE platform || ':' || type END AS adapter_hint FROM (
      SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'shopify' WHEN p_partkey % 8 = 1 THEN 'woocommerce' ELSE '' END AS platform,
      CASE WHEN p_partkey % 5 < 2 OR p_partkey % 8 = 6 THEN 'catalog' ELSE '' END AS type FROM src)""",
)
add(
    "c10_adapter", SHOPS, lambda d: d.select("p_partkey", k.adapter(F.when(c("p_partkey") % 11 == 0, "hinted"), c("url"), c("html"), {"shop.example": "shop"}).alias("adapter")),
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'hinted' WHEN p_partkey % 3 < 2 THEN 'shop' WHEN p_partkey % 8 = 0 THEN 'shopify' WHEN p_partkey % 8 = 1 THEN 'woocommerce'
      WHEN p_partkey % 8 = 2 THEN 'magento' WHEN p_partkey % 8 = 3 THEN 'shopware' ELSE 'generic' END AS adapter FROM src""",
)
add(
    "c11_host_test", SHOPS, lambda d: d.select("p_partkey", k.host(c("url")).rlike(r"(^|\.)shop\.example$").alias("hit")),
    "SELECT p_partkey, p_partkey % 3 < 2 AS hit FROM src",
)
SHOP_URLS = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'https://www.memoryking.de/a' WHEN 1 THEN 'https://memoryking.de.example/a' WHEN 2 THEN 'http://www.sinotronic-e.com/list/3_1.html' WHEN 3 THEN 'https://demo.shopware.example/x' WHEN 4 THEN 'https://s.example/Kategorie/7?x=1'
  WHEN 5 THEN 'https://s.example/a?sPage=2#top' WHEN 6 THEN 'https://m.example/catalog/category/view/5' WHEN 7 THEN 'https://m.example/a.html?x' WHEN 8 THEN 'https://w.example/product-category/lamps' WHEN 9 THEN 'no url /listing' END AS url FROM {part}"""
add(
    "c11_shop_tests", SHOP_URLS, lambda d: d.select("p_partkey", *[t.alias(n) for n, t in k.shop_tests(c("url")).items()]),
    """SELECT p_partkey, n = 0 AS memoryking, n = 2 AS sinotronic, n IN (3, 4, 5) AS shopware, n IN (2, 6, 7) AS magento, n = 8 AS woocommerce FROM (SELECT p_partkey, p_partkey % 11 AS n FROM src)""",
)
add(
    "c15_fetch_probe", "SELECT event_id, CAST(user_id % 500 + 100 AS INT) AS status, CASE WHEN event_id % 3 = 0 THEN 'text/html; charset=utf-8' ELSE 'image/png' END AS kind FROM {events}",
    lambda d: d.select("event_id", (c("status").between(200, 299) & c("kind").startswith("text/html")).alias("ok"), ((c("status") >= 200) & (c("status") < 400)).alias("window")),
    "SELECT event_id, status // 100 = 2 AND kind LIKE 'text/html%' AS ok, status BETWEEN 200 AND 399 AS window FROM src",
)
add(
    "s02_fetch_strategy", SHOPS,
    lambda d: d.select("p_partkey", k.fetch_strategy(c("url"), F.lit(""), c("p_partkey") % 6, c("p_partkey") % 2 == 0).alias("x")).select("p_partkey", "x.*"),
    """SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 6 >= 3 AS use_browser, CASE WHEN p_partkey % 5 = 0 THEN 12000 ELSE 18000 END AS timeout_ms,
      CASE WHEN p_partkey % 2 = 0 THEN 350 ELSE 0 END AS delay_ms FROM src""",
)
add(
    "s03_oversized", "SELECT doc_id, text FROM {documents}", lambda d: d.select("doc_id", k.oversized(F.repeat("text", 10)).alias("oversized")),
    "SELECT doc_id, 10 * length(text) > 200000 AS oversized FROM src",
)
add(
    "f01_bad_links", TITLES, lambda d: d.filter(~c("u").rlike(k.BAD_LINK)).select("p_partkey", "u"),
    "SELECT p_partkey, u FROM src WHERE NOT p_partkey % 7 IN (2, 4)",
)
JUNK = """SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'Impressum' WHEN 1 THEN 'red ring' ELSE 'Zum Produkt' END AS t,
  CASE page_id % 5 WHEN 0 THEN 'https://elsewhere.example/p/1' WHEN 1 THEN 'https://x.example/a.JPG' WHEN 2 THEN url || '/agb' ELSE url END AS link FROM {pages}"""
add(
    "f02_junk_link", JUNK, lambda d: d.select("page_id", k.is_junk_link(c("t"), c("link"), c("url")).alias("junk")),
    r"""SELECT page_id, page_id % 4 = 0 OR page_id % 5 < 3 OR regexp_matches(lower(link), 'impressum|privacy|datenschutz|agb|terms|policy|kontakt|contact|login|account|register') AS junk FROM src""",
)
add(
    "f03_link_score", TITLES, lambda d: d.select("p_partkey", k.link_score(c("u"), c("t"), NEAR_PRICE).alias("score")),
    r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN -3 WHEN 5 THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches(lower(coalesce(t, '')), '(?:^|[^\d])\d{1,3}(?:[.\s]\d{3})*[,.\s]\d{2}') THEN 2 ELSE 0 END
      - CASE WHEN regexp_matches(lower(coalesce(t, '')), 'home|start|audio|video|strom|multimedia|b-run|solar|computer') THEN 2 ELSE 0 END AS score
    FROM (SELECT p_partkey, t, u FROM src)""",
)
add(
    "f04_junk_title", JUNK, lambda d: d.select("page_id", F.trim("t").rlike(k.JUNK_TITLE).alias("junk")),
    "SELECT page_id, page_id % 4 > 1 AS junk FROM src",
)
add(
    "f05_shopify_product", TITLES, lambda d: d.select("p_partkey", k.is_shopify_product(c("u")).alias("product")),
    "SELECT p_partkey, p_partkey % 7 = 0 AS product FROM src",
)
add(
    "f06_platform_title", TITLES, lambda d: d.select("p_partkey", k.platform_title(c("t")).alias("title")),
    r"SELECT p_partkey, CASE WHEN p_partkey % 9 = 5 THEN '' ELSE trim(regexp_replace(coalesce(t, ''), '\s+', ' ', 'g')) END AS title FROM src",
)
add(
    "f07_bad_path", TITLES,
    lambda d: d.select("p_partkey", k.is_bad_path(c("u"), "woocommerce").alias("woocommerce"), k.is_bad_path(c("u"), "magento").alias("magento")),
    "SELECT p_partkey, p_partkey % 7 IN (2, 4) AS woocommerce, p_partkey % 7 IN (2, 4) AS magento FROM src",
)
add(
    "f15_required_fields", TITLES, lambda d: relational.required_fields(d, "u", "t", "k").select("p_partkey"),
    "SELECT p_partkey FROM src WHERE u <> '' AND coalesce(t, '') || coalesce(k, '') <> ''",
)

ANCHOR_SQL = r"""
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS a, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')))) AS pos FROM pages),
l AS (SELECT page_id, url, pos, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href,
  trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS text FROM a)"""
QUERIES["g01_anchors"] = lambda spark, d: k.anchors(table(spark, d, "pages")).drop("url")
SQL["g01_anchors"] = f"WITH {ANCHOR_SQL} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, text FROM l WHERE href <> ''"
#: A page of links for each part.
LINK_PAGES = """SELECT p_partkey AS page_id, 'https://shop.example/list?x=1' AS url, '<nav><a href="/home">Home</a></nav><a class="c" href="/p/' || CAST(p_partkey AS STRING)
  || '"><b>' || p_name || '</b> ab 9,99 €</a><a href="/product/' || CAST(p_partkey % 5 AS STRING) || '">' || p_name || '</a><a href="/product/' || CAST(p_partkey % 3 AS STRING)
  || '">again</a><a href="/p/x.pdf">sheet</a><a href="https://elsewhere.example/p/1">off</a><a href="/shop/agb">AGB</a><a name="n">none</a>' AS html FROM {part}"""


def _links_sql(source: str, least: int) -> str:
    return rf"""WITH pages AS ({source}), {ANCHOR_SQL},
u AS (SELECT *, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS link FROM l WHERE href <> ''),
s AS (SELECT *, CASE WHEN regexp_matches(lower(link), 'product|produkt|artikel|item|sku|p/|/p-|/prod|/shop/|/detail|/kaufen|/buy|/add-to-cart') THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), '(?:^|[^\d])\d{{1,3}}(?:[.\s]\d{{3}})*[,.\s]\d{{2}}') THEN 2 ELSE 0 END
  - CASE WHEN regexp_matches(lower(text), 'home|start|audio|video|strom|multimedia|b-run|solar|computer') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(lower(link), '/p/|/pd/|/detail|/produkt|/product') THEN 2 ELSE 0 END AS score
  FROM u WHERE regexp_extract(url, '^[a-z]+://[^/?#]*') = regexp_extract(link, '^[a-z]+://[^/?#]*')
  AND NOT regexp_matches(lower(text), '{"|".join(k.JUNK_WORDS)}') AND NOT regexp_matches(lower(link), '{k.LEGAL_PATH}')
  AND NOT regexp_matches(lower(link), '\.(?:jpg|jpeg|png|webp|gif|svg|pdf|docx?|xlsx?|zip|rar)$')),
f AS (SELECT * FROM s WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INTEGER) AS rank, link AS url, text AS title, CAST(score AS INTEGER) AS score
FROM f QUALIFY rank <= 200"""


QUERIES["g03_deep_anchors"] = lambda spark, d: k.deep_anchors(view(spark, d, LINK_PAGES), NEAR_PRICE)
SQL["g03_deep_anchors"] = _links_sql(duck(LINK_PAGES), 1)
QUERIES["g03_page_links"] = lambda spark, d: k.deep_anchors(table(spark, d, "pages"), NEAR_PRICE, least=-9)
SQL["g03_page_links"] = _links_sql("SELECT * FROM main.pages", -9)
FAMILIES = [("grid", "div.product-grid a", ["title", "price"]), ("list", "ul.products li", ["title", "price", "sku"]), ("table", "table tr td", ["sku"])]


def _families(spark, sf_dir):
    samples = view(
        spark, sf_dir,
        """SELECT p_partkey AS sample_id, CASE p_partkey % 4 WHEN 0 THEN 'div.product-grid > a' WHEN 1 THEN 'ul.products' WHEN 2 THEN 'td' ELSE 'x' END AS selector,
        CASE p_partkey % 3 WHEN 0 THEN array('title', 'price') WHEN 1 THEN array('sku') ELSE array('other') END AS fields FROM {part}""",
    )
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(FAMILIES)], "pos int, family_id string, selector string, fields array<string>")
    return k.predict_family(samples, rows)


QUERIES["c09_template_family"] = _families
SQL["c09_template_family"] = """
WITH s AS (SELECT p_partkey AS sample_id, CASE p_partkey % 4 WHEN 0 THEN ['div', 'product-grid', 'a'] WHEN 1 THEN ['ul', 'products'] WHEN 2 THEN ['td'] ELSE ['x'] END AS st,
  CASE p_partkey % 3 WHEN 0 THEN ['title', 'price'] WHEN 1 THEN ['sku'] ELSE ['other'] END AS sf FROM part),
f(pos, family_id, ft, ff) AS (VALUES (0, 'grid', ['div', 'product-grid', 'a'], ['title', 'price']), (1, 'list', ['ul', 'products', 'li'], ['title', 'price', 'sku']),
  (2, 'table', ['table', 'tr', 'td'], ['sku'])),
p AS (SELECT sample_id, pos, family_id, 0.6::DOUBLE * len(list_intersect(st, ft)) / len(list_distinct(list_concat(st, ft)))
  + 0.4::DOUBLE * len(list_intersect(sf, ff)) / len(list_distinct(list_concat(sf, ff))) AS score FROM s, f)
SELECT sample_id, CASE WHEN score > 0 THEN family_id ELSE 'UNKNOWN' END AS family_id, round(score, 3) AS score FROM p
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, pos) = 1
"""

# Selectors with structure that shops' pages are read by.
SHOP_SELECTORS = {
    "list_items": "#productlist ul > li", "shop_list": "ul.products li.product", "any_items": "ul li", "picture_links": "a[href] img", "pictures": "picture source[srcset], picture source[data-srcset]",
    "gallery": ".product-media img, .gallery img, img", "product_images": "img#productImage, .product-image img, .product-slider img, picture img", "titles": ".product-item-link, .product.name a, .product-item-name, h2, h3",
    "amounts": ".price .amount,.price", "boxes": ".product--box, .product--listing .product--box", "info_price": ".product-info .price, .price", "last_crumb": ".breadcrumb li:last, .breadcrumbs li:last, nav[aria-label=\"breadcrumb\"] li:last",
    "pager": ".pagination a[href], nav.pagination a[href], .page-numbers a[href], .pager a[href]", "blocks": "body > *", "labelled": "*:contains(\"Artikel-Nr\")", "sku_entry": "li.base-info--entry.entry--sku",
    "content": "#nx_content .listproduct-wrapper .listproduct",
}

#: Selectors with structure, and what they mean on the given pages (a nav, an advert, an article of a heading and paragraphs, a footer).
STRUCTURED = {
    "nav_links": "nav ul > li a[href]", "paragraphs": "article > p", "bold": "article p b", "blocks": "body > *", "last_item": "nav li:last", "lead": "h1 + p", "after_title": "h1 ~ p",
    "first_item": "ul > li:first-child", "next_paragraphs": "p + p, nav + p", "no_links": "footer > a, article nav", "third": "article > p:eq(2)", "plain": "body > div:not(.ad), body > footer",
}
QUERIES["g01_twig_join"] = lambda spark, d: twig.find(html_nodes(spread(table(spark, d, "pages"))), STRUCTURED, in_order=True).groupBy("page_id", "name").agg(F.count("*").alias("n"))
SQL["g01_twig_join"] = r"""
WITH s AS (SELECT page_id, html, regexp_extract(html, '(?s)<article.*?</article>') AS a, regexp_extract(html, '(?s)<nav.*?</nav>') AS v FROM pages),
n AS (SELECT page_id, len(regexp_extract_all(v, '<a ')) AS l, len(regexp_extract_all(a, '<p[ >]')) AS p, len(regexp_extract_all(a, '<b>')) AS b,
  len(regexp_extract_all(html, '<(?:nav|div|article|footer)[ >]')) AS k, len(regexp_extract_all(html, '<footer[ >]')) AS f FROM s),
r(page_id, name, n) AS (
  SELECT page_id, 'nav_links', l FROM n UNION ALL SELECT page_id, 'paragraphs', p FROM n UNION ALL SELECT page_id, 'bold', b FROM n UNION ALL SELECT page_id, 'blocks', k FROM n
  UNION ALL SELECT page_id, 'last_item', least(l, 1) FROM n UNION ALL SELECT page_id, 'lead', least(p, 1) FROM n UNION ALL SELECT page_id, 'after_title', p FROM n
  UNION ALL SELECT page_id, 'first_item', least(l, 1) FROM n UNION ALL SELECT page_id, 'next_paragraphs', greatest(p - 1, 0) FROM n
  UNION ALL SELECT page_id, 'third', CASE WHEN p > 2 THEN 1 ELSE 0 END FROM n UNION ALL SELECT page_id, 'plain', f FROM n)
SELECT * FROM r WHERE n > 0
"""
