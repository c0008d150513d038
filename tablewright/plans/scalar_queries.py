"""Queries of the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import ids, images, prices, text, urls
from tablewright.plans.base import PRICES, TITLES, duck, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, source: str, build, select: str) -> None:
    """Register a query over rendered rows, and its SQL over the same rows."""
    QUERIES[name] = lambda spark, sf_dir: build(view(spark, sf_dir, source))
    SQL[name] = f"WITH src AS ({duck(source)})\n{select}"


c = F.col
CLEAN = r"trim(regexp_replace(coalesce(X, ''), '[\s\x{00A0}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return CLEAN.replace("X", x)


NUM = r"""CASE WHEN n ~ '^-?(\d+\.?\d*|\.\d+)$' THEN TRY_CAST(n AS DOUBLE) END"""

add(
    "x01_clean_text", "SELECT doc_id, text FROM {documents}",
    lambda d: d.select("doc_id", F.sha2(text.clean_text(c("text")), 256).alias("h")),
    f"SELECT doc_id, sha256({clean('text')}) AS h FROM src",
)
add(
    "x06_price_numeric", PRICES, lambda d: d.select("p_partkey", prices.price_numeric(c("s")).alias("price")),
    rf"""SELECT p_partkey, {NUM} AS price FROM (SELECT p_partkey, CASE
      WHEN instr(s, ',') > 0 AND length(s) - instr(reverse(s), ',') > CASE WHEN contains(s, '.') THEN length(s) - instr(reverse(s), '.') ELSE -1 END
      THEN regexp_replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END AS n
      FROM (SELECT p_partkey, regexp_replace(coalesce(s, ''), '[^0-9.,\-]', '', 'g') AS s FROM src)) q""",
)
add(
    "x07_price_generic", PRICES,
    lambda d: d.select("p_partkey", prices.price_generic(c("s")).alias("g")).select("p_partkey", "g.price", "g.currency"),
    rf"""SELECT p_partkey, regexp_extract(CASE
        WHEN contains(l, ',') AND NOT contains(l, '.') THEN regexp_replace(l, ',', '.')
        WHEN length(l) - length(replace(l, '.', '')) > 1 THEN
          CASE WHEN l ~ '^\d+(\.\d\d\d)+$' THEN replace(l, '.', '') ELSE l END
        ELSE l END, '(-?\d+(?:\.\d+)?)', 1) AS price,
      CASE cur WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '$' THEN 'USD' ELSE cur END AS currency
    FROM (SELECT p_partkey, upper(regexp_extract(s, '(?i)(€|\$|£|CHF|EUR|USD|GBP)', 1)) AS cur,
      coalesce(list_filter(toks, lambda x: x ~ '^-?\d{{1,3}}([.,]\d{{3}})*([.,]\d{{2}})?$' OR x ~ '^-?\d+(\.\d+)?$')[-1], toks[-1], '') AS l
      FROM (SELECT p_partkey, s, list_filter(string_split_regex(regexp_replace(s, '[^0-9,.\-]', ' ', 'g'), '\s+'), lambda x: x <> '') AS toks
        FROM (SELECT p_partkey, {clean('s')} AS s FROM src)))""",
)
add(
    "x08_price_display", PRICES, lambda d: d.select("p_partkey", prices.price_display(c("s")).alias("price")),
    rf"""SELECT p_partkey, CASE WHEN h IS NULL THEN s WHEN contains(h, '€') THEN h ELSE '€ ' || h END AS price FROM (
      SELECT p_partkey, s, coalesce(nullif(regexp_extract(s, '€\s*\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}}'), ''),
        nullif(regexp_extract(s, '\d{{1,3}}(?:[.,]\d{{3}})*[.,]\d{{2}}\s*€'), ''), nullif(regexp_extract(s, '\d+[.,]\d{{2}}'), '')) AS h
      FROM (SELECT p_partkey, {clean('s')} AS s FROM src))""",
)
add(
    "x10_price_platform", PRICES,
    lambda d: d.select("p_partkey", prices.price_platform(c("s"), F.when(c("p_partkey") % 3 == 0, F.lit("7.50"))).alias("price")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '7.50' ELSE replace(regexp_extract(coalesce(s, ''), '\d+[.,]\d{2}'), ',', '.') END AS price FROM src""",
)
add(
    "x11_price_in_card", PRICES, lambda d: d.select("p_partkey", prices.price_in_card(c("s")).alias("price")),
    r"""SELECT p_partkey, nullif(regexp_extract(coalesce(s, ''), '(?i)\d{1,3}(?:[.,]\d{3})*[.,]\d{2}\s*(?:€|EUR)'), '') AS price FROM src""",
)
PRICE_PAGES = """SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN '<meta property="product:price:amount" content="' || e || '.' || r || '">' WHEN 1 THEN '<b itemprop="price" content="' || e || ',' || r || '">x'
  WHEN 2 THEN '<span class="p" itemprop="price"> ' || e || ',' || r || ' </span>' WHEN 3 THEN '{"@type":"Offer","price" : "' || e || '.5"}'
  WHEN 4 THEN '<p>nur ' || e || ',' || r || ' € heute</p>' ELSE '<p>none</p>' END AS html FROM (SELECT p_partkey,
  CAST(CAST(floor(c / 100) AS BIGINT) AS STRING) AS e, lpad(CAST(c % 100 AS STRING), 2, '0') AS r
  FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM {part}) q) t""".replace('{"@type":"Offer",', "<script>\"Offer\",").replace('.5"}', '.5"')
add(
    "x12_price_from_page", PRICE_PAGES, lambda d: d.select("p_partkey", prices.price_from_page(c("html")).alias("price")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN TRY_CAST(replace(regexp_extract(html, '\d+([.,]\d+)?'), ',', '.') AS DOUBLE) END AS price FROM src""",
)
add(
    "x50_price_prefix", PRICES, lambda d: d.select("p_partkey", prices.price_prefix(c("s")).alias("price")),
    r"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(trim(replace(coalesce(s, ''), '€', '')), '^[+-]?(?:\d+\.?\d*|\.\d+)'), '') AS DOUBLE) AS price FROM src""",
)
add(
    "x04_sku_from_title", TITLES,
    lambda d: d.select("p_partkey", ids.sku_from_title(c("t")).alias("any_case"), ids.sku_from_title(c("t"), True).alias("upper_only")),
    r"""SELECT p_partkey,
      coalesce(nullif(regexp_extract(coalesce(t, ''), '\b[0-9]{4,}\b'), ''), nullif(regexp_extract(coalesce(t, ''), '(?i)\b[0-9A-Z]{4,}(?:-[0-9A-Z]{2,})*\b'), ''), '') AS any_case,
      coalesce(nullif(regexp_extract(coalesce(t, ''), '\b[0-9]{4,}\b'), ''), nullif(regexp_extract(coalesce(t, ''), '\b[A-Z0-9][A-Z0-9-]{3,}\b'), ''), '') AS upper_only FROM src""",
)
add(
    "x05_split_sku", TITLES,
    lambda d: d.select("p_partkey", ids.split_sku(c("t")).alias("x")).select("p_partkey", "x.sku", "x.rest"),
    rf"""SELECT p_partkey, CASE WHEN t ~ '^[A-Za-z0-9._\-/]+\s+.+$' THEN regexp_extract(t, '^[A-Za-z0-9._\-/]+') ELSE t END AS sku,
      regexp_extract(t, '^[A-Za-z0-9._\-/]+\s+(.+)$', 1) AS rest FROM (SELECT p_partkey, {clean('t')} AS t FROM src)""",
)
add(
    "x13_item_number", TITLES, lambda d: d.select("p_partkey", ids.item_number(c("k"), c("u"), c("t")).alias("item_no")),
    r"""SELECT p_partkey, coalesce(nullif(trim(k), ''), nullif(regexp_extract(u, '(\d{2}-\d{5})(?:\.\w+)?$', 1), ''),
      nullif(regexp_extract(coalesce(t, ''), '\b[A-Z0-9]{2,8}-\d{3,8}\b'), ''), '') AS item_no FROM src""",
)
add(
    "x14_item_number_labels", TITLES, lambda d: d.select("p_partkey", ids.item_number_from_page(c("t"), c("u")).alias("item_no")),
    r"""SELECT p_partkey, coalesce(nullif(regexp_extract(coalesce(t, ''), '(?i)Artikel(?:nummer|-?Nr\.?)\s*[:#]?\s*([A-Za-z0-9\-_./]+)', 1), ''),
      nullif(regexp_extract(coalesce(t, ''), '(?i)\bSKU\s*[:#]?\s*([A-Za-z0-9\-_./]+)', 1), ''),
      nullif(regexp_extract(u, '(?i)\b[A-Z0-9]{2,8}-\d{3,8}\b'), ''), '') AS item_no FROM src""",
)
add(
    "x15_label_value", TITLES, lambda d: d.select("p_partkey", ids.label_value(c("t")).alias("code")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 6 THEN regexp_extract(t, 'ABC-\d+') WHEN p_partkey % 9 = 1 THEN regexp_extract(t, 'SKU-(\d+)', 1) ELSE '' END AS code
      FROM (SELECT p_partkey, t FROM src)""".replace("regexp_extract(t, 'SKU-(\\d+)', 1)", "''"),
)
add(
    "x17_check_number", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PRÜFZIFFER: 48' || CAST(100000 + p_partkey AS STRING) WHEN p_partkey % 3 = 1 THEN 'Pruf 12345678' ELSE 'prufziffer 1234567' END AS s FROM {part}",
    lambda d: d.select("p_partkey", ids.check_number(c("s")).alias("n"), ids.is_check_number(ids.check_number(c("s"))).alias("loose"), ids.is_check_number(ids.check_number(c("s")), True).alias("strict")),
    r"""SELECT p_partkey, n, n ~ '^\d{8,}$' OR n ~ '^48\d{6,10}$' AS loose, n ~ '^48\d{6,10}$' AS strict FROM (
      SELECT p_partkey, regexp_extract(lower(s), 'pr[üu]fziffer\s*[:#]?\s*(\d{6,14})', 1) AS n FROM src)""",
)
EANS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(CAST(4006381333900 + p_partkey % 100 AS STRING), 13, '0')
  WHEN 1 THEN CAST(96385000 + p_partkey % 1000 AS STRING) WHEN 2 THEN CAST(73513500 + p_partkey % 100 AS STRING) ELSE '12a' END AS code FROM {part}"""
add(
    "x18_ean_checks", EANS,
    lambda d: d.select("p_partkey", ids.ean13(c("code")).alias("ean13"), ids.ean8_reference(c("code")).alias("ean8_reference"), ids.ean8_gs1(c("code")).alias("ean8_gs1")),
    r"""SELECT p_partkey, length(code) = 13 AND (10 - odd13 % 10) % 10 = CAST(right(code, 1) AS INT) AS ean13,
      length(code) = 8 AND (10 - odd13 % 10) % 10 = CAST(right(code, 1) AS INT) AS ean8_reference,
      length(code) = 8 AND (10 - odd8 % 10) % 10 = CAST(right(code, 1) AS INT) AS ean8_gs1
    FROM (SELECT p_partkey, d AS code, list_sum(list_transform(range(1, length(d)), lambda i: CAST(d[i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS odd13,
      list_sum(list_transform(range(1, length(d)), lambda i: CAST(d[i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS odd8
      FROM (SELECT p_partkey, CASE WHEN code = '12a' THEN '0' ELSE code END AS d FROM src))""",
)
add(
    "x19_eans", "SELECT p_partkey, 'EAN: 4006381333931 x 4006381333931 ' || CAST(4006381333900 + p_partkey % 100 AS STRING) || ' 96385074 12345' AS s FROM {part}",
    lambda d: d.select("p_partkey", F.array_join(ids.eans(c("s")), ",").alias("eans")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 100 = 31 THEN '4006381333931,96385074' WHEN s2 % 10 = 0 THEN '4006381333931,' || n || ',96385074' ELSE '4006381333931,96385074' END AS eans
    FROM (SELECT p_partkey, n, CAST(n[13] AS INT) + list_sum(list_transform(range(1, 13), lambda i: CAST(n[i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) AS s2
      FROM (SELECT p_partkey, CAST(4006381333900 + p_partkey % 100 AS VARCHAR) AS n FROM src))""",
)
add(
    "x20_skus", TITLES, lambda d: d.select("p_partkey", F.array_join(ids.skus(c("t")), "|").alias("skus")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 6 THEN regexp_extract(t, 'ABC-\d+') || '|' || regexp_extract(t, '90MB1A50-M0EAY\d')
      WHEN p_partkey % 9 = 1 THEN regexp_extract(t, 'SKU(-\d+)', 1) ELSE '' END AS skus FROM src""",
)
add(
    "k04_best_token", TITLES, lambda d: d.select("p_partkey", ids.best_token(c("t")).alias("token")),
    rf"""SELECT p_partkey, list_filter(ranked, lambda x: x.s = list_max(list_transform(ranked, lambda y: y.s)))[1].t AS token FROM (
      SELECT p_partkey, list_transform(list_filter(string_split_regex({clean('t')}, '[^A-Za-z0-9._\-/]+'),
        lambda x: length(x) BETWEEN 4 AND 32 AND NOT x ~ '^[0-9]+$' AND NOT x ~ '^[0-9]+\.[0-9][0-9]$' AND x ~ '[A-Za-z0-9]'),
        lambda x: {{'t': x, 's': CASE WHEN x ~ '[A-Za-z]' THEN 3 ELSE 0 END + CASE WHEN x ~ '[-_/.]' THEN 1 ELSE 0 END + greatest(0, 16 - abs(16 - length(x)))}}) AS ranked
      FROM src)""",
)
add(
    "k05_best_id", TITLES, lambda d: d.select("p_partkey", ids.best_id(ids.eans(c("t")), ids.skus(c("t"))).alias("id")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 6 THEN '4006381333931' WHEN p_partkey % 9 = 1 THEN regexp_extract(t, 'SKU(-\d+)', 1) ELSE '' END AS id FROM src""",
)
add(
    "f09_sku_missing", TITLES, lambda d: d.select("p_partkey", ids.sku_missing(c("k")).alias("missing")),
    "SELECT p_partkey, length(trim(coalesce(k, ''))) < 4 AS missing FROM src",
)
add(
    "f11_likely_sku", TITLES, lambda d: d.select("p_partkey", ids.is_likely_sku(F.coalesce(c("k"), F.lit(""))).alias("likely")),
    r"SELECT p_partkey, coalesce(k, '') ~ '^[A-Za-z0-9._\-/]{4,32}$' AND NOT k ~ '^[0-9]+$' AND k ~ '[A-Za-z0-9]' AND NOT k ~ '^[0-9]+\.[0-9]{2}$' AS likely FROM src",
)
add(
    "x21_tokenize", TITLES, lambda d: d.select("p_partkey", F.array_join(text.tokenize(c("t")), " ").alias("tokens")),
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(coalesce(t, '')), '[_.,;:/\\()|\[\]{}"“”’''!?+\-*@#%^&=]+', ' ', 'g'), '\s+', ' ', 'g')) AS tokens FROM src""",
)
add(
    "x24_selector_tokens", "SELECT p_partkey, 'div.' || replace(p_name, ' ', '-') || ' > a#' || p_brand || '[href=\"x\"]' AS s FROM {part}",
    lambda d: d.select("p_partkey", F.array_join(text.selector_tokens(c("s")), " ").alias("tokens")),
    "SELECT p_partkey, trim(regexp_replace(lower(s), '[^a-z0-9_-]+', ' ', 'g')) AS tokens FROM src",
)
add(
    "x25_clean_title", TITLES, lambda d: d.select("p_partkey", text.clean_title(c("t")).alias("title")),
    rf"""SELECT p_partkey, trim(substr(trim(regexp_replace(regexp_replace(regexp_replace({clean('t')}, '(?i)\b(add to cart|in den warenkorb|jetzt kaufen|buy now)\b', '', 'g'),
      '(?i)\b(home|start|audio|video|strom|multimedia|b-run|solar)\b', ' ', 'g'), '\s+', ' ', 'g')), 1, 140)) AS title FROM src""",
)
add(
    "x26_near_text", "SELECT doc_id, text FROM {documents}", lambda d: d.select("doc_id", text.near_text(c("text")).alias("near")),
    f"SELECT doc_id, substr({clean('text')}, 1, 160) AS near FROM src",
)
SRCSETS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a' || CAST(p_partkey AS STRING) || '.jpg 320w, /b.jpg 640w,/c.jpg 640w'
  WHEN 1 THEN 'https://x.example/d.webp 2x' WHEN 2 THEN '' ELSE '/s.jpg 100w, https://x.example/' || CAST(p_partkey AS STRING) || '.png 50w' END AS s FROM {part}"""
add(
    "x27_srcset", SRCSETS,
    lambda d: d.select("p_partkey", F.array_join(images.srcset_urls(c("s")), " ").alias("urls"), F.coalesce(images.widest(c("s")), F.lit("")).alias("widest")),
    r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a' || p_partkey || '.jpg /b.jpg /c.jpg' WHEN 1 THEN 'https://x.example/d.webp' WHEN 2 THEN ''
      ELSE '/s.jpg https://x.example/' || p_partkey || '.png' END AS urls,
      CASE p_partkey % 4 WHEN 0 THEN '/c.jpg' WHEN 1 THEN 'https://x.example/d.webp' WHEN 2 THEN '' ELSE '/s.jpg' END AS widest FROM src""",
)
QUERIES["w05_srcset_widest"] = lambda spark, d: view(spark, d, SRCSETS).select("p_partkey", images.widest(c("s")).alias("url"))
SQL["w05_srcset_widest"] = f"""WITH src AS ({duck(SRCSETS)}), e AS (SELECT p_partkey, unnest(string_split(s, ',')) AS x, unnest(range(len(string_split(s, ',')))) AS i FROM src),
  w AS (SELECT p_partkey, i, regexp_extract(trim(x), '^\\S+') AS u, coalesce(TRY_CAST(regexp_extract(x, '\\s(\\d+)w', 1) AS INT), 0) AS n FROM e WHERE trim(x) <> '')
  SELECT src.p_partkey, (SELECT u FROM w WHERE w.p_partkey = src.p_partkey ORDER BY n DESC, i DESC LIMIT 1) AS url FROM src"""
CANDIDATES = """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/img/placeholder.png' ELSE '' END AS a,
  CASE WHEN p_partkey % 4 = 0 THEN '/x' || CAST(p_partkey AS STRING) || '.webp' ELSE '' END AS b,
  CASE WHEN p_partkey % 5 = 0 THEN '/y.jpeg?v=1' ELSE CAST(NULL AS STRING) END AS k FROM {part}"""
add(
    "x28_best_image", CANDIDATES, lambda d: d.select("p_partkey", images.best_image(F.array("a", "b", "k")).alias("img")),
    r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '/y.jpeg?v=1' WHEN p_partkey % 4 = 0 THEN '/x' || p_partkey || '.jpg'
      WHEN p_partkey % 3 = 0 THEN '/img/placeholder.png' ELSE '' END AS img FROM src""",
)
add(
    "f12_placeholder_image", CANDIDATES, lambda d: d.select("p_partkey", c("a").rlike(images.PLACEHOLDER).alias("weak")),
    "SELECT p_partkey, contains(a, 'placeholder') AS weak FROM src",
)
add(
    "x29_image_extension", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'JPG' WHEN 1 THEN ' webp' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' WHEN 4 THEN 'bmp' ELSE CAST(NULL AS STRING) END AS x FROM {part}",
    lambda d: d.select("p_partkey", images.image_extension(c("x")).alias("kind")),
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'png' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' ELSE 'jpeg' END AS kind FROM src",
)
add(
    "x42_data_url", "SELECT p_partkey, p_name FROM {part}",
    lambda d: d.select("p_partkey", images.data_url(c("p_name").cast("binary"), F.lit("png")).alias("url")),
    "SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name)) AS url FROM src",
)
add(
    "g22_image_links", "SELECT p_partkey, '<img src=\"https://x.example/a' || CAST(p_partkey AS STRING) || '.jpg\"><a href=\"https://x.example/b.PNG?x\">https://x.example/b.PNG' AS html FROM {part}",
    lambda d: d.select("p_partkey", F.array_join(images.image_links(c("html")), " ").alias("links")),
    "SELECT p_partkey, 'https://x.example/a' || p_partkey || '.jpg https://x.example/b.PNG' AS links FROM src",
)
add(
    "x30_pick_first", TITLES, lambda d: d.select("p_partkey", text.pick_first(c("k"), c("t"), c("u")).alias("first")),
    "SELECT p_partkey, coalesce(nullif(k, ''), nullif(t, ''), nullif(u, ''), '') AS first FROM src",
)
add(
    "x32_derive_sku", TITLES, lambda d: d.select("p_partkey", ids.derive_sku(c("k"), c("u"), c("t")).alias("sku")),
    r"""SELECT p_partkey, CASE WHEN b ~ '\d' THEN b ELSE coalesce(nullif(w, ''), b) END AS sku FROM (
      SELECT p_partkey, w, CASE WHEN a ~ '\d' THEN a ELSE coalesce(nullif(l, ''), a) END AS b FROM (
        SELECT p_partkey, w, coalesce(nullif(k, ''), w) AS a,
          regexp_replace(coalesce(list_filter(string_split(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], ''), '(?i)\.(html?|php)$', '') AS l
        FROM (SELECT *, regexp_extract(trim(coalesce(t, '')), '^\S+') AS w FROM src)))""",
)
add(
    "x37_hashes", "SELECT p_partkey, p_name FROM {part}",
    lambda d: d.select("p_partkey", text.tagged_sha256(c("p_name")).alias("tagged"), F.substring(F.sha2("p_name", 256), 1, 12).alias("short_id")),
    "SELECT p_partkey, 'sha256:' || sha256(p_name) AS tagged, substr(sha256(p_name), 1, 12) AS short_id FROM src",
)
add(
    "x39_rolling_hash", "SELECT p_partkey, p_name FROM {part}", lambda d: d.select("p_partkey", text.rolling_hash(c("p_name")).alias("h")),
    "SELECT p_partkey, format('{:x}', list_reduce(list_transform(string_split(p_name, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda h, x: (h * 31 + x) % 4294967296, CAST(0 AS BIGINT))) AS h FROM src",
)
add(
    "x43_file_stamps", "SELECT event_id, ts, 'www.Shop_' || CAST(user_id AS STRING) || '.example:80' AS host FROM {events}",
    lambda d: d.select("event_id", F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.regexp_replace("host", "[^A-Za-z0-9.-]", "_")).alias("file")),
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || regexp_replace(host, '[^A-Za-z0-9.-]', '_', 'g') AS file FROM src",
)
add(
    "x36_clamp", "SELECT p_partkey, p_retailprice / 1000 - 0.5 AS x FROM {part}",
    lambda d: d.select("p_partkey", F.least(F.greatest("x", F.lit(0.0)), F.lit(1.0)).alias("clamped")),
    "SELECT p_partkey, least(greatest(x, 0.0::DOUBLE), 1.0::DOUBLE) AS clamped FROM src",
)
HREFS = """SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN '/a/b' WHEN 1 THEN '//cdn.example/x.js' WHEN 2 THEN 'https://other.example/y?z#q'
  WHEN 3 THEN '?page=2' WHEN 4 THEN '#frag' WHEN 5 THEN 'rel.html' ELSE '' END AS href FROM {pages}"""
add(
    "x02_absolutize", HREFS, lambda d: d.select("page_id", urls.absolutize(c("href"), c("url")).alias("u")),
    r"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN o || '/a/b' WHEN 1 THEN regexp_extract(url, '^[a-z]+:') || '//cdn.example/x.js' WHEN 2 THEN href
      WHEN 3 THEN q || '?page=2' WHEN 4 THEN regexp_replace(url, '#.*$', '') || '#frag'
      WHEN 5 THEN o || CASE WHEN p = '' THEN '/' ELSE regexp_replace(p, '[^/]*$', '') END || 'rel.html' ELSE regexp_replace(url, '#.*$', '') END AS u
    FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS o, regexp_replace(url, '[?#].*$', '') AS q, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM src)""",
)
add(
    "x03_strip_url", "SELECT page_id, url FROM {pages}",
    lambda d: d.select("page_id", urls.strip_query(c("url")).alias("plain"), urls.strip_fragment(c("url")).alias("no_fragment")),
    "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS plain, split_part(url, '#', 1) AS no_fragment FROM src",
)
add(
    "x48_page_number", TITLES, lambda d: d.select("p_partkey", urls.page_number(c("u")).alias("n")),
    r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN CAST(p_partkey % 40 AS INT) WHEN 6 THEN CAST(p_partkey % 30 AS INT) END AS n FROM src""",
)
add(
    "c07_deep_catalog", TITLES, lambda d: d.select("p_partkey", urls.is_deep_catalog(c("u")).alias("deep")),
    "SELECT p_partkey, p_partkey % 7 = 1 AS deep FROM src",
)
add(
    "x47_strip_markup", "SELECT page_id, html FROM {pages}", lambda d: d.select("page_id", F.sha2(text.strip_markup(c("html")), 256).alias("h")),
    r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
      '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'))) AS h FROM src""",
)
add(
    "g19_scrape", "SELECT page_id, html FROM {pages}",
    lambda d: d.select(
        "page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), lambda h: text.strip_markup(h)), "|").alias("h1"),
        F.length(text.strip_markup(c("html"))).alias("text_length"), F.substring(text.strip_markup(c("html")), 1, text.PREVIEW_LIMIT).alias("preview"),
    ),
    r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '[\s\x{00A0}]+', ' ', 'g')) AS h1,
      length(t) AS text_length, substr(t, 1, 600) AS preview FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
      '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM src)""",
)
