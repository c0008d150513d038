"""Queries of readers and export projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import relational as r
from tablewright.plans.base import duck, table, view
from tablewright.plans.relational_queries import CTE, ITEMS
from tablewright.sources import exports, inputs

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, build, sql: str) -> None:
    QUERIES[name], SQL[name] = build, sql


add("s01_page_scan", lambda s, d: inputs.page_scan(table(s, d, "pages")).select("page_id", "url", "n"), "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n FROM pages")
LINES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  https://x.example/' || CAST(p_partkey AS STRING) || ' ' WHEN 1 THEN '# note' WHEN 2 THEN '   ' ELSE 'u' END AS value FROM {part}"
add(
    "s09_seeds", lambda s, d: inputs.seeds(view(s, d, LINES)),
    f"SELECT trim(value) AS url FROM ({duck(LINES)}) WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%'",
)
BODIES = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[{"a":"' || CAST(p_partkey AS STRING) || '"},{"a":"y"}]' WHEN 1 THEN '{"products":[{"a":"p"}]}' WHEN 2 THEN '{"list":[{"a":"l"}],"data":[{"a":"d"}]}' ELSE '{"x":1}' END AS body FROM {part}"""
add(
    "s13_body_rows", lambda s, d: inputs.body_rows(view(s, d, BODIES)).select("p_partkey", "pos", c("row")["a"].alias("a")),
    """SELECT p_partkey, CAST(n AS INTEGER) AS pos, CASE p_partkey % 4 WHEN 0 THEN [CAST(p_partkey AS VARCHAR), 'y'][n + 1] WHEN 1 THEN 'p' ELSE 'd' END AS a
      FROM part, range(2) t(n) WHERE p_partkey % 4 = 0 OR (p_partkey % 4 < 3 AND n = 0)""",
)
add(
    "s06_first_html", lambda s, d: inputs.first_html(table(s, d, "pages").filter("page_id % 3 != 0").select(c("page_id").alias("url"), F.when(c("page_id") % 3 == 1, "").otherwise(c("url")).alias("html")), table(s, d, "pages").filter("page_id % 5 != 0").select(c("page_id").alias("url"), F.lit("basic").alias("html"))),
    "SELECT page_id AS url, CASE WHEN page_id % 3 = 2 THEN url WHEN page_id % 5 <> 0 THEN 'basic' ELSE '' END AS html FROM pages WHERE page_id % 3 <> 0 OR page_id % 5 <> 0",
)
add(
    "s04_charset", lambda s, d: table(s, d, "pages").select("page_id", inputs.charset(F.when(c("page_id") % 4 == 0, "UTF8"), F.when(c("page_id") % 4 == 1, "text/html; Charset=GB2312"), c("html").cast("binary")).alias("charset")),
    "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'gb18030' ELSE 'utf-8' END AS charset FROM pages",
)
add(
    "s14_day_metrics", lambda s, d: inputs.day_metric(table(s, d, "events"), "ts", "props", "k"),
    "SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY 1",
)
add(
    "s08_catalog_rows", lambda s, d: view(s, d, "SELECT p_partkey, to_json(named_struct('id', CAST(p_partkey AS STRING), 'name', p_name)) AS j FROM {part}").select("p_partkey", F.from_json("j", inputs.CATALOG_SCHEMA).alias("x")).select("p_partkey", "x.id", "x.name", F.coalesce("x.sku", F.lit("")).alias("sku")),
    "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, '' AS sku FROM part",
)


def items(s, d):
    return r.row_index(view(s, d, ITEMS).withColumn("moq", F.lit("")).withColumn("link", c("url")), ["pos"], ["page_id"])


add("o02_export_3", lambda s, d: exports.export_3(items(s, d)), CTE + "SELECT title, url AS link, img AS image FROM i")
add(
    "o03_export_7", lambda s, d: exports.export_7(items(s, d)),
    CTE + r"""SELECT CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS idx, sku AS item_no, img AS picture, coalesce(nullif("desc", ''), title) AS description, '' AS moq,
      TRY_CAST(nullif(price, '') AS DOUBLE) AS unit_price, url AS link FROM i""",
)
add(
    "o04_export_15", lambda s, d: exports.export_15(items(s, d).withColumn("imgs", F.array("img", F.lit("/2.jpg")))).select("sku", "title", "price", "url", "ean", "images"),
    CTE + "SELECT sku, title, price, url, ean, img || ' | /2.jpg' AS images FROM i",
)
add(
    "o01_payload", lambda s, d: exports.payloads(items(s, d), "page_id").select("page_id", "count", "ok", F.size(F.from_json("products", "array<map<string,string>>")).cast("long").alias("products")),
    CTE + "SELECT page_id, count(*) AS count, true AS ok, count(*) AS products FROM i GROUP BY page_id",
)
