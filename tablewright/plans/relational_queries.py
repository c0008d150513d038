"""Queries of joins, aggregates, windows, sorts and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import mining
from tablewright.operators import relational as r
from tablewright.plans.base import TITLES, duck, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col

ITEMS = """SELECT l_orderkey AS page_id, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey AS pos, 'https://shop.example/p/' || CAST(l_partkey % 50 AS STRING) ||
  CASE WHEN l_linenumber % 3 = 0 THEN '#top' ELSE '' END AS url, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'Item ' || CAST(l_partkey % 20 AS STRING) END AS title,
  CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(l_partkey % 1000 AS STRING) ELSE 'AX-' || CAST(l_partkey AS STRING) END AS sku,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE CAST(l_partkey AS STRING) || '.50' END AS price, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE '/i.jpg' END AS img, '' AS desc,
  CASE WHEN l_suppkey % 2 = 0 THEN '4006381333931' ELSE '' END AS ean FROM {lineitem}"""
DETAILS = """SELECT p_partkey AS pos, 'https://shop.example/p/' || CAST(p_partkey % 60 AS STRING) AS url, p_name AS title, 'D-' || CAST(p_partkey AS STRING) AS sku,
  CASE WHEN p_partkey % 2 = 0 THEN '9.99' ELSE '' END AS price, '/d.jpg' AS img, p_type AS desc FROM {part}"""
I, D = duck(ITEMS), duck(DETAILS)


def both(spark, d):
    return view(spark, d, ITEMS), view(spark, d, DETAILS)


def add(name: str, build, sql: str) -> None:
    QUERIES[name], SQL[name] = build, sql


CTE = f"WITH i AS ({I}), d AS ({D}), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)\n"
add(
    "j01_detail_enrich", lambda s, d: r.enrich(*both(s, d)).select("page_id", "pos", "url", "title", "sku", "price", "img", "desc"),
    CTE + r"""SELECT page_id, i.pos, i.url, coalesce(nullif(i.title, ''), f.title, '') AS title,
      CASE WHEN trim(i.sku) ~ '^\d{0,3}$' THEN coalesce(nullif(f.sku, ''), i.sku) ELSE i.sku END AS sku, coalesce(nullif(i.price, ''), f.price, '') AS price,
      coalesce(nullif(i.img, ''), f.img, '') AS img, coalesce(nullif(i.desc, ''), f.desc, '') AS desc FROM i LEFT JOIN f ON i.url = f.url""",
)
add(
    "j02_suspicious_skus",
    lambda s, d: r.enrich_suspicious(both(s, d)[0].withColumnRenamed("url", "link"), both(s, d)[1].withColumnRenamed("url", "link"), "page_id").select("page_id", "pos", "link", "sku", "title"),
    CTE + """, n AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM i WHERE length(trim(sku)) < 4),
      x AS (SELECT i.page_id, i.pos, i.url AS link, i.title, CASE WHEN n.k <= 20 THEN coalesce(nullif(f.sku, ''), i.sku) ELSE i.sku END AS sku
        FROM i LEFT JOIN n ON n.page_id = i.page_id AND n.pos = i.pos LEFT JOIN f ON f.url = i.url)
      SELECT page_id, min(pos) AS pos, link, arg_max(sku, pos) AS sku, arg_max(title, pos) AS title FROM x GROUP BY page_id, link""",
)
add(
    "j03_prefer_left",
    lambda s, d: r.prefer_left(r.keep_first(both(s, d)[0].withColumn("url", r.strip_fragment(c("url"))), ["url"], ["pos", "page_id"]), r.keep_first(both(s, d)[1], ["url"], ["pos"])),
    CTE + """, l AS (SELECT *, split_part(url, '#', 1) AS u FROM i QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY pos, page_id) = 1)
      SELECT coalesce(l.u, f.url) AS url, CASE WHEN l.u IS NULL THEN 1 ELSE 0 END AS side, coalesce(l.pos, f.pos) AS pos, coalesce(nullif(l.title, ''), f.title, '') AS title,
      coalesce(nullif(l.price, ''), f.price, '') AS price, coalesce(nullif(l.img, ''), f.img, '') AS img FROM l FULL JOIN f ON l.u = f.url""",
)
add(
    "j04_first_match", lambda s, d: both(s, d)[0].join(r.keep_first(both(s, d)[1], ["url"], ["pos"]).select("url", c("sku").alias("manifest_sku")), "url", "left").select("page_id", "pos", "manifest_sku"),
    CTE + "SELECT page_id, i.pos, f.sku AS manifest_sku FROM i LEFT JOIN f ON f.url = i.url",
)
add(
    "j09_semantic_aliases",
    lambda s, d: r.map_fields(
        view(s, d, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Preis' WHEN 1 THEN 'Artikelnummer' WHEN 2 THEN 'name' ELSE 'colour' END AS field FROM {part}"),
        s.createDataFrame([("price", ["price", "preis", "prix"]), ("sku", ["sku", "artikelnummer"]), ("title", ["title", "name"])], "canonical string, aliases array<string>"),
    ),
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Preis' WHEN 1 THEN 'Artikelnummer' WHEN 2 THEN 'name' ELSE 'colour' END AS field, CASE p_partkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'sku' WHEN 2 THEN 'title' ELSE 'colour' END AS canonical FROM part",
)
add(
    "j10_seen_and_unseen",
    lambda s, d: both(s, d)[0].join(both(s, d)[1], "url", "left_anti").select("page_id", "pos", F.lit("unseen").alias("kind")).unionByName(both(s, d)[0].join(both(s, d)[1], "url", "left_semi").select("page_id", "pos", F.lit("seen").alias("kind"))),
    CTE + "SELECT page_id, pos, CASE WHEN url IN (SELECT url FROM d) THEN 'seen' ELSE 'unseen' END AS kind FROM i",
)
add(
    "j12_overwrite", lambda s, d: r.overwrite(*both(s, d), "url", ("price",)).select("page_id", "pos", "price"),
    CTE + "SELECT page_id, i.pos, coalesce(nullif(f.price, ''), i.price) AS price FROM i LEFT JOIN f ON f.url = i.url",
)
add(
    "j11_sku_overwrite", lambda s, d: r.overwrite_sku(*both(s, d), "page_id", 3).select("page_id", "pos", "sku"),
    CTE + """, n AS (SELECT page_id, pos, url, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN trim(sku) = '' THEN 0 ELSE 1 END, pos) AS n FROM i WHERE url <> '')
    SELECT i.page_id, i.pos, coalesce(nullif(f.sku, ''), i.sku) AS sku FROM i LEFT JOIN n ON n.page_id = i.page_id AND n.pos = i.pos AND n.n <= 3 LEFT JOIN f ON f.url = n.url""",
)
add(
    "j11_candidate_choice", lambda s, d: r.row_index(both(s, d)[0].withColumn("strong", ~r.sku_missing(c("sku"))), ["strong", "pos"], ["page_id"], "k").filter("k <= 3").select("page_id", "pos", "k"),
    CTE + "SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY length(trim(sku)) >= 4, pos) AS INTEGER) AS k FROM i QUALIFY k <= 3",
)
add(
    "w01_row_index", lambda s, d: r.row_index(both(s, d)[0], ["pos"], ["page_id"]).select("page_id", "pos", "idx"),
    CTE + "SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS idx FROM i",
)
add(
    "w02_keep_first", lambda s, d: r.keep_first(both(s, d)[0], ["page_id", "url"], ["pos"]).select("page_id", "pos", "url"),
    CTE + "SELECT page_id, min(pos) AS pos, url FROM i GROUP BY page_id, url",
)
add(
    "w03_two_key_dedup", lambda s, d: r.two_key_dedup(both(s, d)[0], "page_id", "pos", c("url"), c("title")).select("page_id", "pos"), "",
)
SQL["w03_two_key_dedup"] = f"""WITH RECURSIVE i AS ({I}), b AS (SELECT page_id, pos, url AS u, lower(trim(title)) AS t FROM i WHERE title <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, u, t) AS k FROM b),
w AS (SELECT page_id, k, pos, [u] AS us, [t] AS ts, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, o.pos, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN us ELSE list_append(us, u) END,
    CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN ts ELSE list_append(ts, t) END, NOT (list_contains(us, u) OR list_contains(ts, t))
  FROM w JOIN o ON o.page_id = w.page_id AND o.k = w.k + 1)
SELECT page_id, pos FROM w WHERE kept"""
add(
    "w06_first_argmax", lambda s, d: both(s, d)[0].groupBy("page_id").agg(F.max_by("pos", F.struct(F.length("url"), -c("pos"))).alias("pos")),
    CTE + "SELECT page_id, pos FROM i QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(url) DESC, pos) = 1",
)
add(
    "k02_page_limit", lambda s, d: r.row_index(both(s, d)[0], ["pos"], ["page_id"]).filter("idx <= least(greatest(1, 2), 200)").select("page_id", "pos"),
    CTE + "SELECT page_id, pos FROM i QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2",
)
add(
    "k06_page_numbers", lambda s, d: view(s, d, TITLES).select(r_page(c("u")).alias("n")).filter("n IS NOT NULL").distinct().orderBy("n"),
    "SELECT DISTINCT CAST(CASE p_partkey % 7 WHEN 3 THEN p_partkey % 40 WHEN 6 THEN p_partkey % 30 END AS INTEGER) AS n FROM part WHERE p_partkey % 7 IN (3, 6) ORDER BY 1",
)
add(
    "k07_last_events", lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type"),
    "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
)
add(
    "u01_union_all", lambda s, d: both(s, d)[0].select("url", "title").unionByName(both(s, d)[1].select("url", "title")).groupBy("url", "title").count(),
    CTE + "SELECT url, title, count(*) AS count FROM (SELECT url, title FROM i UNION ALL SELECT url, title FROM d) GROUP BY ALL",
)
add(
    "u02_union_by_key", lambda s, d: r.keep_first(both(s, d)[0].select("url", F.lit(0).alias("side"), "pos", "title").unionByName(both(s, d)[1].select("url", F.lit(1).alias("side"), "pos", "title")), ["url"], ["side", "pos", "title"]),
    CTE + "SELECT url, side, pos, title FROM (SELECT url, 0 AS side, pos, title FROM i UNION ALL SELECT url, 1, pos, title FROM d) QUALIFY row_number() OVER (PARTITION BY url ORDER BY side, pos, title) = 1",
)
add(
    "u03_first_source", lambda s, d: r.first_nonempty([(both(s, d)[0].filter("price != ''").select("page_id", "pos"), 3), (both(s, d)[0].select("page_id", "pos"), 1)], "page_id").select("page_id", "pos", "priority"),
    CTE + """, a AS (SELECT page_id FROM i WHERE price <> '' GROUP BY page_id HAVING count(*) >= 3)
      SELECT page_id, pos, 0 AS priority FROM i WHERE price <> '' AND page_id IN (SELECT page_id FROM a) UNION ALL SELECT page_id, pos, 1 FROM i WHERE page_id NOT IN (SELECT page_id FROM a)""",
)
add(
    "u04_jaccard", lambda s, d: view(s, d, "SELECT p_partkey, split(p_name, ' ') AS a, split(lower(p_type) || ' red widget', ' ') AS b FROM {part}").select("p_partkey", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard")),
    "SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' red widget', ' ') AS b FROM part)",
)
add(
    "u08_except", lambda s, d: both(s, d)[0].select("url").distinct().exceptAll(both(s, d)[1].select("url").distinct()),
    CTE + "SELECT DISTINCT url FROM i WHERE url NOT IN (SELECT url FROM d)",
)
add(
    "a01_fill_rates", lambda s, d: r.fill_rates(both(s, d)[0], r.QUALITY_FIELDS),
    CTE + "SELECT " + ", ".join(f"count(*) FILTER (\"{f}\" <> '') / count(*) AS \"{f}\"" for f in r.QUALITY_FIELDS) + " FROM i",
)
add("a02_row_counts", lambda s, d: both(s, d)[0].groupBy("page_id").count(), CTE + "SELECT page_id, count(*) AS count FROM i GROUP BY page_id")
add(
    "a07_health", lambda s, d: r.health(table(s, d, "events").select(F.to_date("ts").alias("day"), (c("event_type") != "error").alias("fine")), "day", "fine"),
    "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS ok, count(*) AS total, round(count(*) FILTER (event_type <> 'error') / count(*), 3) AS ratio FROM events GROUP BY 1",
)
add(
    "j08_day_over_day", lambda s, d: r.degraded(r.health(table(s, d, "events").select(F.to_date("ts").alias("day"), (c("event_type") != "error").alias("fine")), "day", "fine"), most_drop=0.02).select("day", "ok", "total", "ratio", F.round("drop", 6).alias("drop"), "degraded"),
    """WITH h AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') AS ok, count(*) AS total, round(count(*) FILTER (event_type <> 'error') / count(*), 3) AS ratio
      FROM events GROUP BY 1)
      SELECT h.day, h.ok, h.total, h.ratio, round(b.ratio - h.ratio, 6) AS "drop", h.ok < 1 OR h.ratio < 0.6 OR coalesce(b.ratio - h.ratio, 0) > 0.02 AS degraded
      FROM h LEFT JOIN h b ON b.day = h.day - 1""",
)
QUERIES["t12_degraded_days"] = lambda s, d: QUERIES["j08_day_over_day"](s, d).filter("degraded").select("day")
SQL["t12_degraded_days"] = f"SELECT day FROM ({SQL['j08_day_over_day']}) WHERE degraded"
add(
    "a08_cluster_summary", lambda s, d: r.cluster_summary(both(s, d)[0].withColumn("cluster", F.substring("sku", 1, 2)), "cluster", "url", "pos").drop("first_url").join(both(s, d)[0].groupBy(F.substring("sku", 1, 2).alias("cluster")).agg(F.min("pos").alias("first_pos")), "cluster"),
    CTE + "SELECT substr(sku, 1, 2) AS cluster, count(*) AS size, min(pos) AS first_pos, sum(count(*)) OVER () AS total, count(*) / sum(count(*)) OVER () AS share FROM i GROUP BY 1",
)
add(
    "a12_distinct_sets", lambda s, d: both(s, d)[0].groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("img")), "|").alias("imgs"), F.count_distinct("url").alias("urls")),
    CTE + "SELECT page_id, string_agg(DISTINCT img, '|' ORDER BY img) AS imgs, count(DISTINCT url) AS urls FROM i GROUP BY page_id",
)
add(
    "a13_rule_quality", lambda s, d: r.rule_quality(table(s, d, "labels"), "quality", "toxic"),
    "SELECT quality, count(*) AS support, avg(toxic) AS precision, avg(toxic) / (SELECT avg(toxic) FROM labels) AS lift FROM labels GROUP BY quality",
)
RULE_PARTS = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "many": "l_quantity > 30", "cheap": "l_extendedprice < 20000", "discounted": "l_discount >= 0.05"}
add(
    "a13_candidate_rules",
    lambda s, d: mining.candidate_rules(table(s, d, "lineitem"), {k: F.expr(v) for k, v in RULE_PARTS.items()}, F.expr("l_tax > 0.04"), F.year("l_shipdate"), 500, 3).select(F.array_join("conditions", "&").alias("rule"), "support", "precision", "lift", "stability_score"),
    f"""WITH r AS (SELECT list_filter([{", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in sorted(RULE_PARTS.items()))}], lambda x: x IS NOT NULL) AS c, CAST(l_tax > 0.04 AS INTEGER) AS h, year(l_shipdate) AS f FROM lineitem),
    one AS (SELECT row_number() OVER () AS i, * FROM r), x AS (SELECT i, h, f, unnest(c) AS c FROM one),
    s AS (SELECT c AS rule, h, f FROM x UNION ALL SELECT a.c || '&' || b.c, a.h, a.f FROM x a JOIN x b ON a.i = b.i AND a.c < b.c
      UNION ALL SELECT a.c || '&' || b.c || '&' || e.c, a.h, a.f FROM x a JOIN x b ON a.i = b.i AND a.c < b.c JOIN x e ON e.i = b.i AND b.c < e.c),
    g AS (SELECT rule, f, count(*) AS n, avg(h) AS p FROM s GROUP BY rule, f), t AS (SELECT rule, count(*) AS support, avg(h) AS precision FROM s GROUP BY rule HAVING count(*) >= 500)
    SELECT rule, support, precision, precision / (SELECT avg(h) FROM r) AS lift, 1 - sum(n * abs(p - precision)) / support AS stability_score FROM t JOIN g USING (rule) GROUP BY rule, support, precision""",
)
add(
    "a14_rollup", lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(c("l_quantity").cast("long")).alias("quantity"), F.grouping_id().cast("int").alias("level")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
add(
    "f14_need_detail", lambda s, d: r.need_detail(both(s, d)[0], "page_id"),
    CTE + "SELECT page_id, bool_or((sku = '' AND ean = '') OR (price = '' AND img = '')) AS need_detail, avg(CASE WHEN sku = '' THEN 1 ELSE 0 END) >= 0.5 AS should_fetch FROM i GROUP BY page_id",
)
add(
    "x31_product_row", lambda s, d: both(s, d)[0].select("page_id", "pos", *r.product_row(sku=c("sku"), title=c("title"), img=c("img"), price=c("price"), url=c("url"), link=c("url"))),
    CTE + "SELECT page_id, pos, sku, title, img, '' AS desc, '' AS moq, price, url, url AS link FROM i",
)


def r_page(u):
    from tablewright.functions.urls import page_number

    return page_number(u)
