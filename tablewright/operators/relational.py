"""Deduplication, enrichment, quality figures and set operations on product rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.functions.ids import is_check_number, sku_missing
from tablewright.functions.text import blank, pick_first
from tablewright.functions.urls import strip_fragment
from tablewright.session import written

PRODUCT_FIELDS = ["sku", "title", "img", "desc", "moq", "price", "url", "link"]
QUALITY_FIELDS = ["title", "url", "img", "price", "sku", "desc"]


def row_index(df: DataFrame, order: list[Column | str], within: list[str], name: str = "idx") -> DataFrame:
    """Row numbers from 1 in the given order within each group; a global number needs an empty `within`."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*order)))


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """df.select(*columns), each worked out once per row: later filters on a column do not repeat its expression below."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return df.select(F.inline(F.array(F.struct(*named))))


def keep_first(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


#: Pages of up to so many different rows are walked in one pass; beyond, they are settled in rounds.
PAGE_ROWS = 100_000


def _walked(limit: int):
    """Rows sorted by page and place to those that are kept; it holds the urls and titles of at most `limit` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, begun, urls, titles = None, False, set(), set()
        for batch in batches:
            kept = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_p", "_u", "_t")]
            for i, (p, u, t) in enumerate(zip(*columns, strict=True)):
                if not begun or p != page:
                    page, begun, urls, titles = p, True, set(), set()
                if len(urls) < limit and u not in urls and t not in titles:
                    urls.add(u)
                    titles.add(t)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def _rounds(left: DataFrame, limit: int) -> list[DataFrame]:
    """The kept rows of large pages, a table a round: rows spread by url and by title, and every round settles the first open row of each page."""
    kept: list[DataFrame] = []
    place = F.struct("_o", "_u", "_t")
    for _ in range(limit):
        by_url = left.groupBy("_p", "_u").agg(F.min(place).alias("_a"))
        by_title = left.groupBy("_p", "_t").agg(F.min(place).alias("_b"))
        marked = left.join(by_url, ["_p", "_u"]).join(by_title, ["_p", "_t"]).select("_p", "_o", "_u", "_t", ((F.col("_a") == place) & (F.col("_b") == place)).alias("_keep"))
        marked = written(marked, "two-key")
        fresh = marked.filter("_keep").drop("_keep")
        if fresh.isEmpty():
            break
        kept.append(fresh)
        left = marked.filter("NOT _keep").drop("_keep").join(fresh.select("_p", "_u"), ["_p", "_u"], "left_anti").join(fresh.select("_p", "_t"), ["_p", "_t"], "left_anti")
    return kept


def two_key_dedup(df: DataFrame, page: str, pos: str, url: Column, title: Column, limit: int = 200, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Walk each page's rows in order; a row goes if its url, or its lower-case title, was kept before; at most `limit` of a page stay.

    Rows without page, position, url or title go. Rows at one position are ordered by url and title; rows that repeat all of these are one.
    Pages of up to page_rows different rows are walked in one sorted pass. Larger ones are not gathered in one task: a row that is the first of its url and
    of its title is kept, and what shares one of them with it goes; this repeats on the rest, `limit` times at most. Both ways keep the same rows.
    """
    named = df.withColumns({"_p": F.col(page), "_o": F.col(pos), "_u": url, "_t": F.lower(F.trim(title))})
    named = named.filter((F.coalesce("_u", F.lit("")) != "") & (F.coalesce("_t", F.lit("")) != "") & F.col("_p").isNotNull() & F.col("_o").isNotNull())
    left = written(named.groupBy("_p", "_u", "_t").agg(F.min("_o").alias("_o")).select("_p", "_o", "_u", "_t"), "two-key-rows")
    large = left.groupBy("_p").count().filter(F.col("count") > page_rows).select("_p")
    some = not large.isEmpty()
    small = left.join(large, "_p", "left_anti").select(left.columns) if some else left
    walked = small.repartition("_p").sortWithinPartitions("_p", "_o", "_u", "_t").mapInArrow(_walked(limit), small.schema)
    kept = [walked, *(_rounds(left.join(large, "_p", "left_semi").select(left.columns), limit) if some else [])]
    stay = reduce(DataFrame.unionByName, kept)
    if some:
        stay = row_index(stay, ["_o", "_u", "_t"], ["_p"], "_n").filter(F.col("_n") <= limit)
    return named.join(stay.select("_p", "_o", "_u", "_t"), ["_p", "_o", "_u", "_t"], "left_semi").select(*df.columns)


def enrich(items: DataFrame, details: DataFrame, key: str = "url", fields: tuple = ("title", "img", "price", "desc")) -> DataFrame:
    """Items with empty fields filled from the first detail row of their url.

    sku is replaced where it is blank or one to three digits; rows without a detail stay as they are.
    """
    first = keep_first(details, [key], ["pos"]).select(key, *[F.col(f).alias(f"_{f}") for f in ("sku", *fields)])
    joined = items.join(first, key, "left")
    weak = F.trim(F.coalesce("sku", F.lit(""))).rlike(r"^\d{0,3}$")
    filled = {f: pick_first(F.col(f), F.col(f"_{f}")) for f in fields}
    filled["sku"] = F.when(weak, pick_first(F.col("_sku"), F.col("sku"))).otherwise(F.col("sku"))
    return joined.withColumns(filled).drop(*[f"_{f}" for f in ("sku", *fields)])


def enrich_suspicious(items: DataFrame, details: DataFrame, page: str, limit: int = 20) -> DataFrame:
    """SKUs of the first `limit` suspicious rows of a page from their details; then one row for each link.

    Of rows with one link, the last one's values stay at the first one's position.
    """
    suspicious = items.filter(sku_missing(F.col("sku")))
    chosen = row_index(suspicious, ["pos"], [page], "_n").filter(F.col("_n") <= limit).select(page, "pos")
    first = keep_first(details, ["link"], ["pos"]).select("link", F.col("sku").alias("_sku"))
    found = chosen.join(items.select(page, "pos", "link"), [page, "pos"]).join(first, "link").select(page, "pos", "_sku")
    filled = items.join(found, [page, "pos"], "left").withColumn("sku", pick_first(F.col("_sku"), F.col("sku"))).drop("_sku")
    rest = [c for c in filled.columns if c not in (page, "link", "pos")]
    last = filled.groupBy(page, "link").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("_last"))
    return last.select(page, "pos", "link", *[F.col(f"_last.{c}").alias(c) for c in rest])


def prefer_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both lists by url without fragment: title, price and img from the right where the left's are empty."""
    a = left.select(strip_fragment(F.col("url")).alias("url"), F.col("pos").alias("l"), *[F.col(f).alias(f"l_{f}") for f in ("title", "price", "img")])
    b = right.select(strip_fragment(F.col("url")).alias("url"), F.col("pos").alias("r"), *[F.col(f).alias(f"r_{f}") for f in ("title", "price", "img")])
    merged = [pick_first(F.col(f"l_{f}"), F.col(f"r_{f}")).alias(f) for f in ("title", "price", "img")]
    return a.join(b, "url", "full_outer").select("url", F.col("l").isNull().cast("int").alias("side"), F.coalesce("l", "r").alias("pos"), *merged)


def overwrite(items: DataFrame, details: DataFrame, key: str, fields: tuple) -> DataFrame:
    """Fields from the detail row where it has them, else the item's own."""
    first = keep_first(details, [key], ["pos"]).select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    filled = {f: pick_first(F.col(f"_{f}"), F.col(f)) for f in fields}
    return items.join(first, key, "left").withColumns(filled).drop(*[f"_{f}" for f in fields])


def overwrite_sku(items: DataFrame, details: DataFrame, page: str, limit: int = 30) -> DataFrame:
    """items with the sku of their detail page, if that has one, for `limit` rows of each page: first those whose sku is missing or a check number, then the rest.

    Rows are taken in order of pos; those without a url are not looked up. details: url, pos, sku; the first row of a url counts.
    """
    bad = (F.trim(F.coalesce("sku", F.lit(""))) == "") | F.coalesce(is_check_number(F.trim(F.col("sku"))), F.lit(False))
    asked = items.filter(F.coalesce("url", F.lit("")) != "").select(page, "pos", "url", (~bad).cast("int").alias("_sound"))
    chosen = row_index(asked, ["_sound", "pos"], [page], "_n").filter(F.col("_n") <= limit)
    first = keep_first(details, ["url"], ["pos"]).filter(F.trim(F.coalesce("sku", F.lit(""))) != "").select("url", F.col("sku").alias("_sku"))
    found = chosen.join(first, "url").select(page, "pos", "_sku")
    return items.join(found, [page, "pos"], "left").withColumn("sku", F.coalesce("_sku", "sku")).drop("_sku").select(*items.columns)


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the share of rows with a value in each field; 0 for an empty table."""
    has = lambda f: F.avg(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0))
    return df.agg(*[F.coalesce(has(f), F.lit(0.0)).alias(f) for f in fields])


def need_detail(df: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """By group: whether a row lacks sku and ean, or price and img, and whether the share of missing skus reaches the threshold."""
    gone = lambda f: F.coalesce(F.trim(f), F.lit("")) == ""
    lacks = (gone("sku") & gone("ean")) | (gone("price") & gone("img"))
    return df.groupBy(group).agg(
        F.bool_or(lacks).alias("need_detail"), (F.avg(gone("sku").cast("double")) >= threshold).alias("should_fetch")
    )


def health(df: DataFrame, day: str, ok: str) -> DataFrame:
    """By day: ok, total and ratio (3 decimals)."""
    counted = df.groupBy(day).agg(F.count_if(F.col(ok)).alias("ok"), F.count("*").alias("total"))
    return counted.withColumn("ratio", F.round(F.col("ok") / F.col("total"), 3))


def degraded(days: DataFrame, day: str = "day", least_ok: int = 1, least_ratio: float = 0.6, most_drop: float = 0.1) -> DataFrame:
    """Each day's drop against the day before (not the last day seen), and whether it is degraded."""
    before = days.select(F.date_add(day, 1).alias(day), F.col("ratio").alias("last_ratio"))
    joined = days.join(before, day, "left").withColumn("drop", F.col("last_ratio") - F.col("ratio"))
    bad = (F.col("ok") < least_ok) | (F.col("ratio") < least_ratio) | (F.coalesce("drop", F.lit(0.0)) > most_drop)
    return joined.withColumn("degraded", bad)


def cluster_summary(df: DataFrame, cluster: str, url: str, pos: str) -> DataFrame:
    """By cluster: size, first url, share of all rows."""
    sized = df.groupBy(cluster).agg(F.count("*").alias("size"), F.min_by(url, pos).alias("first_url"))
    total = sized.agg(F.sum("size").alias("total"))
    return sized.crossJoin(F.broadcast(total)).withColumn("share", F.col("size") / F.col("total"))


def first_nonempty(parts: list[tuple[DataFrame, int]], page: str) -> DataFrame:
    """Of several row sources in order of preference, each page's first one with enough rows.

    parts: (rows, fewest rows a page must have). The result has column priority. Each source is read once: rows are dealt by page,
    and both windows use that.
    """
    out = None
    for priority, (rows, least) in enumerate(parts):
        named = rows.withColumns({"priority": F.lit(priority), "_least": F.lit(least)})
        out = named if out is None else out.unionByName(named)
    by_page = out.repartition(page).withColumn("_n", F.count("*").over(W.partitionBy(page, "priority"))).filter("_n >= _least")
    return by_page.withColumn("_best", F.min("priority").over(W.partitionBy(page))).filter("priority = _best").drop("_n", "_least", "_best")


def map_fields(df: DataFrame, aliases: DataFrame, field: str = "field") -> DataFrame:
    """Canonical names of source fields by an alias dimension (canonical, aliases array); unknown fields keep theirs."""
    known = aliases.select("canonical", F.explode("aliases").alias("_alias")).select("canonical", F.lower("_alias").alias("_alias"))
    return df.join(known, F.lower(F.col(field)) == F.col("_alias"), "left").withColumn("canonical", F.coalesce("canonical", field)).drop("_alias")


def product_row(**fields: Column) -> list[Column]:
    """The eight columns of the public product table; what is missing is ''."""
    return [F.coalesce(blank(fields[f].cast("string")) if f in fields else F.lit(None), F.lit("")).alias(f) for f in PRODUCT_FIELDS]


def status_ok(status: Column) -> Column:
    """A status from 200 to 399."""
    return (status >= 200) & (status < 400)


def required_fields(df: DataFrame, url: str, *any_of: str) -> DataFrame:
    """Rows with a url and at least one of the other columns."""
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    other = F.lit(False)
    for name in any_of:
        other = other | filled(name)
    return df.filter(filled(url) & other)


def at_most(df: DataFrame, n: int) -> DataFrame:
    """Any n rows, or all if there are fewer; no more partitions are read than that takes."""
    return df.limit(n)


def cluster_report(df: DataFrame, cluster: str) -> DataFrame:
    """j: a JSON object of label and size for each cluster."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.select(F.to_json(F.struct(F.col(cluster).alias("label"), "n")).alias("j"))


def rule_quality(df: DataFrame, rule: str, hit: str) -> DataFrame:
    """By rule: support (rows), precision (share of hits) and lift (precision by the share of hits in all rows)."""
    by_rule = df.groupBy(rule).agg(F.count("*").alias("support"), F.avg(F.col(hit).cast("double")).alias("precision"))
    # One row.
    base = df.agg(F.avg(F.col(hit).cast("double")).alias("_base"))
    return by_rule.join(F.broadcast(base), how="cross").withColumn("lift", F.col("precision") / F.col("_base")).drop("_base")
