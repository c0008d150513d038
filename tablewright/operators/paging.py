"""Pagination: walking next links, and page urls made from numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes
from tablewright.functions.urls import absolutize, page_number
from tablewright.operators import twig
from tablewright.session import shared_dir, written

# Pagers, the marks of their current page, and what a link to the next page says at its end.
PAGERS = [".pagination", ".pager", ".page", ".paging", ".nav-pages", "nav[aria-label*=Pagination i]", 'ul[role="presentation"]']
CURRENT = ".pagination .active a, .pagination li.active a, .pager .active a, .page .active a, .paging .active a"
NEXT_TEXT = r"(?iu)(next|weiter|nächste|nächster|more|次へ|下一页|下一頁|下ー步|后页|»|›|»»|››)\z"
PAGE_KEYS = ("page", "p")


def walk(starts: DataFrame, links: DataFrame, max_pages: int = 50) -> DataFrame:
    """start, depth, page: from each start along next links, until a page comes again, there is none, or max_pages.

    starts: page; links: page, next (one row a page). Each step is a join of all walks at once.
    """
    shared_dir(starts.sparkSession)
    at = starts.select(F.col("page").alias("start"), F.lit(1).alias("depth"), F.col("page"), F.array("page").alias("seen"))
    out = at
    for depth in range(2, max_pages + 1):
        moved = at.join(links.select("page", "next"), "page").filter("next IS NOT NULL AND NOT array_contains(seen, next)")
        at = moved.select("start", F.lit(depth).alias("depth"), F.col("next").alias("page"), F.array_append("seen", F.col("next")).alias("seen")).checkpoint()
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.drop("seen")


def next_link(html: Column) -> Column:
    """href of the link marked rel=next; '' if there is none."""
    h = F.coalesce(html, F.lit(""))
    after = F.regexp_extract(h, r"""(?i)<(?:a|link)\b[^>]*\brel=["']?next["']?[^>]*\bhref=["']([^"']+)""", 1)
    before = F.regexp_extract(h, r"""(?i)<(?:a|link)\b[^>]*\bhref=["']([^"']+)["'][^>]*\brel=["']?next""", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")), F.lit(""))


def next_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, next_url, rung: each page's next one by the first rung that names it, '' and 0 if none does.

    1: a link marked rel=next. 2: the first link in a pager whose text ends as such links do. 3: the link in a pager whose number follows that of the marked page.
    4: the url's own page or p parameter, one higher. pages has page_id, url and html. A page's nodes are read in one pass for the first three rungs.
    """
    # Of each rung the first link decides, also if it leads nowhere.
    text, href = F.trim(F.coalesce("text", F.lit(""))), F.coalesce(F.col("attrs")["href"], F.lit(""))
    inside = ", ".join(f"{p} a" for p in PAGERS)
    digits = lambda c: F.regexp_extract(c, r"^\s*([0-9]{1,9})", 1).try_cast("int")
    nodes = html_nodes(pages).filter("tag = 'a' OR attrs['class'] IS NOT NULL OR attrs['aria-label'] IS NOT NULL OR attrs['role'] IS NOT NULL")
    roles = {"page": {"rel": ["a[rel=next]"], "said": [inside], "current": [CURRENT]}}
    values = {"rel": href, "said": F.when(text.rlike(NEXT_TEXT), href), "current": text}
    found = twig.fields(nodes, {"page": None}, roles, values, in_order=True)
    found = written(found.select("page_id", *[F.coalesce(F.col("found")[r], F.lit("")).alias(r) for r in roles["page"]]), "pager-fields")
    # Only pages that the third rung decides look at the numbers in their pagers.
    asked = found.filter("rel = '' AND said = ''").select("page_id", (digits(F.col("current")) + 1).alias("wanted")).filter("wanted > 1")
    some = html_nodes(pages.join(asked, "page_id", "left_semi"))
    listed = twig.find(some, {"pager": inside}).select("page_id", "node")
    links = some.filter("tag = 'a'").select("page_id", "node", digits(text).alias("n"), href.alias("href"))
    numbered = links.join(listed, ["page_id", "node"]).join(asked, "page_id").filter("n = wanted").groupBy("page_id").agg(F.min_by("href", "node").alias("numbered"))
    known = pages.select("page_id", "url").join(found, "page_id", "left").join(numbered, "page_id", "left")
    url = F.coalesce("url", F.lit(""))
    by_key = [F.regexp_extract(url, rf"[?&]{k}=0*([1-9][0-9]{{0,8}})", 1).alias(k) for k in PAGE_KEYS]
    known = known.select("page_id", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("rel", "said", "numbered")], *by_key)
    guess = F.lit("")
    for k in reversed(PAGE_KEYS):
        raised = F.concat(F.regexp_extract(url, rf"^(.*?[?&]{k}=)[0-9]", 1), (F.col(k).cast("int") + 1).cast("string"), F.regexp_extract(url, rf"^.*?[?&]{k}=[0-9]+(.*)$", 1))
        guess = F.when(F.col(k) != "", raised).otherwise(guess)
    rung = F.when(F.col("rel") != "", 1).when(F.col("said") != "", 2).when(F.col("numbered") != "", 3).when(guess != "", 4).otherwise(0)
    link = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("rel", "said", "numbered")])
    return known.select("page_id", "url", F.when(rung == 0, "").when(rung == 4, guess).otherwise(absolutize(link, F.col("url"))).alias("next_url"), rung.alias("rung"))


def page_walk(pages: DataFrame, starts: DataFrame, max_pages: int = 50) -> DataFrame:
    """start, depth, page: from each start url (page) along the pages' own next links. Each page is read once, however many starts lead to it."""
    links = written(next_pages(pages).select(F.col("url").alias("page"), F.nullif("next_url", F.lit("")).alias("next")).filter("next IS NOT NULL").distinct(), "next-links")
    return walk(starts, links, max_pages)


def next_page_url(url: Column) -> Column:
    """The url with its page number one higher; with ?page=2 added where it has none."""
    n = (page_number(url) + 1).cast("string")
    by_query = F.concat(F.regexp_extract(url, r"(?i)^(.*[?&](?:page|p|seite)=)\d+", 1), n, F.regexp_extract(url, r"(?i)[?&](?:page|p|seite)=\d+(.*)$", 1))
    by_path = F.concat(F.regexp_extract(url, r"(?i)^(.*/page/)\d+", 1), n, F.regexp_extract(url, r"(?i)/page/\d+(.*)$", 1))
    bare = F.concat(url, F.when(F.contains(url, F.lit("?")), "&page=2").otherwise("?page=2"))
    return F.when(url.rlike(r"(?i)[?&](page|p|seite)=\d+"), by_query).when(url.rlike(r"(?i)/page/\d+"), by_path).otherwise(bare)


def candidate_pages(df: DataFrame, url: str, group: str, most: int = 20) -> DataFrame:
    """group, n, url: page urls 2 to the highest number that the group's urls name, `most` at the most."""
    top = df.groupBy(group).agg(F.max(page_number(F.col(url))).alias("top"), F.min(F.regexp_replace(F.col(url), r"[?#].*$", "")).alias("base"))
    numbers = top.filter("top >= 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.least("top", F.lit(most)))))
    return numbers.select(group, "n", F.concat("base", F.lit("?page="), F.col("n").cast("string")).alias("url"))


def path_pages(url: Column, last: int) -> Column:
    """Urls of pages 1 to last for paths like /list_3.html."""
    return F.transform(F.sequence(F.lit(1), F.lit(last)), lambda n: F.regexp_replace(url, F.lit(r"(\d+)_(\d+)\.html"), F.concat(F.lit("$1_"), n.cast("string"), F.lit(".html"))))
