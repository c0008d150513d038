"""Fallback readers of list pages, detail tests and previews, as joins on the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes, selects
from tablewright.functions.ids import sku_from_title
from tablewright.functions.text import clean_text, pick_first
from tablewright.functions.urls import absolutize
from tablewright.operators import classify, extract, relational, twig
from tablewright.operators.extract import got
from tablewright.session import written

# Selectors and patterns, in order of preference.
CONTAINERS = ["#productlist", ".productlist", ".listBox", ".products", ".product-list", "main", "body"]
ITEMS = ["#productlist ul > li", "ul.products > li", "ul > li", ".product", ".product-item", ".productItem", ".product-box", "li"]
CARDS = "div[class*=product], li[class*=product], article[class*=product], .product-item, .product-card, .prod-item, .good, .goods, .item"
CARD_BAD_LINK = r"(?i)(add-to-cart|wishlist|compare|login|register|cart|filter|sort)"
CARD_PRICES = ".price, .product-price, .amount, .money, .m-price, .price--default, .price__value"
CARD_SKUS = ".sku, .product-sku, .model, .product-model"
MONEY = r"(?i)\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})\s*(?:€|EUR)"
HEADINGS = "h1, h2, h3, h4, h5, h6"
BUY_TEXT = r"(?i)in den warenkorb|add to cart"
COLUMNS = ["page_id", "pos", "sku", "title", "url", "img", "price"]


def _have(value: Column) -> Column:
    """A value for a role: '' where the node has none, so that the first node decides."""
    return F.coalesce(value, F.lit(""))


def _attr(name: str) -> Column:
    return F.nullif(F.col("attrs")[name], F.lit(""))


def _picture() -> Column:
    """Of an image node: its lazy sources, the first absolute one of its srcset, its source; without a query."""
    listed = F.get(F.filter(F.split(F.coalesce(F.col("attrs")["srcset"], F.lit("")), " "), lambda x: x.rlike("(?i)^https?:")), F.lit(0))
    return F.regexp_replace(F.coalesce(_attr("data-src"), _attr("data-original"), listed, _attr("src"), F.lit("")), r"\?.*$", "")


def _link(href: Column, page: Column) -> Column:
    return F.when(href == "", "").otherwise(pick_first(absolutize(href, page), href))


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of each page, numbered from 1."""
    return relational.row_index(rows, ["top"], ["page_id"], "pos").filter(F.col("pos") <= limit)


def legacy_items(pages: DataFrame, limit: int = 50, nodes: DataFrame | None = None) -> DataFrame:
    """page_id, pos, sku, title, url, img, price: the items of the first list that one of ITEMS finds.

    The list is sought in the page's first container, else on the whole page. sku and title are an item's image text,
    heading, link text or text; an item without any of title, image and link is none.
    """
    nodes = written(html_nodes(pages), "legacy-nodes") if nodes is None else nodes
    rank = extract._rank(CONTAINERS)
    boxes = nodes.filter(rank.isNotNull()).groupBy("page_id").agg(F.min_by(F.struct("node", "last"), F.struct(rank, F.col("node"))).alias("c"))
    found = twig.find(nodes, {str(i): s for i, s in enumerate(ITEMS)}).join(boxes, "page_id", "left").select(
        "page_id", F.col("name").cast("int").alias("kind"), F.col("node").alias("top"),
        F.coalesce((F.col("node") > F.col("c.node")) & (F.col("node") <= F.col("c.last")), F.lit(True)).alias("within"),
    )
    first = found.groupBy("page_id").agg(F.min("kind").alias("kind"))
    some = found.join(first, ["page_id", "kind"])
    boxed = some.groupBy("page_id").agg(F.bool_or("within").alias("boxed"))
    items = some.join(boxed, "page_id").filter(F.col("within") | ~F.col("boxed") | (F.col("kind") == 0)).select("page_id", "top")
    texts = nodes.select("page_id", F.col("node").alias("top"), F.col("text").alias("whole"))
    pictures = {a.replace("-", "_"): [f"img[{a}]"] for a in ("src", "data-src", "data-original")}
    roles = {"href": ["a[href]"], "link_text": ["a[href]"], "alt": ["img"], "heading": [HEADINGS], **pictures}
    values = {"href": _have(F.col("attrs")["href"]), "link_text": _have(F.col("text")), "alt": _have(F.trim(F.col("attrs")["alt"])), "heading": _have(F.col("text")), **{r: _have(F.col("attrs")[r.replace("_", "-")]) for r in pictures}}
    # Any selector's items are read; those of the chosen list are kept.
    read = twig.fields(nodes, {"item": ", ".join(ITEMS)}, {"item": roles}, values, whole=False).select("page_id", F.col("root").alias("top"), *[got(r) for r in roles])
    rows = items.join(read, ["page_id", "top"]).join(texts, ["page_id", "top"]).join(pages.select("page_id", F.col("url").alias("page")), "page_id")
    title = clean_text(pick_first(F.col("alt"), F.col("heading"), F.col("link_text"), F.coalesce("whole", F.lit(""))))
    made = rows.select(
        "page_id", "top", title.alias("sku"), title.alias("title"), _link(F.col("href"), F.col("page")).alias("url"),
        _link(pick_first(F.col("src"), F.col("data_src"), F.col("data_original")), F.col("page")).alias("img"), F.lit("").alias("price"),
    )
    return _numbered(made.filter((F.col("title") != "") | (F.col("img") != "") | (F.col("url") != "")), limit).select(COLUMNS)


def _cards(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of cards that have a link and a title; top is the card's node."""
    good = selects("a[href]") & ~F.coalesce(F.col("attrs")["href"], F.lit("")).rlike(CARD_BAD_LINK)
    inner = {
        "href": [good], "link_title": [good], "link_text": [good], "heading": ["h1, h2, h3"], "alt": ["img"], "src": ["img"], "own_price": [CARD_PRICES], "own_sku": [CARD_SKUS],
    }
    text = _have(F.col("text"))
    values = {
        "href": _have(F.col("attrs")["href"]), "link_title": _have(F.trim(F.col("attrs")["title"])), "link_text": text, "heading": text, "alt": _have(F.trim(F.col("attrs")["alt"])),
        "src": _have(F.when(F.col("tag") == "img", _picture())), "own_price": text, "own_sku": text,
    }
    read = twig.fields(nodes, {"card": CARDS}, {"card": inner}, values, {"card": {"links": good}}, whole=False).filter(F.col("n")["links"] > 0)
    whole = nodes.select("page_id", F.col("node").alias("top"), F.col("text").alias("whole"))
    rows = read.select("page_id", F.col("root").alias("top"), *[got(r) for r in inner]).join(whole, ["page_id", "top"])
    title = pick_first(F.col("link_title"), F.col("heading"), F.col("link_text"), F.col("alt"))
    page = pages.select("page_id", F.col("url").alias("page"))
    return rows.join(page, "page_id").select(
        "page_id", "top", pick_first(F.col("own_sku"), sku_from_title(title)).alias("sku"), title.alias("title"), _link(F.col("href"), F.col("page")).alias("url"),
        _link(F.col("src"), F.col("page")).alias("img"), pick_first(F.col("own_price"), F.regexp_extract("whole", MONEY, 0)).alias("price"),
    ).filter("title != '' AND url != ''")


def _shop_list(nodes: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of li.product anywhere below ul.products, and the pages that have such nodes."""
    links = ["a.woocommerce-LoopProduct-link", "a[href]"]
    roles = {"href": links, "named": links, "link_text": links, "heading": [".woocommerce-loop-product__title"], "src": ["img"], "amount": [".amount"], "whole_price": [".price"]}
    text = _have(F.col("text"))
    values = {
        "href": _have(_attr("href")), "named": _have(F.trim(F.col("attrs")["title"])), "link_text": text, "heading": text, "src": _have(F.when(F.col("tag") == "img", _picture())), "amount": text, "whole_price": text,
    }
    read = written(twig.fields(nodes, {"card": "ul.products li.product"}, {"card": roles}, values, whole=False).select("page_id", F.col("root").alias("top"), *[got(r) for r in roles]), "ladder-list")
    title = F.coalesce(pick_first(F.col("heading"), F.col("named"), F.col("link_text")), F.lit(""))
    page = pages.select("page_id", F.col("url").alias("page"))
    made = read.join(page, "page_id").select(
        "page_id", "top", sku_from_title(title).alias("sku"), title.alias("title"), _link(F.col("href"), F.col("page")).alias("url"),
        _link(F.col("src"), F.col("page")).alias("img"), pick_first(F.col("amount"), F.col("whole_price")).alias("price"),
    )
    return made.filter("title != '' AND url != ''"), read.select("page_id").distinct()


def _plain_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """The first link of each url that has a title or text."""
    page = pages.select("page_id", F.col("url").alias("page"))
    title = pick_first(F.trim(F.coalesce(F.col("attrs")["title"], F.lit(""))), F.col("text"))
    links = nodes.filter(selects("a[href]")).join(page, "page_id").select("page_id", F.col("node").alias("top"), title.alias("title"), _link(F.col("attrs")["href"], F.col("page")).alias("url"))
    first = relational.keep_first(links.filter("title != '' AND url != ''"), ["page_id", "url"], ["top"])
    return first.select("page_id", "top", sku_from_title(F.col("title")).alias("sku"), "title", "url", F.lit("").alias("img"), F.lit("").alias("price"))


def server_ladder(pages: DataFrame, limit: int = 50) -> DataFrame:
    """page_id, pos, adapter, sku, title, url, img, price: cards; on pages without any, a shop list; else plain links."""
    nodes = written(html_nodes(pages), "ladder-nodes")
    cards = written(_cards(nodes, pages), "ladder-cards")
    rest = nodes.join(cards.select("page_id").distinct(), "page_id", "left_anti")
    listed, with_list = _shop_list(rest, pages)
    links = _plain_links(rest.join(with_list, "page_id", "left_anti"), pages)
    parts = [(cards, "generic-cards"), (listed, "woocommerce"), (links, "generic-links")]
    out = None
    for rows, name in parts:
        named = _numbered(rows, limit).select(*COLUMNS, F.lit(name).alias("adapter"))
        out = named if out is None else out.unionByName(named)
    return out


def root_links(pages: DataFrame, price: str, limit: int = 50, nodes: DataFrame | None = None) -> DataFrame:
    """page_id, pos, sku, title, url, img, price: links worth following inside each page's root."""
    nodes = written(html_nodes(pages), "root-nodes") if nodes is None else nodes
    roots = extract.page_roots(nodes).select("page_id", F.col("root").alias("top"), "end")
    # One root a page, so that this pairs each link once.
    links = nodes.filter(selects("a[href]")).join(roots, "page_id").filter("node > top AND node <= end").join(pages.select("page_id", F.col("url").alias("page")), "page_id")
    links = links.select("page_id", F.col("node").alias("top"), F.col("text").alias("title"), absolutize(F.col("attrs")["href"], F.col("page")).alias("url"), "page")
    good = links.filter(F.col("url") != "").filter(~classify.is_junk_link(F.col("title"), F.col("url"), F.col("page")) & (classify.link_score(F.col("url"), F.col("title"), price) >= 1))
    first = relational.keep_first(good, ["page_id", "url"], ["top"])
    rows = first.select("page_id", "top", pick_first(sku_from_title(F.col("title")), F.col("title")).alias("sku"), "title", "url", F.lit("").alias("img"), F.lit("").alias("price"))
    return _numbered(rows, limit).select(COLUMNS)


def extract_list(pages: DataFrame, limit: int = 50) -> DataFrame:
    """page_id, pos, adapter_used, sku, title, url, img, price: the first of these that gives rows for a page.

    The platform's template, a detail page's or a list's universal reading, links in the page's root, the first list. Pages are
    parsed once; each step reads the nodes of the pages that no step before it had rows for.
    """
    from tablewright.functions.prices import NEAR_PRICE

    nodes, left, out = written(html_nodes(pages), "list-nodes"), pages, None

    def single(rest: DataFrame, some: DataFrame) -> DataFrame:
        detail = extract.detail_fields(some).filter("is_detail").join(rest.select("page_id", "url"), "page_id")
        return detail.select("page_id", F.lit(1).alias("pos"), "sku", "title", "url", "img", "price")

    steps = [
        ("template", lambda rest, some: extract.parse_catalog(rest, limit, some)), ("universal", single), ("links+rootScope", lambda rest, some: root_links(rest, NEAR_PRICE, limit, some)),
        ("generic-legacy", lambda rest, some: legacy_items(rest, limit, some)),
    ]
    for name, step in steps:
        rows = step(left, nodes).filter(F.col("pos") <= limit)
        rows = rows.select("page_id", F.col("pos").cast("int").alias("pos"), F.lit(name).alias("adapter_used"), *COLUMNS[2:])
        if name != steps[-1][0]:
            rows = written(rows, f"list-{name}")
            done = rows.select("page_id").distinct()
            left, nodes = left.join(done, "page_id", "left_anti"), nodes.join(done, "page_id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def detail_test(nodes: DataFrame) -> DataFrame:
    """page_id, by_type, by_buy, by_trail, by_sku, is_detail: whether a page shows one product, and what says so.

    Its type is product; it has a heading and a way to buy; the last step of its breadcrumb is no link; or a number stands at a label.
    """
    steps = twig.find(nodes, {"step": ".breadcrumb li, .breadcrumbs li, nav[aria-label=breadcrumb] li", "linked": "li a"})
    # The last step of a page's trails, and whether a link lies in it.
    last = steps.groupBy("page_id").agg(
        F.max(F.when(F.col("name") == "step", F.struct("node", "last"))).alias("s"), F.collect_set(F.when(F.col("name") == "linked", F.col("node"))).alias("links")
    )
    texts = nodes.filter("tag = 'li'").select("page_id", F.col("node").alias("_n"), (F.col("text") != "").alias("said"))
    last = last.filter("s IS NOT NULL").join(texts, (last["page_id"] == texts["page_id"]) & (F.col("s.node") == F.col("_n"))).select(last["page_id"], "s", "links", "said")
    trail = last.select("page_id", (F.col("said") & ~F.exists("links", lambda n: (n > F.col("s.node")) & (n <= F.col("s.last")))).alias("by_trail"))
    numbered = extract.document_sku(nodes).select("page_id", (F.col("sku") != "").alias("by_sku"))
    content = F.coalesce(F.col("attrs")["content"], F.lit(""))
    buy = selects("form[action*='cart' i], form[action*='warenkorb' i]") | (F.col("tag").isin("button", "a") & F.col("text").rlike(BUY_TEXT))
    roles = {"type": ["meta[property='og:type']"], "head": ["h1"]}
    rows = twig.fields(nodes, {"page": None}, {"page": roles}, {"type": content, "head": _have(F.col("text"))}, {"page": {"buys": buy}})
    own = rows.select("page_id", got("type").rlike("(?i)product").alias("by_type"), ((got("head") != "") & (F.col("n")["buys"] > 0)).alias("by_buy"))
    known = own.join(trail, "page_id", "left").join(numbered, "page_id", "left")
    flags = known.select("page_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("by_type", "by_buy", "by_trail", "by_sku")])
    return flags.withColumn("is_detail", F.col("by_type") | F.col("by_buy") | F.col("by_trail") | F.col("by_sku"))


def code_lookup(html: Column) -> Column:
    """The value cell after a label cell 'Artikelnummer:', without tags; null if there is none."""
    found = F.regexp_extract(html, r"(?is)Artikelnummer:\s*</td>\s*<td[^>]*>(.*?)</td>", 1)
    return F.nullif(F.trim(F.regexp_replace(found, "<[^>]+>", "")), F.lit(""))


def detect_preview(pages: DataFrame, price: str, n: int = 5) -> DataFrame:
    """page_id, type, platform and titles: the page's type, and the titles of its n best links."""
    links = classify.deep_anchors(pages, price, n).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"))
    named = pages.select("page_id", classify.page_type(F.col("html")).alias("type"), classify.platform(F.col("html")).alias("platform"))
    return named.join(links, "page_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
