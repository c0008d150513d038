"""Product rows from pages: cards by profile, JSON-LD, detail pages and fallbacks, in ordered passes over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes, jsonld_rows, selects
from tablewright.functions.ids import sku_from_title
from tablewright.functions.images import best_image, srcset_urls
from tablewright.functions.prices import price_generic, price_platform
from tablewright.functions.text import pick_first
from tablewright.functions.urls import absolutize
from tablewright.operators import classify, relational, twig
from tablewright.session import written

#: Selectors are data: one profile a platform. Links that fail `keep` are no products.
PROFILES = {
    "shopify": {
        "card": ".product-item, .grid-product, .product-card, .card-wrapper", "title": [".product-title", ".card__heading", ".product-item__title"],
        "price": [".price", ".money", ".product-price"], "keep": classify.is_shopify_product,
    },
    "woocommerce": {
        "card": "li.product, .wc-block-grid__product", "title": [".woocommerce-loop-product__title", "h2", "h3"], "price": [".price", ".amount"],
        "keep": lambda u: ~classify.is_bad_path(u, "woocommerce"),
    },
    "magento": {
        "card": ".product-item, .item.product", "title": [".product-item-link", ".product-name"], "price": ["[data-price-amount]", ".price"],
        "keep": lambda u: ~classify.is_bad_path(u, "magento"),
    },
    "shopware": {"card": ".product-box, .product--box", "title": [".product-title", ".product-name", ".product--title"], "price": [".product-price", ".price"], "keep": lambda u: ~u.rlike(classify.BAD_LINK)},
    "static": {"card": ".product, .item, .card", "title": [".title", "h2", "h3", "h4"], "price": [".price", ".preis"], "keep": lambda u: ~u.rlike(classify.BAD_LINK)},
}
ROOTS = [
    ".product-grid", ".products", ".product-list", ".listing", ".catalog", ".category", "#main", "#content", "main", ".main", ".container", ".content",
    "#products", ".grid", "ul.products",
]
RECOMMENDED = r"(?i)recommend|related|similar|cross-?sell|upsell|also-bought|zubehoer|empfehl"


def _rank(selectors: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(selectors))):
        out = F.when(selects(s), i).otherwise(out)
    return out


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def some(value: Column) -> Column:
    """A value for a role: null where it is empty, so that the next node is asked."""
    return F.nullif(value, F.lit(""))


def got(role: str) -> Column:
    """A role's value in a row of twig.fields; '' if no node had one."""
    return F.coalesce(F.col("found")[role], F.lit("")).alias(role)


def card_fields(nodes: DataFrame, profiles: dict[str, dict], in_order: bool = False) -> DataFrame:
    """page_id, card, adapter and the raw fields of every card of each profile, in one pass; nodes in recommendations are none."""
    image = best_image(F.array(_attr("data-src"), F.get(srcset_urls(F.coalesce(_attr("srcset"), _attr("data-srcset"))), F.lit(0)), _attr("src")))
    anchor = selects("a[href]") & ~F.coalesce(_attr("href").startswith("#"), F.lit(False))
    roots, roles = {}, {}
    for name, profile in profiles.items():
        roots[name] = selects(profile["card"], F.col(twig.WORDS)) & ~F.coalesce(_attr("class"), F.lit("")).rlike(RECOMMENDED)
        roles[name] = {"own_title": profile["title"], "link_title": [anchor], "href": [anchor], "src": ["img"], "price_text": profile["price"], "own_sku": ["[data-sku]", "[itemprop=sku]", ".sku"]}
    values = {
        "own_title": some(F.col("text")), "link_title": some(F.coalesce(some(_attr("title")), F.col("text"))), "href": some(_attr("href")), "src": some(F.when(F.col("tag") == "img", image)),
        "price_text": some(F.coalesce(_attr("data-price-amount"), _attr("content"), F.col("text"))), "own_sku": some(F.coalesce(_attr("data-sku"), _attr("content"), F.col("text"))),
    }
    rows = twig.fields(nodes, roots, roles, values, in_order=in_order)
    return rows.select("page_id", F.col("root").alias("card"), F.col("kind").alias("adapter"), *[got(r) for r in values])


def finished_cards(fields: DataFrame, pages: DataFrame, keep: dict) -> DataFrame:
    """page_id, pos, adapter, title, url, img, price, sku of raw cards: cleaned, absolute, and the first of each link.

    keep: by adapter, the condition on a link that is a product.
    """
    named = fields.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    # Each ladder is worked out once, in steps that are small enough to be compiled.
    named = relational.once(
        named, "page_id", F.col("card").alias("pos"), "adapter", "price_text", "own_sku", pick_first(F.col("own_title"), F.col("link_title")).alias("raw_title"),
        F.when(F.col("href") != "", absolutize(F.col("href"), F.col("page_url"))).otherwise("").alias("url"),
        F.when(F.col("src") != "", absolutize(F.col("src"), F.col("page_url"))).otherwise("").alias("img"),
    ).filter("url != ''")
    priced = relational.once(
        named, "page_id", "pos", "adapter", "url", "img", "own_sku", classify.platform_title(F.col("raw_title")).alias("title"), sku_from_title(F.col("raw_title")).alias("title_sku"),
        price_platform(F.col("price_text")).alias("own_price"), price_generic(F.col("price_text"))["price"].alias("any_price"),
    ).filter("title != ''")
    out = priced.select("page_id", "pos", "adapter", "title", "url", "img", pick_first(F.col("own_price"), F.col("any_price")).alias("price"), pick_first(F.col("own_sku"), F.col("title_sku")).alias("sku"))
    good = F.lit(False)
    for name, test in keep.items():
        good = good | ((F.col("adapter") == name) & test(F.col("url")))
    # The first row of each link is found before the conditions on its url are.
    first = relational.keep_first(out, ["page_id", "adapter", "url"], ["pos"])
    return first.filter(good)


def card_rows(nodes: DataFrame, pages: DataFrame, profile: dict) -> DataFrame:
    """page_id, pos, title, url, img, price, sku of the cards of one profile."""
    return finished_cards(card_fields(nodes, {"own": profile}), pages, {"own": profile["keep"]}).drop("adapter")


def jsonld_items(pages: DataFrame) -> DataFrame:
    """Product rows of the pages' JSON-LD."""
    rows = jsonld_rows(pages).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    return rows.select(
        "page_id", "pos", F.col("name").alias("title"), absolutize(F.col("url"), F.col("page_url")).alias("url"), F.col("image").alias("img"), "price", "sku"
    )


def detail_fields(nodes: DataFrame, in_order: bool = False) -> DataFrame:
    """By page: title, image, price, description and sku by chains of preference, and is_detail."""
    content = F.coalesce(_attr("content"), F.col("text"))
    roles = {
        "title": ["meta[property='og:title']", "[itemprop=name]", "h1", "title"],
        "img": ["meta[property='og:image']", "[itemprop=image]", "img[src]"],
        "price": ["meta[property='product:price:amount']", "[itemprop=price]", ".price"],
        "desc": ["meta[property='og:description']", "meta[name=description]", "[itemprop=description]"],
        "sku": ["[itemprop=sku]", "[data-sku]", ".sku"],
    }
    values = {
        "title": some(content), "img": some(F.coalesce(_attr("content"), _attr("src"))), "price": some(content), "desc": some(content), "sku": some(F.coalesce(_attr("data-sku"), content)),
    }
    counts = {"typed": "meta[property='og:type'][content*=product]", "heads": "h1", "buys": "button[name=add], .add-to-cart, #buy, [itemprop=price]"}
    rows = twig.fields(nodes, {"page": None}, {"page": roles}, values, {"page": counts}, in_order=in_order)
    n = F.col("n")
    return rows.select("page_id", *[got(r) for r in roles], ((n["typed"] > 0) | ((n["heads"] > 0) & (n["buys"] > 0))).alias("is_detail"))


def page_roots(nodes: DataFrame, in_order: bool = False) -> DataFrame:
    """By page: the candidate root with the best score, 3 an image link, 2 a card, 1 for 20 links; the first of equals. end is its last node."""
    counts = {"pictured": "a img", "cards": PROFILES["static"]["card"] + ", .product-item, .product-box", "links": "a"}
    # A root's place in the order of preference comes with it, as the value of a test that only the root itself passes.
    rank = _rank(ROOTS)
    ranked = rank.isNotNull()
    rows = twig.fields(nodes, {"root": ranked}, {"root": {"order": [ranked]}}, {"order": rank}, {"root": counts}, in_order=in_order)
    n = F.col("n")
    scored = rows.select(
        "page_id", "root", F.col("last").alias("end"), F.col("found")["order"].cast("int").alias("order"),
        (3 * n["pictured"] + 2 * n["cards"] + F.floor(F.least(n["links"], F.lit(800)) / 20)).alias("score"),
    )
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("root", "end", "score"), F.struct("score", -F.col("order"), -F.col("root"))).alias("b"))
    return best.select("page_id", "b.root", "b.score", F.least(F.lit(0.95), 0.2 + F.col("b.score") / 50).alias("confidence"), "b.end")


def parse_catalog(pages: DataFrame, limit: int = 200, nodes: DataFrame | None = None) -> DataFrame:
    """page_id, pos, adapter and the eight columns of the product table.

    Each page is read by its platform's profile; where that gives fewer than three rows, by JSON-LD, by static cards, and
    by links, in this order: the first source with enough rows wins. At most `limit` rows a page. All profiles read one pass over a page's nodes;
    nodes: those of the pages, if they are written already.
    """
    from tablewright.functions.prices import NEAR_PRICE

    named = pages.filter(~classify.oversized(F.col("html"))).withColumn("platform", F.lower(classify.platform(F.col("html"))))
    fields = card_fields(html_nodes(named) if nodes is None else nodes, PROFILES, nodes is None)
    platforms = named.select("page_id", "url", "platform")
    own = fields.join(platforms.select("page_id", "platform"), "page_id").filter((F.col("adapter") == F.col("platform")) | (F.col("adapter") == "static")).drop("platform")
    columns = ["page_id", "pos", "title", "url", "img", "price", "sku", "adapter"]
    # Written, as the ladders of finished cards and those of the ranking are too wide for one stage.
    cards = written(finished_cards(own, platforms, {name: p["keep"] for name, p in PROFILES.items()}).select(columns), "page-cards")
    by_platform, static = cards.filter("adapter != 'static'"), cards.filter("adapter = 'static'")
    ld = jsonld_items(named).withColumn("adapter", F.lit("jsonld")).select(columns)
    links = classify.deep_anchors(named, NEAR_PRICE, limit).select(
        "page_id", F.col("rank").alias("pos"), "title", "url", F.lit("").alias("img"), F.lit("").alias("price"), sku_from_title(F.col("title")).alias("sku"), F.lit("links").alias("adapter")
    )
    best = relational.first_nonempty([(by_platform, 3), (ld, 1), (static, 3), (links, 1)], "page_id")
    ranked = relational.row_index(best, ["pos", "url"], ["page_id"]).filter(F.col("idx") <= limit)
    row = relational.product_row(sku=F.col("sku"), title=F.col("title"), img=F.col("img"), price=F.col("price"), url=F.col("url"), link=F.col("url"))
    return ranked.select("page_id", F.col("idx").alias("pos"), "adapter", *row)


def outside(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes that are neither selected nor inside a selected node."""
    return twig.outside(nodes, selects(selector))


def card_counts(nodes: DataFrame, selectors: list[str], least: int = 6) -> DataFrame:
    """By page: the largest number of nodes that one of the selectors finds, and whether it is `least` or more."""
    counts = nodes.groupBy("page_id").agg(*[F.count_if(selects(s)).alias(f"_{i}") for i, s in enumerate(selectors)])
    most = F.greatest(*[F.col(f"_{i}") for i in range(len(selectors))]) if len(selectors) > 1 else F.col("_0")
    return counts.select("page_id", most.alias("cards"), (most >= least).alias("ok"))


def generic_links(pages: DataFrame, least: int = 6, limit: int = 200) -> DataFrame:
    """page_id, pos, sku, title, url, price, currency: cards of a page, and where these are fewer than `least` its links too.

    Of rows with one url the first stays, cards first; the title's leading code becomes the sku.
    """
    from tablewright.functions.ids import split_sku
    from tablewright.functions.prices import NEAR_PRICE
    from tablewright.functions.text import clean_title

    cards = card_rows(html_nodes(pages), pages, PROFILES["static"]).select("page_id", F.lit(0).alias("side"), "pos", "title", "url", "price")
    few = pages.select("page_id").join(cards.groupBy("page_id").count().filter(F.col("count") >= least).select("page_id"), "page_id", "left_anti")
    links = classify.deep_anchors(pages.join(few, "page_id", "left_semi"), NEAR_PRICE, limit)
    links = links.select("page_id", F.lit(1).alias("side"), F.col("rank").alias("pos"), "title", "url", F.col("title").alias("price"))
    rows = relational.keep_first(cards.unionByName(links), ["page_id", "url"], ["side", "pos"])
    name, money = split_sku(clean_title(F.col("title"))), price_generic(F.col("price"))
    ranked = relational.row_index(rows, ["side", "pos"], ["page_id"]).filter(F.col("idx") <= limit)
    out = ranked.select(
        "page_id", F.col("idx").alias("pos"), name["sku"].alias("sku"), F.when(name["rest"] != "", name["rest"]).otherwise(clean_title(F.col("title"))).alias("title"), "url",
        money["price"].alias("price"), money["currency"].alias("currency"),
    )
    return out.filter((F.col("url") != "") & ((F.col("title") != "") | (F.col("sku") != "")))


def product_links(pages: DataFrame, keep) -> DataFrame:
    """page_id, pos, url, title: the first anchor of each link that `keep` takes."""
    links = classify.anchors(pages).withColumn("link", absolutize(F.col("href"), F.col("url")))
    good = links.filter(keep(F.col("link"))).select("page_id", "pos", F.col("link").alias("url"), F.col("text").alias("title"))
    return relational.keep_first(good, ["page_id", "url"], ["pos"])


def universal(pages: DataFrame, limit: int = 200) -> DataFrame:
    """page_id, pos, title, url, price, sku: a detail page is one row; other pages give cards, then links."""
    nodes = written(html_nodes(pages), "universal-nodes")
    details = written(detail_fields(nodes), "universal-details").join(pages.select("page_id", "url"), "page_id")
    single = details.filter("is_detail").select("page_id", F.lit(1).alias("pos"), "title", "url", "price", pick_first(F.col("sku"), sku_from_title(F.col("title"))).alias("sku"))
    done = single.select("page_id")
    listed = parse_catalog(pages.join(done, "page_id", "left_anti"), limit, nodes.join(done, "page_id", "left_anti")).select("page_id", "pos", "title", "url", "price", "sku")
    return single.unionByName(listed)


def minimal_rows(nodes: DataFrame) -> DataFrame:
    """page_id, pos, name, image, price (a number): one row for each .product."""
    from tablewright.functions.prices import price_prefix

    roles = {"name": [".name", ".title", "h2"], "image": ["img"], "p": [".price"]}
    rows = twig.fields(nodes, {"card": ".product"}, {"card": roles}, {"name": some(F.col("text")), "image": some(_attr("src")), "p": some(F.col("text"))})
    return rows.select("page_id", F.col("root").alias("pos"), got("name"), got("image"), price_prefix(got("p")).alias("price"))


def document_sku(nodes: DataFrame) -> DataFrame:
    """page_id, sku: by itemprop or data attribute, then a definition list or table row whose label names a number, then text."""
    from tablewright.functions.ids import label_value

    named = r"(?i)^(artikel-?nr|artikelnummer|bestellnummer|item no|sku|mpn|hersteller-?nr)\.?:?$"
    labels = nodes.filter(F.col("tag").isin("dt", "th", "td") & F.col("text").rlike(named)).select("page_id", F.col("parent").alias("p"), F.col("node").alias("label"))
    after = nodes.filter(F.col("tag").isin("dd", "td")).select("page_id", F.col("parent").alias("p"), F.col("node").alias("value"), F.col("text").alias("v"))
    pairs = labels.join(after, ["page_id", "p"]).filter("value > label AND v != ''")
    by_label = pairs.groupBy("page_id").agg(F.min_by("v", F.struct("label", "value")).alias("by_label"))
    roles = {"by_attr": ["[itemprop=sku]", "[data-sku]"], "by_text": [F.col("depth") == 0]}
    values = {"by_attr": some(F.coalesce(_attr("data-sku"), _attr("content"), F.col("text"))), "by_text": some(F.when(F.col("depth") == 0, label_value(F.col("text"))))}
    own = twig.fields(nodes, {"page": None}, {"page": roles}, values).select("page_id", got("by_attr"), got("by_text"))
    return own.join(by_label, "page_id", "left").select("page_id", pick_first(F.col("by_attr"), F.col("by_label"), F.col("by_text")).alias("sku"))
