"""Page and link classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.functions.text import clean_text, contains_any, selector_tokens
from tablewright.functions.urls import host, origin, path, same_origin
from tablewright.operators.relational import once
from tablewright.session import written

# Signals of commerce platforms, pages and links.
PLATFORM_SIGNALS = {
    "Shopify": r"(?i)cdn\.shopify\.com|window\.Shopify|Shopify\.theme",
    "WooCommerce": r"(?i)woocommerce|wp-content/plugins/woocommerce",
    "Magento": r"(?i)Magento|Mage\.Cookies|mage/requirejs|pub/static/|form_key",
    "Shopware": r"(?i)shopware|sw-|Shopware\.",
}
PRICE_TOKENS = [
    "price", "preise", "preis", "€", "$", "¥", "eur", "usd", "inkl. mwst", "in kl. mwst", "inkl mwst", "mwst", "ab €", "from €", "uvp", "sale",
    "sonderpreis", "angebot",
]
CART_TOKENS = [
    "add to cart", "add-to-cart", "cart/add", "buy now", "in den warenkorb", "warenkorb", "kaufen", "jetzt kaufen", "in den einkaufswagen",
    "zum warenkorb", "checkout",
]
PRICE_SIGNAL = r"(?i)€|eur|preis|price|chf|\$|£|[0-9]\s*,\s*[0-9]{2}\s*€"
CART_SIGNAL = r"(?i)add-?to-?cart|warenkorb|in den warenkorb|detail-?btn|buy-?now"
BAD_LINKS = [
    "hilfe", "support", "kundendienst", "faq", "service", "agb", "widerruf", "widerrufsbelehrung", "rueckgabe", "retoure", "versand", "liefer",
    "shipping", "payment", "zahlungs", "datenschutz", "privacy", "cookies?", "kontakt", "contact", "impressum", "about", "ueber-?uns", "newsletter",
    "blog", "news", "sitemap", "rss", "login", "register", "account", "warenkorb", "cart", "checkout", "bestellung", "note", "paypal", "gift",
    "gutschein", "jobs", "karriere", r"\.pdf$",
]
BAD_LINK = "(?i)" + "|".join(BAD_LINKS)
PRODUCT_PATH = r"/products?/|/prod/|/item/|/p/|/detail/|/details/|/artikel/|/sku/|/dp/|/kaufen/|/buy/"
PRODUCT_HINTS = [
    "product", "produkt", "artikel", "item", "sku", "p/", "/p-", "/prod", "/shop/", "/detail", "/details", "/kaufen", "/buy", "/add-to-cart",
]
STRONG_PATH = r"/p/|/pd/|/detail|/details|/produkt|/product"
ASSET = r"(?i)\.(?:jpg|jpeg|png|webp|gif|svg|pdf|docx?|xlsx?|zip|rar)$"
NAVIGATION = ["home", "start", "audio", "video", "strom", "multimedia", "b-run", "solar", "computer"]
JUNK_WORDS = [
    "login", "anmelden", "account", "register", "signup", "password", "passwort", "cart", "warenkorb", "basket", "checkout", "kasse", "help", "hilfe",
    "support", "kundendienst", "kundenservice", "faq", "about", "über uns", "ueber uns", "impressum", "datenschutz", "privacy", "agb", "widerruf",
    "versand", "shipping", "zahlung", "payment", "kontakt", "contact", "newsletter", "sitemap", "policy", "terms", "bedingungen", "blog", "news", "rss",
    "social",
]
LEGAL_PATH = r"(impressum|privacy|datenschutz|agb|terms|policy|kontakt|contact|login|account|register)"
JUNK_TITLE = r"(?i)^(produkt|zum\s+produkt|weitere|vorschau|versandkosten|technische\b)"
PLATFORM_BAD_PATHS = {
    "woocommerce": [
        "/cart", "/checkout", "/account", "/my-account", "/wishlist", "/kontakt", "/contact", "/hilfe", "/support", "/agb", "/impressum", "/privacy",
        "/datenschutz", "/versand", "/shipping", "/returns",
    ],
    "magento": [
        "/cart", "/checkout", "/customer", "/account", "/wishlist", "/contact", "/impressum", "/privacy", "/datenschutz", "/returns", "/support", "/hilfe",
    ],
}
HTML_LIMIT = 200_000


def platform_flags(html: Column) -> dict[str, Column]:
    """Each platform's signal by itself."""
    h = F.coalesce(html, F.lit(""))
    return {name: h.rlike(pattern) for name, pattern in PLATFORM_SIGNALS.items()}


def platform(html: Column) -> Column:
    """The first platform whose signal the page shows; '' if none."""
    out = F.lit("")
    for name, flag in reversed(list(platform_flags(html).items())):
        out = F.when(flag, name).otherwise(out)
    return out


def oversized(html: Column) -> Column:
    """More than HTML_LIMIT characters."""
    return F.length(F.coalesce(html, F.lit(""))) > HTML_LIMIT


def is_product_path(href: Column) -> Column:
    """A product path without a word of site links."""
    h = F.lower(F.coalesce(href, F.lit("")))
    return h.rlike(PRODUCT_PATH) & ~h.rlike(BAD_LINK)


def has_product_jsonld(html: Column) -> Column:
    """JSON-LD whose type says product, or with a price in an offer; read from the raw script texts."""
    h = F.coalesce(html, F.lit(""))
    scripts = F.regexp_extract_all(h, F.lit(r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    return F.exists(
        scripts,
        lambda s: s.rlike(r'(?is)"@type"\s*:\s*(\[[^\]]*)?"[^"]*product') | s.rlike(r'(?is)"offers"\s*:\s*[\[{][^}]*"(price|priceCurrency)"'),
    )


def page_type(html: Column) -> Column:
    """detail if there is product JSON-LD, else list."""
    return F.when(has_product_jsonld(html), "detail").otherwise("list")


def light_class(url: Column, html: Column) -> Column:
    """struct<platform, type, adapter_hint> by a few signals of url and page."""
    u, h = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    shopify = u.rlike(r"(?i)cdn\.shopify|x-shopify|/collections/") | h.rlike(r"(?i)x-shopify|shopify-section|shopify-dynamic")
    woo = F.concat(u, h).rlike(r"(?i)/product-category/|woocommerce|wp-content/plugins/woocommerce")
    listing = u.rlike(r"(?i)/collections/|/category/|/kategorie/") | h.rlike(r"(?i)product-grid|grid__item")
    name = F.when(shopify, "shopify").when(woo, "woocommerce").otherwise("")
    kind = F.when(listing, "catalog").otherwise("")
    hint = F.when(name == "", "").when(kind == "", name).otherwise(F.concat(name, F.lit(":"), kind))
    return F.struct(name.alias("platform"), kind.alias("type"), hint.alias("adapter_hint"))


def adapter(hint: Column, url: Column, html: Column, hosts: dict[str, str]) -> Column:
    """A given hint, else the adapter of the url's host (suffix -> adapter), else the platform, else 'generic'."""
    out = F.coalesce(F.nullif(F.lower(platform(html)), F.lit("")), F.lit("generic"))
    for suffix, name in hosts.items():
        out = F.when((host(url) == suffix) | host(url).endswith("." + suffix), name).otherwise(out)
    return F.coalesce(F.nullif(hint, F.lit("")), out)


def shop_tests(url: Column) -> dict[str, Column]:
    """Each shop adapter's own test of a url, by name; several may hold."""
    u, name, query = F.coalesce(url, F.lit("")), host(url), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(\?[^#]*)", 1))
    parts = F.lower(path(url))
    listed = F.contains(parts, F.lit("/kategorie")) | F.contains(parts, F.lit("/kategorien")) | F.contains(parts, F.lit("/listing"))
    # The shops' hosts and the marks of platforms.
    return {
        "memoryking": name.rlike(r"(^|\.)memoryking\.de$"), "sinotronic": u.rlike(r"(?i)(?:^|\.)sinotronic-e\.com"),
        "shopware": (origin(url) != "") & (name.rlike(r"\bshopware\b") | listed | query.rlike(r"[?&](scategory|spage|sviewport)=")),
        "magento": u.rlike(r"(?i)magento|/catalog/category/|\.html(\?|\z)"), "woocommerce": u.rlike(r"(?i)woocommerce|/product-category/"),
    }


def fetch_strategy(url: Column, hint: Column, timeouts: Column, last_failed: Column) -> Column:
    """struct<use_browser, timeout_ms, delay_ms> from what recent fetches of the site did."""
    fast = F.coalesce(url, F.lit("")).rlike(r"(?i)cdn\.shopify|/collections/") | (F.coalesce(hint, F.lit("")) == "shopify")
    return F.struct(
        (~fast & (F.coalesce(timeouts, F.lit(0)) >= 3)).alias("use_browser"),
        F.when(fast, 12000).otherwise(18000).alias("timeout_ms"),
        F.when(F.coalesce(last_failed, F.lit(False)), 350).otherwise(0).alias("delay_ms"),
    )


def link_score(href: Column, text: Column, price: str) -> Column:
    """Product hints +3, a price +2, a strong path +2, navigation words -2, assets and fragments -3."""
    h, t = F.lower(F.coalesce(href, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(contains_any(h, PRODUCT_HINTS), 3).otherwise(0)
        + F.when(t.rlike(price), 2).otherwise(0)
        - F.when(contains_any(t, NAVIGATION), 2).otherwise(0)
        + F.when(h.rlike(STRONG_PATH), 2).otherwise(0)
        - F.when(h.rlike(ASSET) | h.startswith("#"), 3).otherwise(0)
    )


def is_junk_link(text: Column, href: Column, page: Column) -> Column:
    """Off-site, an asset, a junk word in the text, or a legal path."""
    return ~same_origin(page, href) | href.rlike(ASSET) | contains_any(text, JUNK_WORDS) | F.lower(href).rlike(LEGAL_PATH)


def is_shopify_product(link: Column) -> Column:
    """/products/ and no reviews."""
    u = F.lower(F.coalesce(link, F.lit("")))
    return F.contains(u, F.lit("/products/")) & ~u.rlike("#reviews|reviewssection|/reviews")


def is_bad_path(link: Column, name: str) -> Column:
    """A path that the platform uses for the shop itself."""
    u = F.coalesce(link, F.lit(""))
    out = F.lit(False)
    for p in PLATFORM_BAD_PATHS[name]:
        out = out | F.contains(u, F.lit(p))
    return out


def platform_title(title: Column) -> Column:
    """A cleaned title; '' for placeholders and review links."""
    t = clean_text(title)
    return F.when(t.isin("item", "{{ title }}") | t.rlike("(?i)^Zu den Bewertungen"), "").otherwise(t)


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, text: the anchors of each page with an href, in order."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)(<a\s[^>]*>.*?</a>)"""), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    href = F.regexp_extract("a", r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']""", 1)
    inner = F.regexp_replace("a", r"(?s)<[^>]+>", " ")
    return once(rows, "page_id", "url", "pos", href.alias("href"), clean_text(inner).alias("text")).filter("href != ''")


def predict_family(samples: DataFrame, families: DataFrame) -> DataFrame:
    """sample_id, family_id, score: the family nearest by selector tokens (0.6) and fields (0.4), both by Jaccard.

    samples: sample_id, selector, fields; families: pos, family_id, selector, fields, any number of both. The first of equal scores (by pos) wins;
    UNKNOWN if no score is above zero. Samples that repeat a sample_id are one, with the tokens and fields of all.

    A set-similarity join on tokens: a pair can only score if it shares a token or a field. Families of equal tokens and fields are one class, and so are
    samples. A class's tokens in order of their rarity give its prefix: with a score already reached through a rare token, a pair that shares only commoner ones
    cannot do better, so that each sample asks the postings of a common token only while its bound allows. The first pass joins each sample's rarest shared tokens; the
    second asks the rest only for tokens whose bound is above what the first found.
    """
    known = families.select("pos", "family_id", F.array_sort(F.array_distinct(selector_tokens(F.col("selector")))).alias("t"), F.array_sort(F.array_distinct(_strings("fields"))).alias("f"))
    family = written(known.groupBy("t", "f").agg(F.min(F.struct("pos", "family_id")).alias("first")).withColumn("family", F.monotonically_increasing_id()), "family-classes")
    own = samples.select("sample_id", selector_tokens(F.col("selector")).alias("t"), _strings("fields").alias("f"))
    by_id = own.groupBy("sample_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("f"))
    asked = written(by_id.groupBy("t", "f").count().select("t", "f").withColumn("sample", F.monotonically_increasing_id()), "sample-classes")
    marks = lambda df, key: df.select(key, "t", "f", F.explode(F.concat(F.transform("t", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("token"))), F.transform("f", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("token"))))).alias("m")).select(key, "t", "f", "m.*")
    postings = marks(family, "family").select("family", "kind", "token", F.col("t").alias("ft"), F.col("f").alias("ff"))
    # How many families have a token: a token of none is asked of none.
    sizes = postings.groupBy("kind", "token").agg(F.count("*").alias("n"))
    wanted = marks(asked, "sample").join(sizes, ["kind", "token"]).withColumn("rank", F.row_number().over(W.partitionBy("sample").orderBy("n", "kind", "token")))
    wanted = written(wanted, "family-asks")
    jaccard = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    score = 0.6 * jaccard(F.col("t"), F.col("ft")) + 0.4 * jaccard(F.col("f"), F.col("ff"))

    def best(asks: DataFrame) -> DataFrame:
        met = asks.join(postings, ["kind", "token"]).select("sample", "family", score.alias("score"))
        return met.join(family.select("family", "first"), "family").groupBy("sample").agg(F.max(F.struct("score", (-F.col("first.pos")).alias("order"), F.col("first.family_id").alias("family_id"))).alias("b"))

    rare = written(best(wanted.filter("rank <= 2")), "family-rare")
    # Of the tokens from this rank on a pair can share at most those that are left: their shares of the sample's sets bound its score.
    after = W.partitionBy("sample").orderBy("rank").rowsBetween(0, W.unboundedFollowing)
    shared = lambda kind, size: F.sum((F.col("kind") == kind).cast("int")).over(after) / F.greatest(F.size(size), F.lit(1))
    bound = 0.6 * shared(0, "t") + 0.4 * shared(1, "f")
    rest = wanted.withColumn("bound", bound).filter("rank > 2").join(rare.select("sample", F.col("b.score").alias("reached")), "sample", "left").filter("bound >= coalesce(reached, 0.0) - 1e-9")
    every = rare.unionByName(best(rest.drop("bound", "reached"))).groupBy("sample").agg(F.max("b").alias("b"))
    named = by_id.join(asked, ["t", "f"]).select("sample_id", "sample").join(every, "sample", "left")
    hit = F.coalesce(F.col("b.score") > 0, F.lit(False))
    return named.select("sample_id", F.when(hit, F.col("b.family_id")).otherwise("UNKNOWN").alias("family_id"), F.when(hit, F.round("b.score", 3)).otherwise(0.0).alias("score"))


def _strings(name: str) -> Column:
    return F.coalesce(F.array_compact(F.col(name).cast("array<string>")), F.array().cast("array<string>"))


def deep_anchors(pages: DataFrame, price: str, limit: int = 200, least: int = 1) -> DataFrame:
    """page_id, rank, url, title, score: links worth following, best first, at most `limit` a page.

    Anchors are made absolute, junk is dropped, and of those with a score of `least` or more the first of each url stays.
    """
    from tablewright.functions.urls import absolutize

    links = once(anchors(pages), "page_id", "url", "pos", "text", absolutize(F.col("href"), F.col("url")).alias("link"))
    links = links.filter(origin(F.col("link")) != "").filter(~is_junk_link(F.col("text"), F.col("link"), F.col("url")))
    links = once(links, "page_id", "pos", "link", "text", link_score(F.col("link"), F.col("text"), price).alias("score")).filter(F.col("score") >= least)
    # One shuffle by page serves both windows.
    first = links.repartition("page_id").withColumn("seen", F.row_number().over(W.partitionBy("page_id", "link").orderBy("pos"))).filter("seen = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "pos")))
    return ranked.filter(F.col("rank") <= limit).select("page_id", "rank", F.col("link").alias("url"), F.col("text").alias("title"), "score")
