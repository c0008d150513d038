"""Article numbers and EANs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import blank, clean_text

# Patterns of labels and codes.
CODE = r"[:#\-–—]?\s*([A-Za-z0-9][A-Za-z0-9._\-/]{3,31})"
LABEL_CODES = [
    r"(?i)Artikel(?:-?\s*Nr\.?|nummer)\s*" + CODE,
    r"(?i)Bestellnummer\s*" + CODE,
    r"(?i)SKU\s*" + CODE,
    r"(?i)(?:^|\s)(?:P/?N|Part\s*Number)\s*" + CODE,
]
SKU_LABELS = r"(?:Artikel-?Nr\.?|Artikelnummer|Art\.-?Nr\.?|Bestellnummer|SKU|MPN|P/N)"
PAGE_LABELS = [
    r"(?i)Art\.?\s*[-.]?\s*Nr\.?\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
    r"(?i)Artikel(?:nummer|-?Nr\.?)\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
    r"(?i)Bestell(?:nummer|-?Nr\.?)\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
    r"(?i)Hersteller-?Nr\.?\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
    r"(?i)\bSKU\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
    r"(?i)Product\s*code\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
    r"(?i)Model\s*[:#]?\s*([A-Za-z0-9\-_./]+)",
]
CHECK_NUMBER = r"(?iu)pr[üu]fziffer\s*[:#]?\s*(\d{6,14})"


def _first(c: Column, *patterns: str) -> Column:
    return F.coalesce(*[blank(F.regexp_extract(c, p, 1)) for p in patterns], F.lit(""))


def sku_from_title(c: Column, upper_only: bool = False) -> Column:
    """Four digits or more in a title, else a run of letters and digits with hyphens."""
    t = F.coalesce(c, F.lit(""))
    word = r"(\b[A-Z0-9][A-Z0-9-]{3,}\b)" if upper_only else r"(?i)(\b[0-9A-Z]{4,}(?:-[0-9A-Z]{2,})*\b)"
    return _first(t, r"(\b[0-9]{4,}\b)", word)


def split_sku(c: Column) -> Column:
    """struct<sku, rest>: the first token of a name and what follows; a name of one token is all sku."""
    t = clean_text(c)
    pattern = r"^([A-Za-z0-9._\-/]+)\s+(.+)$"
    sku = F.regexp_extract(t, pattern, 1)
    return F.struct(
        F.when(sku != "", sku).otherwise(t).alias("sku"), F.regexp_extract(t, pattern, 2).alias("rest")
    )


def item_number(raw: Column, link: Column, title: Column) -> Column:
    """A given number, else one at the end of the link, else one in the title."""
    at_end = F.regexp_extract(F.coalesce(link, F.lit("")), r"(\d{2}-\d{5})(?:\.\w+)?$", 1)
    in_title = F.regexp_extract(F.coalesce(title, F.lit("")), r"(\b[A-Z0-9]{2,8}-\d{3,8}\b)", 1)
    return F.coalesce(blank(F.trim(raw)), blank(at_end), blank(in_title), F.lit(""))


def item_number_from_page(html: Column, url: Column) -> Column:
    """By itemprop, then by the labels in order, then by the url. JSON-LD is read by functions.jsonld."""
    h = F.coalesce(html, F.lit(""))
    prop = F.coalesce(
        blank(F.regexp_extract(h, r"""(?i)itemprop=["']sku["'][^>]+content=["']([^"']+)["']""", 1)),
        blank(F.regexp_extract(h, r"""(?is)<[^>]+itemprop=["']sku["'][^>]*>(.*?)</[^>]+>""", 1)),
    )
    labelled = F.coalesce(*[blank(F.regexp_extract(h, p, 1)) for p in PAGE_LABELS])
    from_url = blank(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)(\b[A-Z0-9]{2,8}-\d{3,8}\b)", 1))
    return F.coalesce(blank(F.trim(F.regexp_replace(prop, "<[^>]+>", ""))), labelled, from_url, F.lit(""))


def label_value(c: Column) -> Column:
    """The first labelled code of a text that is a likely article number; '' if there is none."""
    t = clean_text(c)
    found = [F.regexp_extract(t, p, 1) for p in LABEL_CODES]
    return F.coalesce(*[F.when(is_likely_sku(f), f) for f in found], F.lit(""))


def is_likely_sku(c: Column) -> Column:
    """4 to 32 letters, digits and separators, not all digits, not a price, not all separators."""
    return (
        F.length(c).between(4, 32)
        & ~c.rlike(r"^[0-9]+$")
        & ~c.rlike(r"^[0-9]+\.[0-9]{2}$")
        & c.rlike(r"^[A-Za-z0-9._\-/]+$")
        & c.rlike(r"[A-Za-z0-9]")
    )


def token_score(c: Column) -> Column:
    """How much a token looks like an article number: letters, separators, a length near 16."""
    return (
        F.when(c.rlike("[A-Za-z]"), 3).otherwise(0)
        + F.when(c.rlike(r"[-_/.]"), 1).otherwise(0)
        + F.greatest(F.lit(0), 16 - F.abs(16 - F.length(c)))
    )


def best_token(c: Column) -> Column:
    """The likely article number with the best score; the first of equals; null if there is none."""
    tokens = F.filter(F.split(clean_text(c), r"[^A-Za-z0-9._\-/]+"), is_likely_sku)
    ranked = F.transform(tokens, lambda t, i: F.struct(token_score(t).alias("s"), (-i).alias("i"), t.alias("t")))
    return F.array_max(ranked)["t"]


def sku_missing(c: Column) -> Column:
    """Empty, under four characters, or one to three digits."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return (s == "") | (F.length(s) < 4) | s.rlike(r"^\d{1,3}$")


def is_check_number(c: Column, strict: bool = False) -> Column:
    """Eight digits or more; strict: 48 and six to ten digits."""
    return c.rlike(r"^48\d{6,10}$") if strict else c.rlike(r"^\d{8,}$") | c.rlike(r"^48\d{6,10}$")


def check_number(c: Column) -> Column:
    """The number after the label Prüfziffer; '' if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), CHECK_NUMBER, 1)


def _weighted(c: Column, n: int, odd_from_left: int, even_from_left: int) -> Column:
    """Check digit test: weights alternate from the left over all digits but the last."""
    total = F.lit(0)
    for i in range(n - 1):
        total = total + F.substring(c, i + 1, 1).try_cast("int") * (even_from_left if i % 2 else odd_from_left)
    digit = F.substring(c, n, 1).try_cast("int")
    return F.coalesce(c.rlike(rf"^\d{{{n}}}$") & ((10 - total % 10) % 10 == digit), F.lit(False))


def ean13(c: Column) -> Column:
    """Valid 13-digit EAN."""
    return _weighted(c, 13, 1, 3)


def ean8_reference(c: Column) -> Column:
    """8 digits with weights 1, 3 from the left, which is not the standard's rule but the one to be matched."""
    return _weighted(c, 8, 1, 3)


def ean8_gs1(c: Column) -> Column:
    """Valid 8-digit EAN by the standard: weights 3, 1 from the left."""
    return _weighted(c, 8, 3, 1)


def eans(c: Column) -> Column:
    """Distinct valid EANs of a text, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(\d{13}|\d{8})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ean13(x) | ean8_reference(x)))


def skus(c: Column) -> Column:
    """Distinct labelled codes of a text, and codes of url parameters; one to four digits are none."""
    t = clean_text(c)
    labelled = F.regexp_extract_all(t, F.lit(rf"(?i){SKU_LABELS}\s*[:：]?\s*([A-Za-z0-9._\-/]{{3,}})"), F.lit(1))
    trimmed = F.filter(labelled, lambda v: ~v.rlike(r"^\d{1,4}$"))
    params = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:sku|artnr|art-nr|pn|part|partno)=([A-Za-z0-9._\-/]{3,})"), F.lit(1))
    return F.array_distinct(F.concat(trimmed, params))


def best_id(eans_: Column, skus_: Column) -> Column:
    """The first EAN, else the SKU with the best score; '' if there is neither."""

    def score(s: Column) -> Column:
        return (
            F.when(s.rlike("[A-Za-z]"), 2.0).otherwise(0.0)
            + F.when(s.rlike("[-_]"), 1.0).otherwise(0.0)
            - F.abs(10 - F.length(s)) * 0.1
        )

    ranked = F.transform(skus_, lambda s, i: F.struct(score(s).alias("s"), (-i).alias("i"), s.alias("v")))
    return F.coalesce(F.get(eans_, F.lit(0)), F.array_max(ranked)["v"], F.lit(""))


def derive_sku(sku: Column, link: Column, title: Column) -> Column:
    """A given number with a digit, else the link's last segment, else the title's first word, as far as one has a digit."""
    from tablewright.functions.urls import last_segment

    first_word = F.regexp_extract(F.trim(F.coalesce(title, F.lit(""))), r"^(\S+)", 1)
    start = F.coalesce(blank(sku), first_word)
    from_url = F.when(start.rlike(r"\d"), start).otherwise(F.coalesce(blank(last_segment(link)), start))
    return F.when(from_url.rlike(r"\d"), from_url).otherwise(F.coalesce(blank(first_word), from_url))
