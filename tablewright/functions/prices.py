"""Price functions as Column expressions. All amounts are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import blank, clean_text

# Price patterns and currency codes.
NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"
CURRENCY = r"(?i)(€|\$|£|CHF|EUR|USD|GBP)"
CURRENCY_CODES = {"€": "EUR", "£": "GBP", "$": "USD"}
GROUPED = r"^-?\d{1,3}([.,]\d{3})*([.,]\d{2})?$"
PLAIN = r"^-?\d+(\.\d+)?$"
EURO_BEFORE = r"(€\s*\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2}))"
EURO_AFTER = r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})\s*€)"
DECIMALS = r"(\d+[.,]\d{2})"
CARD_PRICE = r"(?i)(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})\s*(?:€|EUR))"
NEAR_PRICE = (
    r"(?i)(?:^|[^\d])(?:(?:€|CHF|PLN|zł|zł\.?|₺|£|\$)\s*)?\d{1,3}(?:[.\s]\d{3})*(?:[,.\s]\d{2})\s*(?:€|CHF|PLN|zł|zł\.?|₺|£|\$)?"
)
PAGE_PRICES = [
    r"""(?i)<meta[^>]+property=["']product:price:amount["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)itemprop=["']price["'][^>]+content=["']([^"']+)["']""",
    r"""(?is)<span[^>]+itemprop=["']price["'][^>]*>(.*?)</span>""",
    r"""(?i)"price"\s*:\s*"([^"]+)\"""",
    r"(?i)(?:€|\bEUR\b)\s*([0-9][0-9.,]*)",
    r"(?i)([0-9][0-9.,]*)\s*(?:€|\bEUR\b)",
]


def price_numeric(c: Column) -> Column:
    """The number in a price: the later of comma and full stop is the decimal mark; null if it is no number."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^\d.,-]", "")
    dot, comma = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
    last_dot = F.when(F.contains(s, F.lit(".")), dot).otherwise(-1)
    last_comma = F.when(F.contains(s, F.lit(",")), comma).otherwise(-1)
    continental = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    number = F.when(last_comma > last_dot, continental).otherwise(F.replace(s, F.lit(","), F.lit("")))
    return F.when(number.rlike(NUMBER), number.try_cast("double"))


def price_generic(c: Column) -> Column:
    """struct<price string, currency string> of the last number in a text; '' for what is missing."""
    s = clean_text(c)
    mark = F.upper(F.regexp_extract(s, CURRENCY, 1))
    currency = mark
    for sign, code in CURRENCY_CODES.items():
        currency = F.when(mark == sign, code).otherwise(currency)
    tokens = F.filter(F.split(F.regexp_replace(s, r"[^0-9,.\-]", " "), r"\s+"), lambda t: t != "")
    good = F.filter(tokens, lambda t: t.rlike(GROUPED) | t.rlike(PLAIN))
    last = F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(tokens, F.lit(-1)), F.lit(""))
    dots = F.length(last) - F.length(F.replace(last, F.lit("."), F.lit("")))
    number = (
        F.when(F.contains(last, F.lit(",")) & (dots == 0), F.regexp_replace(last, r"^([^,]*),", "$1."))
        .when(dots > 1, F.regexp_replace(last, r"\.(?=\d{3}(\D|$))", ""))
        .otherwise(last)
    )
    return F.struct(F.regexp_extract(number, r"(-?\d+(?:\.\d+)?)", 1).alias("price"), currency.alias("currency"))


def price_display(c: Column) -> Column:
    """The first euro price of a text with its sign; a cleaned text without a price stays as it is."""
    s = clean_text(c)
    hit = F.coalesce(*[blank(F.regexp_extract(s, p, 1)) for p in (EURO_BEFORE, EURO_AFTER, DECIMALS)])
    return F.when(hit.isNull(), s).when(F.contains(hit, F.lit("€")), hit).otherwise(F.concat(F.lit("€ "), hit))


def price_platform(text: Column, amount: Column | None = None) -> Column:
    """A data amount if there is one, else the first number with two decimals, with a full stop."""
    found = F.replace(F.regexp_extract(F.coalesce(text, F.lit("")), DECIMALS, 1), F.lit(","), F.lit("."))
    return found if amount is None else F.coalesce(blank(amount), found)


def price_in_card(text: Column) -> Column:
    """First price with a euro sign or code; null if there is none."""
    return blank(F.regexp_extract(F.coalesce(text, F.lit("")), CARD_PRICE, 1))


def price_from_page(html: Column) -> Column:
    """The price a page states, by the first of PAGE_PRICES that matches; null if none does."""
    h = F.coalesce(html, F.lit(""))
    return price_numeric(F.coalesce(*[blank(F.regexp_extract(h, p, 1)) for p in PAGE_PRICES], F.lit("")))


def price_prefix(c: Column) -> Column:
    """The leading number of a price without its euro sign; null if there is none."""
    s = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("€"), F.lit("")))
    return blank(F.regexp_extract(s, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1)).try_cast("double")
