"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the extraction rules.
CALLS_TO_ACTION = r"(?i)\b(add to cart|in den warenkorb|jetzt kaufen|buy now)\b"
NAVIGATION_IN_TITLES = r"(?i)\b(home|start|audio|video|strom|multimedia|b-run|solar)\b"
PUNCTUATION = r"""[_.,;:/\\()|\[\]{}"“”’'!?+\-*@#%^&=]+"""
TITLE_LIMIT, NEAR_LIMIT, PREVIEW_LIMIT = 140, 160, 600


def blank(c: Column) -> Column:
    """Null for the empty string, as a falsy-or chain skips it."""
    return F.nullif(c, F.lit(""))


def pick_first(*cs: Column) -> Column:
    """The first value that is neither null nor empty; '' if there is none."""
    return F.coalesce(*[blank(c) for c in cs], F.lit(""))


def clean_text(c: Column) -> Column:
    """White space (no-break spaces too) in runs of one, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def tokenize(c: Column) -> Column:
    """Lower-case words between punctuation and white space."""
    return F.filter(
        F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, " "), r"(?U)\s+"), lambda t: t != ""
    )


def selector_tokens(c: Column) -> Column:
    """Parts of a selector: letters, digits, underscores and hyphens."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_-]+"), lambda t: t != "")


def clean_title(c: Column) -> Column:
    """A title without calls to action and navigation words, cut at TITLE_LIMIT characters."""
    t = F.regexp_replace(clean_text(c), CALLS_TO_ACTION, "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, NAVIGATION_IN_TITLES, " "), r"(?U)\s+", " "))
    return F.trim(F.substring(t, 1, TITLE_LIMIT))


def near_text(c: Column) -> Column:
    """The first NEAR_LIMIT characters of the cleaned text."""
    return F.substring(clean_text(c), 1, NEAR_LIMIT)


def strip_markup(html: Column) -> Column:
    """Text of html: scripts, styles and tags removed, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style.*?</style>", " "), r"(?s)<[^>]+>", " ")
    return clean_text(t)


def contains_any(c: Column, words: list[str]) -> Column:
    """True if the lower-cased text holds any of the words; one pattern, which keeps generated code small."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(rf"\Q{w}\E" for w in words))


def rolling_hash(c: Column) -> Column:
    """h = h * 31 + code, modulo 2**32, in lower-case hex; for ASCII texts."""
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    step = lambda h, x: (h * 31 + F.ascii(x)).bitwiseAND(F.lit(4294967295))
    return F.lower(F.hex(F.aggregate(chars, F.lit(0).cast("long"), step)))


def tagged_sha256(c: Column) -> Column:
    """'sha256:' and the hex digest."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(c, F.lit("")), 256))
