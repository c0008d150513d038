"""Url functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts of catalogue pages.
CATALOG_PATHS = [
    "/catalog/", "/katalog/", "/produkte/", "/product-catalog/", "/category/", "/categories/", "/collection/", "/collections/", "/shop/",
    "/waren/", "/produkt/",
]
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def origin(url: Column) -> Column:
    """Scheme and authority, lower case; '' if the url has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), ORIGIN, 1))


def host(url: Column) -> Column:
    """Host without port, lower case; '' if the url has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path(url: Column) -> Column:
    """Path of an absolute url; '/' if it is empty, '' for other strings."""
    u = F.coalesce(url, F.lit(""))
    found = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(~u.rlike(ORIGIN), "").when(found == "", "/").otherwise(found)


def absolutize(href: Column, base: Column) -> Column:
    """href resolved against base for absolute, protocol-relative, root-relative, query, fragment and plain relative forms.

    Paths with dot segments need resolve_url, which runs in Python.
    """
    h, b = F.trim(F.coalesce(href, F.lit(""))), F.coalesce(base, F.lit(""))
    top, bare = F.regexp_extract(b, ORIGIN, 1), F.regexp_replace(b, r"#.*$", "")
    folder = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*((?:/[^/?#]*)*/)", 1)
    return (
        F.when(h == "", bare)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(top, h))
        .when(h.startswith("#"), F.concat(bare, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h))
        .when(folder == "", F.concat(top, F.lit("/"), h))
        .otherwise(F.concat(top, folder, h))
    )


def strip_query(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")


def strip_fragment(url: Column) -> Column:
    """Without fragment."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")


def same_origin(a: Column, b: Column) -> Column:
    """True if both are absolute urls of one scheme and authority."""
    return (origin(a) == origin(b)) & (origin(a) != "")


def is_deep_catalog(url: Column) -> Column:
    """A catalogue word in the path, and three path segments or more."""
    p = F.lower(path(url))
    hit = p.rlike("|".join(CATALOG_PATHS))
    return hit & (F.size(F.filter(F.split(p, "/"), lambda x: x != "")) >= 3)


def page_number(url: Column) -> Column:
    """Number in ?page=, ?p= or ?seite=, else in /page/n; null if there is none."""
    u = F.lower(F.coalesce(url, F.lit("")))
    for_query = F.regexp_extract(u, r"[?&](?:page|p|seite)=(\d{1,9})(?:[&#]|$)", 1)
    for_path = F.regexp_extract(u, r"/page/(\d{1,9})(?:[/?#]|$)", 1)
    return F.coalesce(F.nullif(for_query, F.lit("")), F.nullif(for_path, F.lit(""))).cast("int")


def last_segment(url: Column) -> Column:
    """The last path segment, without .htm, .html or .php."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"(?i)\.(html?|php)$", "")
