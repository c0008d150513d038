"""Image references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import blank

# Patterns of image references.
PLACEHOLDER = r"(?i)loader\.svg|placeholder|spacer\.gif|logo|transparent|imagecache"
IMAGE_LINK = r"""(?i)(https?://[^\s"'<>]+?\.(?:jpe?g|png|webp|gif))"""
EXTENSIONS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "webp": "png"}


def srcset_urls(c: Column) -> Column:
    """Urls of a srcset, in order."""
    urls = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.regexp_extract(F.trim(x), r"^(\S+)", 1))
    return F.filter(urls, lambda x: x != "")


def widest(c: Column) -> Column:
    """The url with the largest width of a srcset; the later of equals; null for an empty one."""
    parts = F.transform(
        F.split(F.coalesce(c, F.lit("")), ","),
        lambda x, i: F.struct(
            F.coalesce(blank(F.regexp_extract(x, r"\s(\d{1,9})w", 1)).cast("int"), F.lit(0)).alias("w"),
            i.alias("i"),
            F.regexp_extract(F.trim(x), r"^(\S+)", 1).alias("u"),
        ),
    )
    return F.array_max(F.filter(parts, lambda p: p["u"] != ""))["u"]


def best_image(candidates: Column) -> Column:
    """First jpg, png or gif that is no placeholder, else first that is none, else the first; webp becomes jpg."""
    some = F.filter(candidates, lambda x: F.coalesce(x, F.lit("")) != "")
    real = F.filter(some, lambda x: ~x.rlike(PLACEHOLDER))
    raster = F.filter(real, lambda x: x.rlike(r"(?i)\.(jpe?g|png|gif)(\?|$)"))
    pick = F.coalesce(F.get(raster, F.lit(0)), F.get(real, F.lit(0)), F.get(some, F.lit(0)), F.lit(""))
    return F.regexp_replace(pick, r"(?i)\.webp(\?|$)", r".jpg$1")


def image_extension(c: Column) -> Column:
    """File type for an extension: jpeg unless it is png, gif or webp (png)."""
    x, out = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("jpeg")
    for name, kind in EXTENSIONS.items():
        out = F.when(x == name, kind).otherwise(out)
    return out


def image_links(html: Column) -> Column:
    """Distinct absolute image urls in a page, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(IMAGE_LINK), F.lit(1)))


def data_url(content: Column, kind: Column) -> Column:
    """content (binary) as a data url of an image type."""
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))


def by_width(urls: Column) -> Column:
    """Image urls by the width that their names give, widest first, then in their order; unknown widths last."""
    width = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"_(\d+)x", 1), F.lit("")).cast("int"), F.lit(0))
    ranked = F.transform(urls, lambda u, k: F.struct(width(u).alias("w"), (-k).alias("k"), u.alias("u")))
    return F.transform(F.sort_array(ranked, False), lambda z: z["u"])
