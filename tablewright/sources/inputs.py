"""Readers of catalogues, seed lists, request bodies and raw page bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = "id string, name string, description string, url string, price string, sku string, params map<string,string>"
ROW_ALIASES = ("items", "products", "rows", "data", "list")
META_CHARSET = r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([a-z0-9_\-]+)"""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array file; a missing file, and what cannot be read, give no rows."""
    try:
        return spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], CATALOG_SCHEMA)
        raise


def seeds(lines: DataFrame) -> DataFrame:
    """url of each line (value) that is not blank and no comment."""
    return lines.select(F.trim("value").alias("url")).filter("url != '' AND NOT startswith(url, '#')")


def body_rows(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with pos and row (a map) for each entry of a JSON array, or of the first of ROW_ALIASES that is one."""
    rows = "array<map<string,string>>"
    parsed = F.from_json(body, "struct<" + ",".join(f"{a}:{rows}" for a in ROW_ALIASES) + ">")
    bare = F.when(F.ltrim(body).startswith("["), F.from_json(body, rows))
    return bodies.select("*", F.posexplode(F.coalesce(bare, *[parsed[a] for a in ROW_ALIASES])).alias("pos", "row"))


def first_html(preferred: DataFrame, fallback: DataFrame, key: str = "url") -> DataFrame:
    """key and html: the preferred source's where it is not empty, else the fallback's."""
    other = fallback.select(key, F.col("html").alias("_html"))
    joined = preferred.select(key, "html").join(other, key, "full_outer")
    return joined.select(key, F.coalesce(F.nullif("html", F.lit("")), F.col("_html"), F.lit("")).alias("html"))


def charset(forced: Column, content_type: Column, body: Column) -> Column:
    """Lower-case charset: a forced one, that of the content type, that of a meta tag in the first 4096 bytes, utf-8."""
    start = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    found = [
        F.nullif(forced, F.lit("")),
        F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([a-z0-9_\-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(F.coalesce(start, F.lit("")), META_CHARSET, 1), F.lit("")),
    ]
    name = F.lower(F.coalesce(*found, F.lit("utf-8")))
    return F.when(name.isin("ascii", "us-ascii", "utf8"), "utf-8").when(name.startswith("gb"), "gb18030").otherwise(name)


def decoded(body: bytes | None, name: str | None) -> str:
    """Text of bytes in a charset; where that is unknown or fails: utf-8, gb18030, then latin-1."""
    for kind in (name or "utf-8", "utf-8", "gb18030"):
        try:
            return (body or b"").decode(kind)
        except (LookupError, UnicodeDecodeError):
            continue
    return (body or b"").decode("latin-1")


def decode_bytes(body: Column, name: Column) -> Column:
    """Text of bytes in a charset, as by `decoded`."""

    @F.pandas_udf(T.StringType())
    def decode(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([decoded(b, n) for b, n in zip(bodies, names, strict=True)], dtype=object)

    return decode(body, name)


def append_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows as JSON lines under day=."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def write_artifacts(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Write governance artifacts as JSON lines under each run."""
    df.write.mode("append").partitionBy(run).json(path)


def page_scan(pages: DataFrame) -> DataFrame:
    """Stored pages with n, their number of characters; page_http (sources.http) reads pages by url instead."""
    return pages.withColumn("n", F.length("html"))


def day_metric(logs: DataFrame, ts: str, body: str, name: str) -> DataFrame:
    """By day, the sum of a number that JSON log bodies hold."""
    rows = logs.select(F.to_date(ts).alias("day"), F.get_json_object(body, f"$.{name}").cast("int").alias(name))
    return rows.groupBy("day").agg(F.sum(name).alias(name))


def families(lines: DataFrame) -> DataFrame:
    """pos, family_id, selector, fields of template families in JSON lines (value); what is no family gives none."""
    kind = "struct<pos:int,family_id:string,selector:string,fields:array<string>>"
    return lines.select(F.from_json("value", kind).alias("x")).select("x.*").filter("family_id IS NOT NULL")


def probe(spark: SparkSession, version: int = 1) -> DataFrame:
    """One row that says that the library answers."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(version).alias("version"))
