"""Quotes: rows, totals, labels and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels by language.
HEADERS = {
    "de": ["#", "Name", "SKU", "Preis", "MOQ", "Parameter"],
    "en": ["#", "Name", "SKU", "Price", "MOQ", "Params"],
    "zh": ["#", "名称", "SKU", "价格", "MOQ", "参数"],
}
BATTERY = {"de": "Batterie", "en": "Battery", "zh": "电池"}


def quote_number(c: Column) -> Column:
    """A number whose first comma is a decimal mark; 0 for what is none."""
    s = F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit("0"))), r"^([^,]*),", "$1.")
    return F.coalesce(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")), F.lit(0.0))


def quote_rows(df: DataFrame) -> DataFrame:
    """Trimmed names and skus, numbers, and params as a map."""
    return df.withColumns(
        {
            "name": F.trim(F.coalesce("name", F.lit(""))), "sku": F.trim(F.coalesce("sku", F.lit(""))),
            "price": quote_number(F.col("price")), "moq": quote_number(F.col("moq")),
            "params": F.coalesce(F.from_json("params_json", "map<string,string>"), F.create_map().cast("map<string,string>")),
        }
    )


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sum of price times the larger of 1 and moq, and the number of rows, by group."""
    amount = F.greatest(F.lit(1.0), F.when(F.col("moq") == 0, 1.0).otherwise(F.col("moq")))
    return rows.groupBy(*by).agg(F.sum(F.col("price") * amount).alias("total"), F.count("*").alias("n"))


def format_params(params: Column, lang: str) -> Column:
    """Battery and LEDs of a map in a language; '-' if there is neither."""
    pick = lambda *names: F.nullif(F.coalesce(*[F.try_element_at(params, F.lit(n)) for n in names]), F.lit(""))
    battery, leds = pick("battery", "Battery", "power"), pick("leds", "LEDs", "LED")
    tail = " 个" if lang == "zh" else ""
    text = F.concat_ws("；" if lang == "zh" else "; ", F.concat(F.lit(BATTERY[lang] + ": "), battery), F.concat(F.lit("LEDs: "), leds, F.lit(tail)))
    return F.when(text == "", "-").otherwise(text)


def fill_from_scrape(df: DataFrame) -> DataFrame:
    """Rows with name, sku, price and moq from scraped columns where they are empty, and params with what was scraped added."""
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    return df.withColumns(
        {
            "name": first("name", "scraped_title"), "sku": first("sku", "scraped_sku"),
            "price": F.coalesce(F.when(F.col("price") != 0, F.col("price")), quote_number(F.col("scraped_price"))),
            "params": F.map_concat(F.map_filter("params", lambda k, v: k != "scraped"), F.create_map(F.lit("scraped"), F.coalesce("scraped_title", F.lit("")))),
        }
    )
