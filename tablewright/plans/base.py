"""How queries read the tables, and the inputs they render from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables it names in braces; other braces stand for themselves."""
    named = [t for t in TABLES if "{" + t + "}" in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in named:
        sql = sql.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in named})


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file, dealt to all cores: parsing costs far more than the shuffle of what one file holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def duck(sql: str) -> str:
    """The same sql for an engine in which the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


CENTS = """
SELECT p_partkey, p_name, p_brand, p_type, p_size, c, CAST(CAST(floor(c / 100) AS BIGINT) AS STRING) AS e,
  lpad(CAST(c % 100 AS STRING), 2, '0') AS r
FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM {part}) q
"""

#: Prices in the notations that shops use.
PRICES = f"""
SELECT p_partkey, CASE p_partkey % 16
  WHEN 0 THEN e || ',' || r || ' €' WHEN 1 THEN '€' || e || '.' || r WHEN 2 THEN 'EUR ' || e
  WHEN 3 THEN '1.' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ',' || r || ' €'
  WHEN 4 THEN '€1,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '.' || r
  WHEN 5 THEN '-' || e || ',5' WHEN 6 THEN '12.345.' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')
  WHEN 7 THEN '12-' || e WHEN 8 THEN 'on request' WHEN 9 THEN '1,234,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')
  WHEN 10 THEN 'UVP ' || e || ',99 €  jetzt ' || e || ',' || r || ' €' WHEN 11 THEN 'CHF ' || e || '.' || r
  WHEN 12 THEN '' WHEN 13 THEN CAST(NULL AS STRING) WHEN 14 THEN '$' || e || '.' || r ELSE '  ab ' || e || '.' || r || ' GBP ' END AS s
FROM ({CENTS}) t
"""

#: Product titles with and without codes.
TITLES = """
SELECT p_partkey, CASE p_partkey % 9
  WHEN 0 THEN p_name WHEN 1 THEN 'SKU-' || CAST(10000 + p_partkey AS STRING) || '  ' || p_name
  WHEN 2 THEN p_name || ' ' || CAST(1000 + p_partkey AS STRING) WHEN 3 THEN 'Home ' || p_name || ' in den Warenkorb'
  WHEN 4 THEN upper(p_name) || ' AB12-' || CAST(100 + p_partkey AS STRING) WHEN 5 THEN 'Zu den Bewertungen: ' || p_name
  WHEN 6 THEN 'Artikel-Nr.: ABC-' || CAST(1000 + p_partkey AS STRING) || ', EAN 4006381333931, P/N: 90MB1A50-M0EAY' || CAST(p_partkey % 10 AS STRING)
  WHEN 7 THEN '' ELSE CAST(NULL AS STRING) END AS t,
  CASE p_partkey % 7
  WHEN 0 THEN 'https://shop.example/products/item-' || CAST(p_partkey AS STRING)
  WHEN 1 THEN 'https://shop.example/catalog/tools/10-' || lpad(CAST(p_partkey % 100000 AS STRING), 5, '0') || '.html'
  WHEN 2 THEN 'http://shop.example/cart?item=' || CAST(p_partkey AS STRING) || '#top'
  WHEN 3 THEN 'https://shop.example/p/' || CAST(p_partkey AS STRING) || '/?page=' || CAST(p_partkey % 40 AS STRING)
  WHEN 4 THEN 'https://shop.example/hilfe/versand.pdf' WHEN 5 THEN 'https://shop.example/products/x/reviews#reviews'
  ELSE 'https://shop.example/list/page/' || CAST(p_partkey % 30 AS STRING) END AS u,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN CAST(p_partkey % 1000 AS STRING)
    WHEN p_partkey % 5 = 2 THEN CAST(NULL AS STRING) ELSE 'AX-' || CAST(1000 + p_partkey AS STRING) END AS k
FROM {part}
"""
