import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import html, ids, prices, text, urls


def values(spark, column, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    return [r.v for r in df.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


def test_price_vectors(spark):
    cases = ["1.299,95 €", "€1,299.95", "9,99", "1.299", "-5,5", "EUR 10", "12.345.678", "12-3", "abc", "1,234,567", None, ""]
    assert values(spark, prices.price_numeric, cases) == [1299.95, 1299.95, 9.99, 1.299, -5.5, 10.0, None, None, None, None, None, None]
    cases = ["19,99 €", "UVP 29,99 € jetzt 19,99 €", "CHF 12.50", "1.234.567", "1.299,95 €", "$1,234.56"]
    got = values(spark, prices.price_generic, cases)
    assert [(g.price, g.currency) for g in got] == [("19.99", "EUR"), ("19.99", "EUR"), ("12.50", "CHF"), ("1234567", ""), ("1.299", "EUR"), ("1", "USD")]


def test_ean_vectors(spark):
    assert values(spark, ids.ean13, ["4006381333931", "4711081599999", "4006381333932", None]) == [True, True, False, False]
    assert values(spark, ids.ean8_reference, ["96385074", "73513537"]) == [True, False]
    assert values(spark, ids.ean8_gs1, ["96385074", "73513537"])[1] is True


def test_rolling_hash(spark):
    assert values(spark, text.rolling_hash, ["abc", ""]) == ["17862", "0"]


def test_no_break_space_is_white_space(spark):
    assert values(spark, text.clean_text, [" a  b\n", None]) == ["a b", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=20))
def test_written_prices_are_read_back(spark, cents):
    cases = [f"{c // 100:,}".replace(",", ".") + f",{c % 100:02d} €" for c in cents]
    assert values(spark, prices.price_numeric, cases) == [pytest.approx(c / 100) for c in cents]


def test_absolutize(spark):
    df = spark.createDataFrame([("/a", "https://x.example/b/c?d#e"), ("a", "https://x.example/b/c"), ("//y.example/", "http://x.example"), ("q", "https://x.example")], "h string, b string")
    got = [r.u for r in df.select(urls.absolutize(F.col("h"), F.col("b")).alias("u")).collect()]
    assert got == ["https://x.example/a", "https://x.example/b/a", "http://y.example/", "https://x.example/q"]


def test_nodes_and_implied_ends():
    nodes = html.page_nodes("<ul><li>one<li>two <b>x</b></ul><p>a<p>b<script>var x='<i>';</script>")
    assert [(n[3], n[4], n[6]) for n in nodes] == [(0, "ul", "onetwo x"), (1, "li", "one"), (1, "li", "two x"), (2, "b", "x"), (0, "p", "a"), (0, "p", "b"), (1, "script", "")]


def test_jsonld_prices():
    assert html.ld_price({"lowPrice": "1.299,95 €"}) == ("1299.95", "")
    assert html.ld_price([{"priceSpecification": [{"price": 5}], "priceCurrency": "EUR"}]) == ("5", "EUR")
    assert html.ld_products('<script type="application/ld+json">{"@type":["Product"],"name":"n","offers":[{"price":0}],"isRelatedTo":{"sku":"s"}}</script>') == [("n", "s", "0", "", "", "")]
