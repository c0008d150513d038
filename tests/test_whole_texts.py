from pyspark.sql import functions as F

from tablewright.functions.html import html_nodes
from tablewright.operators import extract
from tablewright.streaming import diagnostics

LONG = "word and word " * 1000


def test_texts_of_long_pages_are_whole(spark):
    html = f"<html><body><h1>T</h1><div itemprop='description'><p>{LONG}</p><p>the end</p></div><p>Bestellnummer: T-4711</p><script>no</script></body></html>"
    nodes = html_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).cache()
    body = " ".join(LONG.split())
    texts = {r.tag: r.text for r in nodes.filter("tag in ('html', 'div')").collect()}
    assert texts == {"html": f"T{body} the endBestellnummer: T-4711", "div": f"{body} the end"}
    assert extract.document_sku(nodes).first().sku == "T-4711"
    assert extract.detail_fields(nodes).first().desc == f"{body} the end"


def test_deep_pages_are_handed_on_in_parts(spark):
    html = "<div>" * 400 + LONG + "</div>" * 400
    nodes = html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert nodes.agg(F.count("*").alias("n"), F.min(F.length("text")).alias("m")).first() == (400, len(LONG) - 1)


def test_messages_are_whole(spark):
    df = spark.createDataFrame([("x" * 999 + "\n\ny",)], "e string")
    assert diagnostics.captured(df, "e").first().message == "x" * 999 + " y"
