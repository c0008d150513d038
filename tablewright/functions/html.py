"""Pages as tables of nodes, and selectors as conditions on nodes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.selectors import selects as selects

NODE_SCHEMA = "page_id long, node int, last int, parent int, depth int, tag string, attrs map<string,string>, text string"
#: Characters of text after which a table of nodes is handed on; a node's text is never cut.
PART_CHARS = 4_000_000
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Nodes(HTMLParser):
    """Collects [parent, depth, tag, attrs, start, end] in page order; the page's text from start to end is the node's."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.size = 0

    def shut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for i in self.open[k:]:
            self.nodes[i][5] = self.size
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[k]][2]
            if name in CLOSES.get(tag, ()):
                self.shut(k)
            elif name in ("ul", "ol", "table", "dl", "select", "div"):
                break
        self.nodes.append([self.open[-1] if self.open else -1, len(self.open), tag, {k: v or "" for k, v in attrs}, self.size, self.size])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][2] == tag:
                self.shut(k)
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.nodes[self.open[-1]][2] not in ("script", "style"):
            self.pieces.append(data)
            self.size += len(data)


def page_nodes(html: str | None) -> Iterator[tuple]:
    """(node, last, parent, depth, tag, attrs, text) of a page's elements; last is the last node inside."""
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    parser.shut(0)
    whole = "".join(parser.pieces)
    last = list(range(len(parser.nodes)))
    for i in range(len(parser.nodes) - 1, -1, -1):
        parent = parser.nodes[i][0]
        if parent >= 0:
            last[parent] = max(last[parent], last[i])
    for i, (p, d, tag, attrs, start, end) in enumerate(parser.nodes):
        yield i, last[i], p, d, tag, attrs, " ".join(whole[start:end].split())


def html_nodes(pages: DataFrame) -> DataFrame:
    """One row for each element of each page (page_id, html), with the whole text inside it."""
    columns = ["page_id", "node", "last", "parent", "depth", "tag", "attrs", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows, chars = [], 0
            for i, h in zip(part["page_id"], part["html"], strict=True):
                for n in page_nodes(h):
                    rows.append((int(i), *n))
                    chars += len(n[-1])
                    if chars >= PART_CHARS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, chars = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("page_id", "html").mapInPandas(run, NODE_SCHEMA)


def visible() -> Column:
    """Condition on a node row: it has text and is not hidden."""
    style = F.replace(F.lower(F.coalesce(F.col("attrs")["style"], F.lit(""))), F.lit(" "), F.lit(""))
    hidden = F.col("attrs")["hidden"].isNotNull() | (F.col("attrs")["aria-hidden"] == "true") | F.contains(style, F.lit("display:none"))
    return (F.coalesce("text", F.lit("")) != "") & ~F.coalesce(hidden, F.lit(False))


def node_url() -> Column:
    """href of a node, else src."""
    return F.coalesce(F.col("attrs")["href"], F.col("attrs")["src"], F.lit(""))


_LD = re.compile(r"<script[^>]+application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def _walk(x: object) -> Iterator[dict]:
    if isinstance(x, list):
        for y in x:
            yield from _walk(y)
    elif isinstance(x, dict):
        yield x
        for y in x.values():
            yield from _walk(y)


def _text(x: object) -> str:
    if isinstance(x, list):
        return _text(x[0]) if x else ""
    if isinstance(x, dict):
        return _text(x.get("url") or x.get("@id") or x.get("name"))
    return "" if x is None else str(x).strip()


def ld_price(offers: object) -> tuple[str, str]:
    """(price, currency) of offers: price, lowPrice, highPrice or priceSpecification.price, with a full stop."""
    for o in _walk(offers):
        spec = o.get("priceSpecification")
        spec = spec[0] if isinstance(spec, list) and spec else spec
        for v in (o.get("price"), o.get("lowPrice"), o.get("highPrice"), spec.get("price") if isinstance(spec, dict) else None):
            m = re.search(r"-?\d[\d.,]*", str(v)) if v not in (None, "") else None
            if m:
                s = m[0]
                s = s.replace(".", "").replace(",", ".") if "," in s and s.rfind(",") > s.rfind(".") else s.replace(",", "")
                return s, _text(o.get("priceCurrency"))
    return "", ""


def ld_products(html: str | None) -> list[tuple]:
    """(name, sku, price, currency, url, image) of the products in a page's JSON-LD; bad JSON is skipped."""
    out = []
    for block in _LD.findall(html or ""):
        try:
            data = json.loads(block)
        except ValueError:
            continue
        for x in _walk(data):
            kind = x.get("@type")
            kinds = kind if isinstance(kind, list) else [kind]
            if any("product" in str(k).lower() for k in kinds):
                price, currency = ld_price(x.get("offers"))
                sku = next((_text(y.get(k)) for y in _walk(x) for k in ("sku", "mpn", "productID") if _text(y.get(k))), "")
                out.append((_text(x.get("name")), sku, price, currency, _text(x.get("url")), _text(x.get("image"))))
    return out


def jsonld_rows(pages: DataFrame) -> DataFrame:
    """page_id, pos and the fields of every product in the pages' JSON-LD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(int(i), k, *p) for i, h in zip(part["page_id"], part["html"], strict=True) for k, p in enumerate(ld_products(h))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "name", "sku", "price", "currency", "url", "image"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, name string, sku string, price string, currency string, url string, image string")
