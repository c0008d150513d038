"""Spark data sinks `xlsx` and `pdf_table`, and the export projections.

Every task writes a file of its own for its rows, so that an export has as many parts as the DataFrame has partitions;
repartition(1) gives one file where the rows are few enough for a single task. The path must be reachable from all executors.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from unicodedata import east_asian_width
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tablewright.functions.ids import item_number
from tablewright.functions.prices import price_numeric
from tablewright.functions.text import pick_first
from tablewright.operators.relational import row_index

# Headers of the seven-column export by language.
HEADERS_7 = {
    "en": ["#", "Item No.", "Picture", "Description", "MOQ", "Unit Price", "Link"],
    "de": ["#", "Artikelnummer", "Bild", "Beschreibung", "MOQ", "Stückpreis", "Link"],
    "zh": ["#", "货号", "图片", "描述", "起订量", "单价", "链接"],
}


def column_name(k: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet(rows: Iterator[tuple], headers: list[str]) -> bytes:
    """A workbook with one sheet: a frozen header with a filter, numbers as numbers, other values as inline strings."""

    def cell(r: int, k: int, v: object) -> str:
        at = f"{column_name(k)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body, n = io.StringIO(), 1
    body.write('<row r="1">' + "".join(cell(1, k, h) for k, h in enumerate(headers)) + "</row>")
    for row in rows:
        n += 1
        body.write(f'<row r="{n}">' + "".join(cell(n, k, v) for k, v in enumerate(row)) + "</row>")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Export" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
        f'<sheetData>{body.getvalue()}</sheetData><autoFilter ref="A1:{column_name(len(headers) - 1)}{n}"/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


#: A4 across: width, height, margin, size of letters and lines, in points.
WIDE, HIGH, EDGE, LETTER, LINE = 842, 595, 30, 8, 12


def _escaped(text: bytes) -> bytes:
    return text.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")


def _runs(text: str) -> Iterator[tuple[bool, str]]:
    """Stretches of a text that the first font has (Windows-1252), and of what only the second has."""
    for own, part in groupby(text, lambda ch: ch.encode("cp1252", "ignore") != b""):
        yield own, "".join(part)


def _width(ch: str) -> float:
    """About how wide a character is, in points: half a letter's size, or all of it for wide scripts."""
    return LETTER * (1.0 if east_asian_width(ch) in "WF" else 0.5)


def _wrapped(text: str) -> list[str]:
    """The lines that a text takes; none is wider than the page, and nothing is cut off."""
    out, now, width = [], [], 0.0
    for ch in "".join(" " if c in "\n\r\t" else c for c in text):
        if width + _width(ch) > WIDE - 2 * EDGE:
            out.append("".join(now))
            now, width = [], 0.0
        now.append(ch)
        width += _width(ch)
    return [*out, "".join(now)]


def pdf(rows: Iterator[tuple], headers: list[str], per_page: int = 40) -> bytes:
    """A PDF of text lines, per_page of them a page below the headers; rows wider than a page go on in the next line, and cells that hold a web address are links.

    Text of Windows-1252 is set in Helvetica, all else (Chinese, say) as UTF-16 in the reader's own Song font, so that every character can be read back.
    """
    lines: list[tuple[str, str | None]] = []
    for r in rows:
        cells = ["" if v is None else str(v) for v in r]
        link = next((c for c in cells if c.startswith(("http://", "https://"))), None)
        lines += [(part, link) for part in _wrapped("  |  ".join(cells))]
    pages = [lines[a : a + per_page] for a in range(0, len(lines), per_page)] or [[]]
    objects: list[bytes] = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
        b"<</Type/Font/Subtype/Type0/BaseFont/STSong-Light/Encoding/UniGB-UTF16-H/DescendantFonts[5 0 R]>>",
        b"<</Type/Font/Subtype/CIDFontType0/BaseFont/STSong-Light/CIDSystemInfo<</Registry(Adobe)/Ordering(GB1)/Supplement 4>>/FontDescriptor 6 0 R>>",
        b"<</Type/FontDescriptor/FontName/STSong-Light/Flags 6/FontBBox[-25 -254 1000 880]/ItalicAngle 0/Ascent 880/Descent -120/CapHeight 880/StemV 93>>",
    ]
    kids = []
    for page in pages:
        text, links = [b"BT %d TL %d %d Td" % (LINE, EDGE, HIGH - EDGE)], []
        for k, (line, link) in enumerate([("  |  ".join(headers), None), *page]):
            for own, part in _runs(line):
                shown = b"(%s)" % _escaped(part.encode("cp1252")) if own else b"<%s>" % part.encode("utf-16-be", "surrogatepass").hex().encode()
                text.append(b"/F%d %d Tf %s Tj" % (1 if own else 2, LETTER, shown))
            text.append(b"T*")
            if link:
                top = HIGH - EDGE - LINE * k + LETTER
                links.append(b"<</Type/Annot/Subtype/Link/Border[0 0 0]/Rect[%d %d %d %d]/A<</S/URI/URI(%s)>>>>" % (EDGE, top - LINE, WIDE - EDGE, top, _escaped(link.encode("utf-8"))))
        stream = b"\n".join([*text, b"ET"])
        kids.append(len(objects) + 1)
        more = b"/Annots[%s]" % b"".join(links) if links else b""
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Resources<</Font<</F1 3 0 R/F2 4 0 R>>>>/Contents %d 0 R%s>>" % (WIDE, HIGH, len(objects) + 2, more))
        objects.append(b"<</Length %d>>stream\n%s\nendstream" % (len(stream), stream))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for k, o in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj%sendobj\n" % (k, o))
    at = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1))
    out.write(b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, at))
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class _FileWriter(DataSourceWriter):
    suffix, render = "", staticmethod(sheet)

    def __init__(self, path: str, headers: list[str]) -> None:
        self.path, self.headers = path, headers

    def write(self, iterator: Iterator) -> Written:
        rows = [tuple(r) for r in iterator]
        os.makedirs(self.path, exist_ok=True)
        at = os.path.join(self.path, f"part-{uuid.uuid4().hex}{self.suffix}")
        with open(at + ".tmp", "wb") as f:
            f.write(self.render(iter(rows), self.headers))
        return Written(at, len(rows))

    def commit(self, messages: list) -> None:
        for m in messages:
            os.replace(m.path + ".tmp", m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path + ".tmp"):
                os.remove(m.path + ".tmp")


class XlsxWriter(_FileWriter):
    suffix, render = ".xlsx", staticmethod(sheet)


class PdfWriter(_FileWriter):
    suffix, render = ".pdf", staticmethod(pdf)


class XlsxSink(DataSource):
    """df.write.format("xlsx").mode("append").save(path); option headers: names parted by '|'."""

    writer_class = XlsxWriter

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        headers = self.options.get("headers")
        return self.writer_class(self.options["path"], headers.split("|") if headers else list(schema.names))


class PdfSink(XlsxSink):
    """As XlsxSink, for tables as PDF text."""

    writer_class = PdfWriter

    @classmethod
    def name(cls) -> str:
        return "pdf_table"


def export_3(df: DataFrame) -> DataFrame:
    """title, link, image."""
    return df.select(pick_first(F.col("title")).alias("title"), pick_first(F.col("url"), F.col("link")).alias("link"), pick_first(F.col("img")).alias("image"))


def export_7(df: DataFrame) -> DataFrame:
    """idx, item_no, picture, description, moq, unit_price, link; unit_price is a number or null."""
    link = pick_first(F.col("url"), F.col("link"))
    return df.select(
        F.col("idx"), item_number(F.col("sku"), link, F.col("title")).alias("item_no"), pick_first(F.col("img")).alias("picture"),
        pick_first(F.col("desc"), F.col("title")).alias("description"), pick_first(F.col("moq")).alias("moq"),
        price_numeric(F.col("price")).alias("unit_price"), link.alias("link"),
    )


def export_15(df: DataFrame) -> DataFrame:
    """The wide export: the product columns, ids and images joined by ' | '."""
    names = ["sku", "title", "price", "currency", "moq", "url", "link", "img", "desc", "ean", "mpn", "brand", "adapter", "page_url"]
    have = [pick_first(F.col(n)).alias(n) if n in df.columns else F.lit("").alias(n) for n in names]
    images = F.array_join("imgs", " | ").alias("images") if "imgs" in df.columns else F.lit("").alias("images")
    return df.select(*have, images)


def table_lines(df: DataFrame, group: str, pos: str, columns: list[str], lines: int = 40) -> DataFrame:
    """group, idx, page and line: the lines of a printed table, `lines` to a page. Null places come last, rows at one place by their cells; a line with a null cell is null, as with || in SQL."""
    cells = [F.col(name).cast("string") for name in columns]
    rows = row_index(df, [key.asc_nulls_last() for key in (F.col(pos), *cells)], [group])
    text = F.concat(F.col("idx").cast("string"), *[part for cell in cells for part in (F.lit("  |  "), cell)])
    return rows.select(group, "idx", (F.floor((F.col("idx") - 1) / lines) + 1).cast("int").alias("page"), text.alias("line"))


def payloads(df: DataFrame, by: str) -> DataFrame:
    """By group: ok, count, and the rows as a JSON array under the names items and products. A group is one answer to a request."""
    row = F.struct(*[c for c in df.columns if c != by])
    out = df.groupBy(by).agg(F.count("*").alias("count"), F.to_json(F.collect_list(row)).alias("items"))
    return out.withColumns({"ok": F.lit(True), "products": F.col("items")})
