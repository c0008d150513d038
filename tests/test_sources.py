import http.server
import re
import threading
import zipfile
from xml.etree import ElementTree

import duckdb
from pyspark.sql import functions as F

from tablewright.plans import more_queries
from tablewright.sources import exports, http as pages, inputs


def test_xlsx_and_pdf_sinks(spark, tmp_path):
    spark.dataSource.register(exports.XlsxSink)
    spark.dataSource.register(exports.PdfSink)
    df = spark.createDataFrame([(i, f"n<{i}>", None if i % 3 else i / 2) for i in range(50)], "i int, name string, price double")
    df.repartition(2).write.format("xlsx").option("headers", "#|Name|Price").mode("append").save(str(tmp_path / "x"))
    files = list((tmp_path / "x").glob("*.xlsx"))
    assert len(files) == 2
    names = []
    for f in files:
        with zipfile.ZipFile(f) as z:
            root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
            names += [t.text for t in root.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}t")]
    assert sorted(n for n in names if n.startswith("n<")) == sorted(f"n<{i}>" for i in range(50))
    df.coalesce(1).write.format("pdf_table").mode("append").save(str(tmp_path / "p"))
    (one,) = (tmp_path / "p").glob("*.pdf")
    data = one.read_bytes()
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF") and data.count(b"/Type/Page/") == 2


def pdf_text(data):
    """The text of a PDF's pages, line by line, and its links."""
    out = []
    for stream in re.findall(rb"stream\n(.*?)\nendstream", data, re.S):
        for line in stream.split(b"T*")[:-1]:
            text = ""
            for font, plain, wide in re.findall(rb"/F(\d) \d+ Tf (?:\(((?:[^\\()]|\\.)*)\)|<([0-9a-f]*)>) Tj", line, re.S):
                text += re.sub(rb"\\(.)", rb"\1", plain).decode("cp1252") if font == b"1" else bytes.fromhex(wide.decode()).decode("utf-16-be")
            out.append(text)
    return out, [re.sub(rb"\\(.)", rb"\1", u).decode() for u in re.findall(rb"/URI\(((?:[^\\()]|\\.)*)\)", data)]


def test_pdf_keeps_every_character():
    rows = [(1, "€ 12,50 (netto)", "https://shop.example/a(1)"), (2, "报价单 — 价格 ¥9,99", None), (3, "Größe \\ ›x‹ ł Ж 𝄞", ""), (4, "lang " * 100 + "Ende", None), (5, "two\nlines", None)]
    data = exports.pdf(iter(rows), ["#", "名称", "Link"])
    lines, links = pdf_text(data)
    assert lines[0] == "#  |  名称  |  Link"
    assert lines[1:4] == ["1  |  € 12,50 (netto)  |  https://shop.example/a(1)", "2  |  报价单 — 价格 ¥9,99  |  ", "3  |  Größe \\ ›x‹ ł Ж 𝄞  |  "]
    assert "".join(lines[4:-1]) == "4  |  " + "lang " * 100 + "Ende  |  " and len(lines) == 8
    assert lines[-1] == "5  |  two lines  |  " and links == ["https://shop.example/a(1)"]
    # Every object is where the table of places says.
    places = [int(p) for p in re.findall(rb"(\d{10}) 00000 n", data)]
    assert all(data[p:].startswith(b"%d 0 obj" % (k + 1)) for k, p in enumerate(places)) and data[int(re.search(rb"startxref\n(\d+)", data)[1]) :].startswith(b"xref")
    assert pdf_text(exports.pdf(iter([]), ["a"])) == (["a"], [])
    assert len(pdf_text(exports.pdf(iter([(i,) for i in range(95)]), ["a"]))[0]) == 98


def test_printed_lines_do_not_hang_on_how_rows_are_dealt(spark):
    rows = [(1, 5, f"n{i:02}", "b" if i % 2 else "a") for i in range(60)] + [(1, None, "m", "a"), (1, 4, "z", "z"), (1, 6, None, "a")]
    for dealt in (rows, rows[::-1]):
        got = exports.table_lines(spark.createDataFrame(dealt, "g int, pos int, name string, kind string").coalesce(1), "g", "pos", ["kind", "name"]).orderBy("idx").collect()
        assert [r.line for r in got] == ["1  |  z  |  z", *[f"{k + 2}  |  {x}  |  {n}" for k, (x, n) in enumerate(sorted((r[3], r[2]) for r in rows[:60]))], None, "63  |  a  |  m"]
        assert [r.page for r in got] == [1] * 40 + [2] * 23


def test_pdf_cells_of_null_keys_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    # At most one null in an order: where two are at one place, the SQL leaves open which comes first.
    con.execute("""CREATE VIEW lineitem AS SELECT * REPLACE (CASE WHEN n = 2 AND l_orderkey % 3 = 0 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN n = 2 AND l_orderkey % 3 = 1 THEN NULL ELSE l_linenumber END AS l_linenumber)
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM read_parquet('/root/testdata/sf0.001/lineitem.parquet'))""")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = con.execute(more_queries.SQL["o06_pdf_cells"]).fetchall()
    assert sum(line is None for *_, line in want) > 100
    got = more_queries.QUERIES["o06_pdf_cells"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "c.json"
    assert inputs.read_catalog(spark, str(path)).count() == 0
    path.write_text('[{"id":"1","name":"n","params":{"a":"b"}},{"id":"2"}]')
    rows = inputs.read_catalog(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.name, r.params) for r in rows] == [("1", "n", {"a": "b"}), ("2", None, None)]
    path.write_text("{not json")
    assert inputs.read_catalog(spark, str(path)).filter("id IS NOT NULL").count() == 0


def test_bytes_are_decoded_by_their_charset(spark):
    body = '<meta charset="gb2312">名'
    df = spark.createDataFrame([(body.encode("gb18030"), None), ("é".encode("latin-1"), "text/html; charset=iso-8859-1"), (b"\xff\xfe\xfa", None), (None, None)], "b binary, t string")
    got = df.select(inputs.decode_bytes(F.col("b"), inputs.charset(F.lit(None).cast("string"), F.col("t"), F.col("b"))).alias("s")).collect()
    assert [r.s for r in got][:2] == [body, "é"] and got[3].s == ""


def test_http_pages(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        hits = 0

        def do_GET(self):
            Handler.hits += self.path == "/flaky"
            ok = self.path == "/ok" or (self.path == "/flaky" and Handler.hits > 1)
            self.send_response(200 if ok else 503 if self.path == "/flaky" else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>x</p>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(pages.PageSource)
    df = spark.read.format("page_http").option("urls", f"{top}/ok\n{top}/flaky\n{top}/none\nbad").option("batch", "2").option("wait", "0.01").load()
    rows = {r.url.removeprefix(top): r.status for r in df.collect()}
    server.shutdown()
    assert rows == {"/ok": 200, "/flaky": 200, "/none": 404, "bad": 0}
