"""Registered queries over files and pages made to reach one rule each; the SQL states the rule's outcome.

Every file or page carries values of a table's row, so rows can only be right if the rule acts on all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .operators import layout, quality
from .options import ParseOptions, RenderOptions
from .plans import render, sinks
from .queries import query, table
from .session import importable
from .sources import pdf
from .sources.pdf_writer import WriterOptions, write_pdf
from .streaming.ingest import page_events, until

BOX = (595, 842)
SPANS = "doc_id string, page int, span_ord int, text string, x float, y float, width float, font_size float, font_name string"


def _rows(spark: SparkSession, sf_dir: str, name: str, columns: list[str], make: Callable, schema: str) -> DataFrame:
    """make(row) gives rows of the schema for each row of a table."""

    importable(spark)
    shape = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for r in batch.to_pylist() for x in make(r)], shape)

    return table(spark, sf_dir, name, *columns).mapInArrow(run, schema)


def _files(spark, sf_dir, name, columns, make, options: ParseOptions | None = None) -> DataFrame:
    """Parsed files, one a row of a table: make(row) gives (pages, writer options)."""
    key = columns[0]
    made = _rows(spark, sf_dir, name, columns, lambda r: [{"doc_id": str(r[key]), "content": write_pdf(*make(r))}], "doc_id string, content binary")
    return pdf.parse_files(made, options)


def _spans(spark, sf_dir, name, columns, make) -> DataFrame:
    """A span table, one page a row of a table: make(row) gives (text, x, y, width, size) spans."""
    key = columns[0]
    return _rows(spark, sf_dir, name, columns, lambda r: [{"doc_id": str(r[key]), "page": 1, "span_ord": k, "text": t, "x": x, "y": y, "width": w, "font_size": s, "font_name": "F"} for k, (t, x, y, w, s) in enumerate(make(r))], SPANS)


def _key(name: str):
    return F.col("doc_id").cast("long").alias(name)


# ---- reading order


def _columns_page(r):
    """Items in columns of 120 points with 80 between them; pages of even keys have a wide title above."""
    k = r["p_partkey"]
    columns, titled = k % 3 + 1, k % 2 == 0
    items = [(f"c{c}r{i}", 50.0 + 200 * c, 700.0 - 14 * i, 120.0, 10.0) for i in range(k % 4 + 1) for c in range(columns)]
    return ([("title", 50.0, 780.0, 520.0, 10.0)] if titled else []) + items


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 + 1 AS n, p_partkey % 4 + 1 AS m, p_partkey % 2 = 0 AS t FROM part)
SELECT p_partkey, 'title' AS text, CAST(0 AS BIGINT) AS region FROM p WHERE t
UNION ALL SELECT p_partkey, 'c' || c || 'r' || i, CAST(c + CASE WHEN t THEN 1 ELSE 0 END AS BIGINT) FROM (SELECT *, unnest(range(0, n)) AS c FROM p), range(0, 4) AS g(i) WHERE i < m""")
def xycut_regions(spark, sf_dir):
    """Columns are read one after the other, below a title across them."""
    spans = _spans(spark, sf_dir, "part", ["p_partkey"], _columns_page)
    found = layout.regions_of_spans(spans, 60.0, 36.0).join(spans.select("doc_id", "span_ord", "text"), ["doc_id", "span_ord"])
    return found.select(_key("p_partkey"), "text", F.col("region").cast("long").alias("region"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 + 1 AS n, p_partkey % 4 + 1 AS m, p_partkey % 2 = 0 AS t FROM part),
l AS (SELECT p_partkey, -1 AS c, 0 AS i, 'title' AS text FROM p WHERE t UNION ALL SELECT p_partkey, c, i, 'c' || c || 'r' || i FROM (SELECT *, unnest(range(0, n)) AS c FROM p), range(0, 4) AS g(i) WHERE i < m)
SELECT p_partkey, string_agg(text, ' ' ORDER BY c, i) AS reading FROM l GROUP BY p_partkey""")
def page_reading_order(spark, sf_dir):
    """Lines of a page in reading order, by the thresholds that follow from its median size."""
    lines = layout.lines_of_spans(_spans(spark, sf_dir, "part", ["p_partkey"], _columns_page))
    own = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_ord", "text"))).alias("own"))
    return own.select(_key("p_partkey"), F.array_join(F.transform("own", lambda x: x["text"]), " ").alias("reading"))


def _letters(r):
    """A span a letter, six points apart; ten more after each fourth, and a lower baseline from the seventh on for odd keys."""
    odd = r["c_custkey"] % 2
    return [(c, 50.0 + 6 * i + 10 * (i // 4), 700.0 - 5 * (odd and i >= 6), 0.0, 10.0) for i, c in enumerate(r["c_name"])]


@query("""WITH l AS (SELECT c_custkey, c_name, unnest(range(0, length(c_name))) AS i FROM customer),
g AS (SELECT c_custkey, i, substr(c_name, CAST(i + 1 AS INT), 1) AS c, 2 * (i // 4) + CASE WHEN c_custkey % 2 = 1 AND i >= 6 THEN 1 ELSE 0 END AS g FROM l)
SELECT c_custkey, CAST(min(i) AS BIGINT) AS span_ord, string_agg(c, '' ORDER BY i) AS text, CAST(CASE WHEN count(*) > 1 THEN 6 * count(*) ELSE 0 END AS BIGINT) AS width FROM g GROUP BY c_custkey, g""")
def fragment_merge(spark, sf_dir):
    found = layout.merge_fragments(_spans(spark, sf_dir, "customer", ["c_custkey", "c_name"], _letters))
    return found.select(_key("c_custkey"), F.col("span_ord").cast("long").alias("span_ord"), "text", F.round("width").cast("long").alias("width"))


def _words(r):
    near = 0.5 if r["c_custkey"] % 2 else 3.0
    out, x = [], 50.0
    for text, gap in ((r["c_name"], 0.0), (r["c_mktsegment"], near), ("漢", 3.0), ("字", 3.0), ("end ", 3.0), ("x", 3.0)):
        out.append((text, x + gap, 700.0, 5.0 * len(text), 10.0))
        x += gap + 5.0 * len(text)
    return out


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 1 THEN '' ELSE ' ' END || c_mktsegment || ' 漢字 end x' AS text FROM customer")
def line_spaces(spark, sf_dir):
    """Gaps over a fifth of a character are spaces, but none between scripts without spaces or after a space."""
    return layout.lines_of_spans(_spans(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], _words)).select(_key("c_custkey"), "text")


def _margins(r):
    k = r["c_custkey"]
    return [[(72, 830, 10, "Helvetica", f"Page {k}"), (72, 815, 10, "Helvetica", f"Report {k}"), (72, 500, 10, "Helvetica", r["c_name"]), (72, 400, 10, "Helvetica", f"{k}"), (72, 20, 10, "Helvetica", f"- {k} -"), (300, 20, 10, "Helvetica", f"{k} / 9")]], WriterOptions()


@query("SELECT c_custkey, k AS line_ord, text FROM (SELECT c_custkey, unnest([0, 1, 2])::BIGINT AS k, unnest(['Report ' || c_custkey, c_name, c_custkey::VARCHAR]) AS text FROM customer)")
def header_footer(spark, sf_dir):
    """Page numbers go in the top and bottom twentieth, and only there; other text stays."""
    lines = layout.page_lines(_files(spark, sf_dir, "customer", ["c_custkey", "c_name"], _margins))
    return lines.select(_key("c_custkey"), F.col("line_ord").cast("long").alias("line_ord"), "text")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Page ' || s_suppkey ELSE 'Page ' || s_suppkey || chr(10) || s_suppkey END AS text, 'paragraph' AS type FROM supplier")
def fallback_text(spark, sf_dir):
    """A page of nothing but margin text keeps it as one plain paragraph."""

    def make(r):
        k = r["s_suppkey"]
        return [[(72, 830, 10, "Helvetica", f"Page {k}"), *([(72, 20, 10, "Helvetica", str(k))] if k % 2 else [])]], WriterOptions()

    return layout.page_blocks(_files(spark, sf_dir, "supplier", ["s_suppkey"], make)).select(_key("s_suppkey"), "text", "type")


# ---- tables


def _grid_page(r):
    """Thirteen rows; the key decides which rule the page is for."""
    kind, at = r["s_suppkey"] % 10, lambda i: 760.0 - 14 * i
    cells = lambda xs, text=lambda i, j: f"v{i}": [(text(i, j), x, at(i), 0.0, 10.0) for i in range(13) for j, x in enumerate(xs)]
    if kind == 1:  # two wide columns full of text
        return cells([50.0, 300.0], lambda i, j: "words of a column of text, " * 2)
    if kind == 2:  # the third column has too little
        return [s for k, s in enumerate(cells([60.0, 230.0, 400.0])) if k % 3 < 2 or k < 9]
    if kind == 3:
        return cells([60.0, 90.0], lambda i, j: "•" if j == 0 else f"item {i}")
    if kind == 4:
        return cells([60.0, 90.0], lambda i, j: f"{i}." if j == 0 else "item")
    if kind == 5:  # edges 25 points apart are two for Latin text
        return cells([60.0, 85.0, 230.0], lambda i, j: "ab")
    if kind == 6:  # and one for wide scripts of that size
        return [(t, x, y * 2 - 760, w, 20.0) for t, x, y, w, _ in cells([60.0, 85.0, 230.0], lambda i, j: "漢")]
    if kind == 7:  # a span a row
        return [("v", 60.0 if i % 2 == 0 else 230.0, at(i), 0.0, 10.0) for i in range(13)]
    if kind == 8:
        return cells([20.0 + 50 * j for j in range(11)])
    if kind == 9:
        return cells([20.0 + 70 * j for j in range(7)])
    return [(t, x + k % 3, y, w, s) for k, (t, x, y, w, s) in enumerate(cells([60.0, 230.0, 400.0]))]


@query("""SELECT s_suppkey, CAST(n AS BIGINT) AS columns, CAST(13 AS BIGINT) AS rows, first, last, c AS confidence
FROM supplier JOIN (VALUES (0, 3, 60.0, 400.0, 1.0), (5, 3, 60.0, 230.0, 1.0), (6, 2, 60.0, 230.0, 1.0), (7, 2, 60.0, 230.0, 1.0), (9, 7, 20.0, 440.0, 0.6)) v(kind, n, first, last, c) ON s_suppkey % 10 = kind""")
def table_rules(spark, sf_dir):
    """Which pages hold a table (lists, page columns, sparse and too many columns are none), its edges and confidence."""
    found = layout.tables_of_spans(_spans(spark, sf_dir, "supplier", ["s_suppkey"], _grid_page))
    edges = F.col("columns")
    shown = lambda c: F.round(c.cast("double"), 3).cast("decimal(6,1)")
    return found.select(
        _key("s_suppkey"), F.size("columns").cast("long").alias("columns"), F.size("cells").cast("long").alias("rows"), shown(edges[0]).alias("first"), shown(F.element_at(edges, -1)).alias("last"), shown(F.col("confidence")).alias("confidence"))


@query("""SELECT s_suppkey, CAST(i AS BIGINT) AS row_no, CAST(j AS BIGINT) AS col, CASE WHEN j = 0 THEN 'a' || i || ' b' || i WHEN j = 1 THEN s_name ELSE 'far' || s_suppkey END AS text
FROM supplier, range(0, 4) r(i), range(0, 3) c(j)""")
def span_to_column(spark, sf_dir):
    """Spans between edges belong to the edge before them; two in a cell are joined; the last column has no end near."""

    def make(r):
        return [s for i in range(4) for s in ((f"a{i}", 60.0, 700.0 - 14 * i, 20.0, 10.0), (f"b{i}", 62.0 + 11, 700.0 - 14 * i, 20.0, 10.0), (r["s_name"], 222.0, 700.0 - 14 * i, 60.0, 10.0), (f"far{r['s_suppkey']}", 400.0, 700.0 - 14 * i, 30.0, 10.0))]

    found = layout.tables_of_spans(_spans(spark, sf_dir, "supplier", ["s_suppkey", "s_name"], make))
    rows = found.select("doc_id", F.posexplode("cells").alias("row_no", "line"))
    return rows.select(_key("s_suppkey"), F.col("row_no").cast("long").alias("row_no"), F.posexplode("line").alias("col", "text")).withColumn("col", F.col("col").cast("long"))


def _mixed_page(r):
    k = r["s_suppkey"]
    table_ = [(60 + 170 * j, 700 - 18 * i, 10, "Helvetica", f"t{i}{j}") for i in range(3) for j in range(3)]
    unsure = [(30 + 60 * j, 700 - 18 * i, 10, "Helvetica", f"u{i}{j}-{k}") for i in range(3) for j in range(9)]
    row = [(75, 302, 10, "Helvetica", f"left{k}"), (345, 300, 10, "Helvetica", f"right{k}")]
    return [(table_ if k % 2 == 0 else unsure) + row], WriterOptions()


@query("""SELECT s_suppkey, CAST(0 AS BIGINT) AS block_ord, 'table' AS type, NULL AS text FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, i, 'paragraph', (SELECT string_agg('u' || i || j || '-' || s_suppkey, '  ' ORDER BY j) FROM range(0, 9) c(j)) FROM supplier, range(0, 3) r(i) WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END, 'paragraph', 'left' || s_suppkey || ' right' || s_suppkey FROM supplier""")
def unsure_tables_and_rows(spark, sf_dir):
    """Tables of low confidence are a paragraph a row; paragraphs of one visual row become one."""
    blocks = layout.page_blocks(_files(spark, sf_dir, "supplier", ["s_suppkey"], _mixed_page))
    return blocks.select(_key("s_suppkey"), F.col("block_ord").cast("long").alias("block_ord"), "type", "text")


# ---- fonts, encryption, damaged files

FONTS = {"Win": ("WinAnsiEncoding", "é"), "Mac": ("MacRomanEncoding", "é"), "Diff": ("Differences", "ž漢"), "Uni": ("ToUnicode", "한ø"), "Uhc": ("KSCms-UHC-H", "한국"), "Euc": ("KSC-EUC-H", "한국"), "Sjis": ("90ms-RKSJ-H", "日本"), "Gbk": ("GBK-EUC-H", "中文"), "Big5": ("ETen-B5-H", "中文"), "Ucs": ("UniJIS-UCS2-H", "日本")}


@query("SELECT p_partkey, f AS font_name, p_name || t AS text FROM part, (VALUES " + ", ".join(f"('{f}', '{t}')" for f, (_, t) in FONTS.items()) + ") v(f, t)")
def font_encodings(spark, sf_dir):
    """Text shown in fonts with base encodings, Differences, ToUnicode maps and predefined CMaps."""

    def make(r):
        spans = [(72, 700 - 20 * i, 12, font, r["p_name"] + tail) for i, (font, (_, tail)) in enumerate(FONTS.items())]
        return [spans], WriterOptions(encodings={f: kind for f, (kind, _) in FONTS.items()}, compress=r["p_partkey"] % 2 == 0)

    return pdf.spans(_files(spark, sf_dir, "part", ["p_partkey", "p_name"], make, ParseOptions(layout=False))).select(_key("p_partkey"), "font_name", "text")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE c_name END AS text, CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE c_mktsegment END AS title, CASE WHEN c_custkey % 7 = 6 THEN 'Encrypted' END AS error_class FROM customer""")
def encryption_variants(spark, sf_dir):
    """RC4 of 40 and 128 bits and AES, without and with a password, in plain and compressed files; a wrong password is an error."""

    def make(r):
        k = r["c_custkey"] % 7
        o = WriterOptions(encrypt=True, revision=(2, 3, 4)[k % 3], password="other" if k == 6 else "secret" if k >= 3 else "", compress=r["c_custkey"] % 2 == 0, xref_stream=r["c_custkey"] % 4 == 0, info={"Title": r["c_mktsegment"]})
        return [[(72, 700, 12, "Helvetica", r["c_name"])]], o

    parsed = _files(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], make, ParseOptions(password="secret", layout=False))
    return parsed.groupBy("doc_id").agg(F.max(F.col("content.spans")[0]["text"]).alias("text"), F.max("document.title").alias("title"), F.max("error.class").alias("error_class")).select(_key("c_custkey"), "text", "title", "error_class")


@query("SELECT c_custkey, c_name AS text, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS title, 'BT line' AS last FROM customer")
def damaged_and_updated_files(spark, sf_dir):
    """Files with an update behind them, with wrong stream lengths, and with compressed streams whose end is missing."""

    def make(r):
        k = r["c_custkey"] % 3
        o = WriterOptions(info={"Title": r["c_mktsegment"]}, old_info={"Title": "old"}) if k == 0 else WriterOptions(wrong_lengths=True, compress=r["c_custkey"] % 2 == 0) if k == 1 else WriterOptions(compress=True, cut_streams=4)
        return [[(72, 700, 12, "Helvetica", r["c_name"]), (72, 680, 12, "Helvetica", "BT line")]], o

    parsed = _files(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], make, ParseOptions(layout=False))
    own = parsed.groupBy("doc_id").agg(F.max(F.col("content.spans")[0]["text"]).alias("text"), F.max("document.title").alias("title"), F.max(F.col("content.spans")[1]["text"]).alias("last"))
    return own.select(_key("c_custkey"), "text", "title", "last")


@query("""SELECT p_partkey, k AS span_ord, CASE k WHEN 0 THEN 110 + p_size WHEN 1 THEN 20 ELSE 72 END::BIGINT AS x, CASE k WHEN 0 THEN 210 WHEN 1 THEN 30 + p_size ELSE 100 END::BIGINT AS y,
CASE k WHEN 0 THEN 10 WHEN 1 THEN 24 ELSE 12 END::BIGINT AS size, CASE k WHEN 0 THEN 'ab ' || p_name || 'ef' WHEN 1 THEN 'after' ELSE 'next' END AS text FROM part, (VALUES (0), (1), (2)) v(k)""")
def graphics_state(spark, sf_dir):
    """Saved and restored matrices, text matrices, and spaces from the moves inside TJ."""

    def make(r):
        s = r["p_size"]
        raw = f"q 1 0 0 1 {100 + s} 200 cm BT /F9 10 Tf 10 10 Td [(ab) -250 ({r['p_name']}) -100 (ef)] TJ ET Q BT /F9 12 Tf 2 0 0 2 20 {30 + s} Tm (after) Tj ET BT /F9 12 Tf 72 100 Td (next) Tj ET"
        return [[]], WriterOptions(raw={1: raw.encode()})

    out = pdf.spans(_files(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"], make, ParseOptions(layout=False)))
    return out.select(_key("p_partkey"), F.col("span_ord").cast("long").alias("span_ord"), *[F.round(c).cast("long").alias(n) for c, n in (("x", "x"), ("y", "y"), ("font_size", "size"))], "text")


# ---- images, scans


def _picture(k: int) -> bytes:
    return b"\xff\xd8\xff" + str(k % 5).encode() * 300


def _image_file(r):
    """Two pages: a full-page photograph, then the same again with a small and a raw image, and for odd keys text."""
    k = r["s_suppkey"]
    full = ("Im1", _picture(k), "DCTDecode", *BOX)
    more = [("Im2", _picture(k), "JPXDecode", 100, 100), ("Im3", b"\xff\xd8\xff tiny", "DCTDecode", 20, 200), ("Im4", b"raw bytes", "", 80, 80)]
    text = [(72, 700, 12, "Helvetica", r["s_name"])] if k % 2 else []
    return [[], text], WriterOptions(images={1: [full], 2: [full, *more]}, compress=k % 3 == 0, outline=[("Start", 1)], info={"Title": r["s_name"]})


def _image_files(spark, sf_dir, **options):
    return _files(spark, sf_dir, "supplier", ["s_suppkey", "s_name"], _image_file, ParseOptions(**options))


@query("""SELECT s_suppkey, page, name, mime, w AS width, octet_length(data) AS size, md5(data) AS digest FROM (SELECT s_suppkey, encode(repeat((s_suppkey % 5)::VARCHAR, 300)) AS d FROM supplier),
LATERAL (SELECT * FROM (VALUES (1::BIGINT, 'Im1', 'image/jpeg', 595::BIGINT, '\\xFF\\xD8\\xFF'::BLOB || d), (2, 'Im1', 'image/jpeg', 595, '\\xFF\\xD8\\xFF'::BLOB || d), (2, 'Im2', 'image/jp2', 100, '\\xFF\\xD8\\xFF'::BLOB || d), (2, 'Im3', 'image/jpeg', 20, '\\xFF\\xD8\\xFF tiny'::BLOB), (2, 'Im4', 'application/octet-stream', 80, encode('raw bytes'))) v(page, name, mime, w, data))""".replace("\\\\", "\\"))
def pdf_images(spark, sf_dir):
    """Image objects of pages by name, with their type, small ones included."""
    out = pdf.images(_image_files(spark, sf_dir))
    return out.select(_key("s_suppkey"), F.col("page").cast("long").alias("page"), "name", "mime", F.col("width").cast("long").alias("width"), F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("digest"))


@query("""SELECT s_suppkey, page, CASE WHEN page = 1 THEN 1 ELSE 4 END::BIGINT AS image_op_count, CASE WHEN page = 2 AND s_suppkey % 2 = 1 THEN 'text' ELSE 'image_only' END AS page_class, 595.0 AS width, 842.0 AS height, s_suppkey % 2 = 0 AS is_scan_pdf
FROM supplier, (VALUES (1::BIGINT), (2)) v(page)""")
def image_pages(spark, sf_dir):
    """Classes and sizes of pages with images, and which files are scans."""
    pages = quality.classify_pages(pdf.pages(_image_files(spark, sf_dir, layout=False)))
    found = pages.join(quality.scan_documents(pages), "doc_id")
    size = [F.col(c).cast("decimal(6,1)").alias(c) for c in ("width", "height")]
    return found.select(_key("s_suppkey"), F.col("page").cast("long").alias("page"), "image_op_count", "page_class", *size, "is_scan_pdf")


@query("""SELECT s_suppkey, page, resource_id, first_resource_id FROM supplier, (VALUES (1::BIGINT, 'page1_Im1.jpg', 'page1_Im1.jpg'), (2, 'page2_Im1.jpg', 'page1_Im1.jpg'), (2, 'page2_Im2.jp2', 'page1_Im1.jpg')) v(page, resource_id, first_resource_id)""")
def resource_inventory(spark, sf_dir):
    """Names of the images that a viewer can show, and under which equal content is kept."""
    images = sinks.unique_images(_image_files(spark, sf_dir))
    return images.select(_key("s_suppkey"), F.col("page").cast("long").alias("page"), "resource_id", "first_resource_id")


@query("""SELECT s_suppkey, s_name AS title, CASE WHEN s_suppkey % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS word_count, CASE WHEN s_suppkey % 2 = 1 THEN strlen(s_name) ELSE 0 END::BIGINT AS text_bytes, CAST(5 AS BIGINT) AS image_count, CAST(1 AS BIGINT) AS bookmark_count,
CAST(1 AS BIGINT) AS images_written, s_suppkey % 2 = 0 AS warned FROM supplier""")
def document_info(spark, sf_dir):
    parsed = _image_files(spark, sf_dir).persist()
    blocks = layout.page_blocks(parsed)
    info = quality.document_info(parsed, blocks).select("doc_id", "title", "word_count", "text_bytes", "image_count", "bookmark_count")
    written = sinks.summary(blocks, sinks.unique_images(parsed)).select("doc_id", F.col("image_count").alias("images_written"))
    warned = quality.document_quality(parsed, blocks).select("doc_id", F.col("warning").startswith("scanned pages").alias("warned")).na.fill(False)
    return info.join(written, "doc_id", "left").join(warned, "doc_id").select(_key("s_suppkey"), "title", "word_count", "text_bytes", "image_count", "bookmark_count", F.coalesce("images_written", F.lit(0)).alias("images_written"), "warned")


JUNK, CLEAR = "~ | . _ ; : ' ` ^ ~ | . _ , ; = + ~ | . _ ; : ' ` ^ ~ | . _ , ; = + ~ | . _ ; : '", "The recognised words of this page are plain prose that can be read"


@query(f"""SELECT s_suppkey, s_suppkey % 4 = 0 AS ocr_text_suppressed, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS spans, s_suppkey % 4 <> 3 AS page_image, CASE WHEN s_suppkey % 4 < 2 OR s_suppkey % 4 = 3 THEN true ELSE false END AS unseen,
CASE WHEN s_suppkey % 4 = 0 THEN 'unreadable recognised text left out on 1 page(s); OCR suppression can be switched off' END AS warning FROM supplier""")
def ocr_gate(spark, sf_dir):
    """Invisible text over a full-page image is left out if it cannot be read: not if it reads well (1), is visible (2) or
    the image is small (3)."""

    def make(r):
        k = r["s_suppkey"] % 4
        text = CLEAR if k == 1 else JUNK
        raw = f"BT {0 if k == 2 else 3} Tr /F9 12 Tf 72 500 Td ({text}) Tj ET".encode()
        return [[], [(72, 700, 12, "Helvetica", "seen")]], WriterOptions(images={1: [("Im1", _picture(1), "DCTDecode", *(BOX if k < 3 else (100, 100)))]}, raw={1: raw})

    parsed = _files(spark, sf_dir, "supplier", ["s_suppkey"], make).persist()
    pages = parsed.where("kind = 'page' and page = 1").select("doc_id", "content.ocr_text_suppressed", F.size("content.spans").cast("long").alias("spans"), "content.page_image", (F.col("content.unseen_chars") > 0).alias("unseen"))
    warned = quality.document_quality(parsed, layout.page_blocks(parsed)).select("doc_id", F.when(F.col("suppressed_ocr_pages") > 0, F.col("warning")).alias("warning"))
    return pages.join(warned, "doc_id").select(_key("s_suppkey"), "ocr_text_suppressed", "spans", "page_image", "unseen", "warning")


# ---- rendering

BLOCKS = "doc_id string, page int, block_ord int, type string, text string, heading_level int, cells array<array<string>>, resource_id string, width int, height int"


def _made_blocks(spark, sf_dir):
    """A heading of level 1 to 4, a paragraph, a table and an image a customer."""

    def make(r):
        base = {"doc_id": str(r["c_custkey"]), "page": 1, "text": None, "heading_level": 0, "cells": None, "resource_id": None, "width": None, "height": None}
        return [base | x for x in (
            {"block_ord": 0, "type": "paragraph", "text": r["c_name"], "heading_level": r["c_custkey"] % 4 + 1}, {"block_ord": 1, "type": "paragraph", "text": r["c_mktsegment"] + " *x*"},
            {"block_ord": 2, "type": "table", "cells": [["k", "v"], [str(r["c_custkey"]), "a\nb"]]}, {"block_ord": 3, "type": "image", "resource_id": f"p{r['c_custkey']}.jpg"})]

    return _rows(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], make, BLOCKS)


TABLE_SQL = "'| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | a b |' || chr(10) || chr(10)"


@query(rf"""SELECT c_custkey, unnest([0, 1, 2, 3])::BIGINT AS block_ord, unnest([repeat('#', CAST(least(c_custkey % 4 + 1, 3) AS INT)) || ' ' || c_name || chr(10) || chr(10), c_mktsegment || ' \*x\*' || chr(10) || chr(10), {TABLE_SQL}, '![](img/p' || c_custkey || '.jpg)' || chr(10) || chr(10)]) AS streamed,
unnest(['', '', '', chr(10) || '<!-- [Image] -->' || chr(10) || chr(10)]) AS batch_image FROM customer""")
def render_blocks(spark, sf_dir):
    streamed = render.block_markdown(RenderOptions(max_heading_level=3, streaming_images=True, image_path_prefix="img/"))
    batch = F.when(F.col("type") == "image", render.block_markdown(RenderOptions())).otherwise("")
    return _made_blocks(spark, sf_dir).select(_key("c_custkey"), F.col("block_ord").cast("long").alias("block_ord"), streamed.alias("streamed"), batch.alias("batch_image"))


@query(r"""SELECT c_custkey, 0::BIGINT AS block_ord, CASE WHEN c_custkey % 4 + 1 > 2 THEN c_name ELSE repeat('#', CAST(c_custkey % 4 + 1 AS INT)) || ' ' || c_name END || chr(10) || chr(10) AS rendered FROM customer
UNION ALL SELECT c_custkey, 1, c_mktsegment || ' *x*' || chr(10) || chr(10) FROM customer UNION ALL SELECT c_custkey, 2, 'k | v' || chr(10) || c_custkey || ' | a' || chr(10) || 'b' || chr(10) || chr(10) FROM customer""")
def visitor_actions(spark, sf_dir):
    """Images are skipped, deep headings become paragraphs, tables are written simply; other blocks stay."""
    out = render.visit_blocks(_made_blocks(spark, sf_dir), [render.skip_images, render.max_heading_depth(2), render.simple_table], RenderOptions(escape_special_chars=False))
    return out.select(_key("c_custkey"), F.col("block_ord").cast("long").alias("block_ord"), "rendered")


@query(r"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '**' || c_mktsegment || '**' WHEN 1 THEN '*' || c_mktsegment || '*' WHEN 2 THEN '***' || c_mktsegment || '***' WHEN 3 THEN '~~' || c_mktsegment || '~~' WHEN 4 THEN '<u><sup>' || c_mktsegment || '</sup></u>' ELSE '<sub>' || c_mktsegment || '</sub>' END
|| '  ' || chr(10) || '[' || c_name || '](http://x/' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' "t"' ELSE '' END || ')![alt](i/r' || c_custkey || ')' AS content,
repeat('  ', CAST(c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE (c_custkey % 9 + 1) || '.' END || ' ' || c_name || chr(10) AS item,
'<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th colspan="2">' || c_name || '</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td rowspan="3">a</td><td>' || c_custkey || '</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) || chr(10) AS html,
'| a | b |' || chr(10) || '| :---: | ---: |' || chr(10) || '| ' || c_name || ' | ' || c_custkey || ' |' || chr(10) || '| :---: | ---: |' || chr(10) || '| x | y |' || chr(10) || chr(10) AS aligned FROM customer""")
def inline_lists_and_tables(spark, sf_dir):
    """Styles, links, breaks and images inside a paragraph, list items, HTML tables with spans, aligned tables."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    flag = lambda *keys: (k % 6).isin(*keys)
    style = F.struct(flag(0, 2).alias("bold"), flag(1, 2).alias("italic"), flag(3).alias("strikethrough"), flag(4).alias("superscript"), flag(5).alias("subscript"), flag(4).alias("underline"))
    none = F.lit(None).cast("string")

    def part(kind, text=none, url=none, title=none, resource=none, alt=none):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), style.alias("style"), url.alias("url"), title.alias("title"), resource.alias("resource_id"), alt.alias("alt_text"))

    number = k.cast("string")
    content = F.array(part("text", segment), part("line_break"), part("link", name, F.concat(F.lit("http://x/"), number), F.when(k % 2 == 0, "t")), part("image", resource=F.concat(F.lit("r"), number), alt=F.lit("alt")))
    cell = lambda text, rows=1, columns=1: F.struct(text.alias("text"), F.lit(rows).alias("rowspan"), F.lit(columns).alias("colspan"))
    html = F.array(F.array(cell(name, 1, 2)), F.array(cell(F.lit("a"), 3), cell(number)))
    cells = F.array(F.array(F.lit("a"), F.lit("b")), F.array(name, number), F.array(F.lit("x"), F.lit("y")))
    options = RenderOptions(preserve_line_breaks=True, image_path_prefix="i/", list_marker="*")
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        "c_custkey", render.inline(content, options).alias("content"), render.list_item(name, (k % 3).cast("int"), k % 2 == 1, k % 9 + 1, F.lit("decimal"), options).alias("item"), render.table_html(html, F.lit(1)).alias("html"),
        render.table_markdown(cells, F.array(F.lit("center"), F.lit("right")), F.lit(2)).alias("aligned"))


@query("""SELECT c_custkey, '<!-- page 2 -->' || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Form Fields' || chr(10) || chr(10) || '- **name**: ' || c_name || chr(10) || '- **note**: _(empty)_' AS markdown FROM customer""")
def markers_and_forms(spark, sf_dir):
    """Page marks, page selection in rendering, and the form's section."""
    from .options import PageSelection

    def make(r):
        return [[(72, 700, 12, "Helvetica", r["c_name"])], [(72, 700, 12, "Helvetica", r["c_mktsegment"])]], WriterOptions(fields=[("name", "Tx", r["c_name"]), ("note", "Tx", "")])

    parsed = _files(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], make).persist()
    options = RenderOptions(cleanup=None, page_markers=True, pages=PageSelection.parse("2"))
    return render.markdown(parsed, layout.page_blocks(parsed), options).select(_key("c_custkey"), "markdown")


# ---- events


def _paged(spark, sf_dir):
    def make(r):
        return [[(72, 700, 12, "Helvetica", f"{r['s_name']} {k}")] for k in range(r["s_suppkey"] % 5 + 1)], WriterOptions()

    return _files(spark, sf_dir, "supplier", ["s_suppkey", "s_name"], make)


@query("""WITH e AS (SELECT s_suppkey, s_name, s_suppkey % 5 + 1 AS n FROM supplier), p AS (SELECT *, unnest(range(0, n)) AS k FROM e)
SELECT s_suppkey, CAST(0 AS BIGINT) AS seq, 'document_start' AS event, NULL AS content, false AS has_content, true AS document_boundary, false AS page_boundary FROM e
UNION ALL SELECT s_suppkey, 3 * n + 1, 'document_end', NULL, false, true, false FROM e UNION ALL SELECT s_suppkey, 3 * k + 1, 'page_start', NULL, false, false, true FROM p
UNION ALL SELECT s_suppkey, 3 * k + 2, 'block', s_name || ' ' || k || chr(10) || chr(10), true, false, false FROM p UNION ALL SELECT s_suppkey, 3 * k + 3, 'page_end', NULL, false, false, true FROM p""")
def event_predicates(spark, sf_dir):
    parsed = _paged(spark, sf_dir).persist()
    e = render.render_events(parsed, layout.page_blocks(parsed))
    return e.select(_key("s_suppkey"), F.col("seq").cast("long").alias("seq"), "event", "content", render.has_content(e).alias("has_content"), render.is_document_boundary(e).alias("document_boundary"), render.is_page_boundary(e).alias("page_boundary"))


@query("""WITH e AS (SELECT s_suppkey, s_suppkey % 5 + 1 AS n FROM supplier)
SELECT s_suppkey, CAST(0 AS BIGINT) AS seq, 'document_start' AS event, NULL::BIGINT AS page FROM e UNION ALL SELECT s_suppkey, k, 'page_parsed', k FROM e, range(1, 6) r(k) WHERE k <= least(n, 3)
UNION ALL SELECT s_suppkey, n + 1, 'progress', n FROM e WHERE n < 3 UNION ALL SELECT s_suppkey, n + 2, 'document_end', NULL FROM e WHERE n < 3""")
def page_early_stop(spark, sf_dir):
    """A reader that stops after the third page sees nothing behind it."""
    out = until(page_events(_paged(spark, sf_dir)), (F.col("event") == "page_parsed") & (F.col("page") == 3))
    return out.select(_key("s_suppkey"), F.col("seq").cast("long").alias("seq"), "event", F.col("page").cast("long").alias("page"))


@query("SELECT s_suppkey, CASE f WHEN 0 THEN 'extract.md' WHEN 1 THEN 'extract.txt' END AS file, md5(string_agg(s_name || ' ' || k, chr(10) || chr(10) ORDER BY k)) AS digest FROM supplier, range(0, 5) r(k), range(0, 2) g(f) WHERE k < s_suppkey % 5 + 1 GROUP BY s_suppkey, s_name, f")
def written_files(spark, sf_dir):
    """The renderings that the file sink writes."""
    parsed = _paged(spark, sf_dir).persist()
    out = sinks.rendered(parsed, layout.page_blocks(parsed), ("markdown", "text"), RenderOptions(escape_special_chars=False))
    return out.select(_key("s_suppkey"), "file", F.md5("body").alias("digest"))


@query("""SELECT s_suppkey, CAST(n AS BIGINT) AS pages, sha256(string_agg(s_name || ' ' || k, chr(10) || chr(10) ORDER BY k)) AS digest FROM (SELECT *, s_suppkey % 5 + 1 AS n FROM supplier), range(0, 5) r(k) WHERE k < n GROUP BY s_suppkey, n""")
def builder_text(spark, sf_dir):
    """The builder's text and page count for the same files."""
    from .api import Pdf

    def make(r):
        return [{"doc_id": str(r["s_suppkey"]), "content": write_pdf([[(72, 700, 12, "Helvetica", f"{r['s_name']} {k}")] for k in range(r["s_suppkey"] % 5 + 1)])}]

    found = Pdf(spark).lenient().with_cleanup(None).parse_rows(_rows(spark, sf_dir, "supplier", ["s_suppkey", "s_name"], make, "doc_id string, content binary")).persist()
    return found.document().join(found.plain_text(), "doc_id").select(_key("s_suppkey"), F.col("page_count").cast("long").alias("pages"), F.sha2("text", 256).alias("digest"))


@query("SELECT 2298::BIGINT AS pages, 1062::BIGINT AS images, 2298 * 30::BIGINT AS text_ops, (1062 * 150000)::BIGINT AS image_bytes")
def pdf_large_file(spark, sf_dir):
    """One file of 2,298 pages with 1,062 images, about 165 MB: what parsing a single file costs."""

    def make(r):
        pages = [[(72, 780 - 24 * k, 10, "Helvetica", f"page {i} line {k} with some words of text") for k in range(30)] for i in range(2298)]
        picture = b"\xff\xd8\xff" + bytes(149997)
        return [{"doc_id": "large", "content": write_pdf(pages, WriterOptions(images={2 * i + 1: [("Im1", picture, "DCTDecode", 200, 200)] for i in range(1062)}))}]

    importable(spark)
    made = _rows(spark, sf_dir, "region", ["r_regionkey"], lambda r: make(r) if r["r_regionkey"] == 0 else [], "doc_id string, content binary")
    parsed = pdf.parse_files(made)
    own = parsed.where("kind = 'page'").select("page", F.col("content.text_op_count").alias("ops"), F.col("content.images").alias("images"))
    size = F.aggregate("images", F.lit(0).cast("long"), lambda acc, i: acc + F.octet_length(i["data"]))
    return own.agg(F.count("*").alias("pages"), F.sum(F.size("images")).alias("images"), F.sum("ops").alias("text_ops"), F.sum(size).alias("image_bytes"))

