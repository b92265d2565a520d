"""The engine's DataFrames: tables of parsed files, rendering, sinks, registry, API and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions import cleanup as cl, text as tf
from pagemill.functions.cleanup import CleanupOptions
from pagemill.operators import layout, quality
from pagemill.options import ParseOptions, RenderOptions
from pagemill.plans import render, sinks
from pagemill.sources import pdf
from pagemill.sources.pdf_writer import WriterOptions, write_pdf
from pagemill.sources.registry import ConverterRegistry, ConvertOptions
from pagemill.streaming import ingest

JPEG = b"\xff\xd8\xff" + bytes(200)
PAGES = [
    [(72, 760, 24, "Helvetica-Bold", "A Big Title"), (72, 720, 12, "Helvetica", "First line"), (72, 702, 12, "Helvetica", "and second line."), (72, 640, 12, "Helvetica", "Another *paragraph*."), (290, 20, 9, "Helvetica", "- 1 -")],
    [(72 + 170 * c, 700 - 20 * r, 12, "Helvetica", t) for r, row in enumerate([("Name", "Age", "City"), ("Al", "30", "Rome"), ("Bo", "25", "Oslo")]) for c, t in enumerate(row)],
    [],
]
OPTIONS = WriterOptions(
    info={"Title": "T", "Author": "Me"}, fields=[("a.b", "Tx", "John"), ("ok", "Btn", "Yes"), ("no", "Btn", "Off"), ("e", "Tx", "")],
    images={3: [("Im0", JPEG, "DCTDecode", 100, 100), ("Im1", JPEG, "DCTDecode", 90, 90), ("Small", JPEG, "DCTDecode", 10, 10), ("Raw", b"abc", "", 100, 100)]})


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("good.pdf", bytearray(write_pdf(PAGES, OPTIONS))), ("bad.pdf", bytearray(b"no such thing")), ("none.pdf", None), ("scan.pdf", bytearray(write_pdf([[]], WriterOptions(images={1: [("I", JPEG, "DCTDecode", 595, 842)]}))))]
    return pdf.parse_files(spark.createDataFrame(rows, "doc_id string, content binary")).persist()


def test_tables(parsed):
    assert {r.doc_id: r.error_class for r in pdf.errors(parsed).collect()} == {"bad.pdf": "NotPdf", "none.pdf": "NotPdf"}
    meta = {r.doc_id: r for r in pdf.metadata(parsed).collect()}
    assert (meta["good.pdf"].title, meta["good.pdf"].author, meta["good.pdf"].page_count) == ("T", "Me", 3)
    kinds = {(r.doc_id, r.page): r.page_class for r in quality.classify_pages(pdf.pages(parsed)).collect()}
    assert kinds == {("good.pdf", 1): "text", ("good.pdf", 2): "text", ("good.pdf", 3): "image_only", ("scan.pdf", 1): "image_only"}
    shown = {r.name: (r.type, r.display) for r in pdf.form_fields(parsed).collect()}
    assert shown == {"a.b": ("text", "John"), "ok": ("checkbox", "[x]"), "no": ("checkbox", "[ ]"), "e": ("text", "")}


def test_blocks(parsed):
    rows = layout.page_blocks(parsed).where("doc_id = 'good.pdf'").orderBy("page", "block_ord").collect()
    assert [(r.page, r.type, r.text, r.heading_level) for r in rows[:3]] == [(1, "paragraph", "A Big Title", 1), (1, "paragraph", "First line and second line.", 0), (1, "paragraph", "Another *paragraph*.", 0)]
    assert rows[3].cells == [["Name", "Age", "City"], ["Al", "30", "Rome"], ["Bo", "25", "Oslo"]]
    assert [r.resource_id for r in rows[4:]] == ["page3_Im0.jpg", "page3_Im1.jpg"]


def test_renderings(parsed):
    blocks = layout.page_blocks(parsed)
    options = RenderOptions(include_frontmatter=True, page_markers=True, cleanup=None)
    text = render.markdown(parsed, blocks, options).where("doc_id = 'good.pdf'").first().markdown
    assert text.startswith('---\ntitle: "T"\nauthor: "Me"\npages: 3\n---\n<!-- page 1 -->\n\n# A Big Title\n\nFirst line and second line.\n\nAnother \\*paragraph\\*.')
    assert "| Name | Age | City |\n| --- | --- | --- |\n| Al | 30 | Rome |" in text and text.count("<!-- [Image] -->") == 2 and text.endswith("## Form Fields\n\n- **a.b**: John\n- **ok**: [x]\n- **no**: [ ]\n- **e**: _(empty)_")
    value = json.loads(render.json_documents(parsed, blocks).where("doc_id = 'good.pdf'").first().json)
    assert value["metadata"]["title"] == "T" and [p["number"] for p in value["pages"]] == [1, 2, 3] and value["pages"][1]["elements"][0]["type"] == "table"
    plain = render.plain_text(parsed, blocks, RenderOptions(cleanup=None)).where("doc_id = 'good.pdf'").first().text
    assert plain.endswith("Name\tAge\tCity\nAl\t30\tRome\nBo\t25\tOslo")
    events = render.render_events(parsed, blocks)
    assert [r.event for r in events.where("doc_id = 'scan.pdf'").orderBy("seq").collect()] == ["document_start", "page_start", "block", "page_end", "document_end"]
    assert render.collect_content(events).where("doc_id = 'good.pdf'").first().body.startswith("# A Big Title")


def test_quality(parsed):
    found = {r.doc_id: r for r in quality.document_quality(parsed, layout.page_blocks(parsed)).collect()}
    assert found["scan.pdf"].is_scan_pdf and "scanned pages" in found["scan.pdf"].warning and found["good.pdf"].warning is None and found["good.pdf"].is_good
    stats = quality.extraction_stats(layout.page_blocks(parsed)).where("doc_id = 'good.pdf'").first()
    assert (stats.heading_count, stats.paragraph_count, stats.table_count, stats.image_count) == (1, 2, 1, 2)


def test_sinks(parsed, tmp_path):
    done = {r.doc_id: r for r in sinks.write_files(parsed, str(tmp_path / "files")).collect()}
    assert done["good.pdf"].image_count == 1 and (tmp_path / "files/good.pdf/images/page3_Im0.jpg").read_bytes() == JPEG
    assert json.loads((tmp_path / "files/good.pdf/content.json").read_text())["page_count"] == 3 and (tmp_path / "files/good.pdf/extract.md").exists()
    sinks.write_tables(parsed, str(tmp_path / "tables"), ["markdown"]).collect()
    moved = sinks.redirect_images(layout.page_blocks(parsed), sinks.unique_images(parsed)).where("type = 'image' and doc_id = 'good.pdf'").collect()
    assert {r.resource_id for r in moved} == {"page3_Im0.jpg"}


def test_rich_model(spark):
    style = "struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,superscript:boolean,subscript:boolean>"
    content = f"array<struct<type:string,text:string,style:{style},url:string,title:string,resource_id:string,alt_text:string>>"
    run = [("text", "a_b", (True, True, False, True, False, False), None, None, None, None), ("line_break", None, None, None, None, None, None), ("link", "l", None, "u", "t", None, None), ("image", None, None, None, None, "r.png", None)]
    row = spark.createDataFrame([(run,)], f"c {content}").select(render.inline(F.col("c"), RenderOptions(image_path_prefix="img/")).alias("m"), render.list_item(F.lit("x"), F.lit(1), F.lit(True), F.lit(4), F.lit("lower_roman"), RenderOptions()).alias("i")).first()
    assert row.m == '***~~a\\_b~~*** [l](u "t")![](img/r.png)' and row.i == "  iv. x\n"
    cells = spark.createDataFrame([([[("h", 1, 2)], [("a", 2, 1), ("b", 1, 1)]],)], "r array<array<struct<text:string,rowspan:int,colspan:int>>>")
    assert cells.select(render.table_html(F.col("r"), F.lit(1)).alias("h")).first().h == '<table>\n<thead>\n<tr><th colspan="2">h</th></tr>\n</thead>\n<tbody>\n<tr><td rowspan="2">a</td><td>b</td></tr>\n</tbody>\n</table>\n\n'
    aligned = spark.range(1).select(render.table_markdown(F.expr("array(array('a', 'b'), array('c', null))"), F.expr("array('center', 'right')")).alias("m")).first().m
    assert aligned == "| a | b |\n| :---: | ---: |\n| c |  |\n\n"


@pytest.mark.parametrize("text,preset,want", [
    ("ﬁnding ﬂowers", "standard", "finding flowers"), ("infor-\nmation", "standard", "information"), ("adip- iscing", "standard", "adipiscing"), ("con-\n sectetuer", "standard", "consectetuer"),
    ("This\nis\na\ntest.\n\nNew paragraph.", "standard", "This is a test.\n\nNew paragraph."), ("Hello�World", "standard", "HelloWorld"), ("A " + "." * 32 + " B", "standard", "A B"),
    ("a .... b", "standard", "a .... b"), ("---\nt: 1\n---\nx    y", "aggressive", "---\nt: 1\n---\n\nx  y"), ("x     y", "minimal", "x  y"), (None, "standard", None), ("", "standard", ""), ("well-known", "standard", "wellknown")])
def test_cleanup(spark, text, preset, want):
    assert spark.createDataFrame([(text,)], "t string").select(cl.clean(F.col("t"), CleanupOptions.preset(preset)).alias("o")).first().o == want


def test_cleanup_flags(spark):
    one = lambda text, **flags: spark.createDataFrame([(text,)], "t string").select(cl.clean(F.col("t"), CleanupOptions(**flags)).alias("o")).first().o
    assert one("well-known infor-\nmation", keep_inline_hyphens=True) == "well-known information"
    assert "| --- |" in one("| a |\n| --- |\n| b |", keep_table_rules=True)


def test_dates_and_markers(spark):
    rows = spark.createDataFrame([("D:20240115103045",), ("D:2024",), ("D:20241301",), ("x",), (None,)], "t string")
    assert [str(r.d) if r.d else None for r in rows.select(tf.pdf_date(F.col("t")).alias("d")).collect()] == ["2024-01-15 10:30:45", "2024-01-01 00:00:00", None, None, None]
    marks = spark.createDataFrame([("•",), ("12.",), ("a)",), ("1 .",), ("word",)], "t string").select(tf.is_bullet_marker(F.col("t")).alias("b"), tf.is_number_marker(F.col("t")).alias("n")).collect()
    assert [(r.b, r.n) for r in marks] == [(True, False), (False, True), (False, True), (False, True), (False, False)]


def test_span_tables(spark):
    rows = [("d", 1, i, t, x, y, 0.0, s, "Helvetica") for i, (t, x, y, s) in enumerate([("Big", 50.0, 700.0, 24.0), ("body one", 50.0, 650.0, 12.0), ("body two", 50.0, 632.0, 12.0), ("more", 120.0, 632.0, 12.0)])]
    spans = spark.createDataFrame(rows, "doc_id string, page int, span_ord int, text string, x float, y float, width float, font_size float, font_name string")
    lines = layout.lines_of_spans(spans)
    assert [r.text for r in lines.orderBy("line_ord").collect()] == ["Big", "body one", "body two more"]
    stats = layout.font_statistics(spans).first()
    assert (stats.body_size, stats.heading_sizes) == (12.0, [24.0])
    found = layout.text_blocks(layout.mark_headings(lines.join(layout.font_statistics(spans), ["doc_id", "page"]))).orderBy("block_ord").collect()
    assert [(r.text, r.heading_level) for r in found] == [("Big", 1), ("body one body two more", 0)]
    assert layout.tables_of_spans(spans).count() == 0 and layout.regions_of_spans(spans, 60.0, 36.0).count() == 4 and layout.merge_fragments(spans).count() == 4


def test_registry_and_api(spark, tmp_path):
    registry = ConverterRegistry.with_defaults()
    assert registry.supports("PDF") and registry.get_by_name("Pdf").name == "pdf" and registry.supported_extensions() == ["pdf"]
    files = spark.createDataFrame([("a.pdf", bytearray(write_pdf(PAGES[:1]))), ("b.doc", bytearray(b"x"))], "doc_id string, content binary")
    rows = registry.convert(files, ConvertOptions(format="text", stats=True)).collect()
    assert [(r.doc_id, r.mime_type, r.heading_count) for r in rows] == [("a.pdf", "text/plain", 1)]
    path = tmp_path / "a.pdf"
    path.write_bytes(write_pdf(PAGES, OPTIONS))
    assert api.is_pdf(str(path)) and api.get_page_count(str(path)) == 3 and api.to_markdown(str(path)).startswith("# A Big Title")
    assert api.get_page_stats(str(path), 3)["page_class"] == "image_only" and api.get_extraction_quality(str(path))["is_good"] and api.get_info(str(path))["image_count"] == 4
    assert api.page_to_text(str(path), 2).startswith("Name") and json.loads(api.to_json(str(path)))["page_count"] == 3 and len(api.resources(str(path))) == 3
    broken = tmp_path / "b.pdf"
    broken.write_bytes(b"nothing at all here")
    assert api.get_page_count(str(broken)) == -1 and not api.is_pdf(str(broken))
    with pytest.raises(Exception, match="cannot parse"):
        pdf.parse_files(spark.createDataFrame([("x", bytearray(b"no"))], "doc_id string, content binary"), ParseOptions(lenient=False)).collect()


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.pdf").write_bytes(write_pdf(PAGES[:2]))
    run = lambda: ingest.write_stream(ingest.parse_stream(ingest.file_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (folder / "3.pdf").write_bytes(write_pdf(PAGES[:1]))
    run()
    names = lambda df: sorted((r.doc_id.rsplit("/", 1)[1], r.kind, r.page) for r in df.collect())
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert names(stored) == names(pdf.parse_files(pdf.binary_files(spark, str(folder))))
    events = ingest.page_events(stored).where("doc_id like '%0.pdf'").orderBy("seq").collect()
    assert [r.event for r in events] == ["document_start", "page_parsed", "page_parsed", "progress", "document_end"]
