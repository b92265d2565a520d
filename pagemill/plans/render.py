"""Markdown, plain text and JSON of documents, as expressions over their blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cleanup, text as tf
from ..operators.quality import block_text, table_text
from ..options import RenderOptions
from ..sources import pdf


def styled(text: Column, style: Column) -> Column:
    """Marks of a run, innermost first: strikethrough, italic, bold, superscript, subscript, underline."""
    for flag, before, after in (("strikethrough", "~~", "~~"), ("italic", "*", "*"), ("bold", "**", "**"), ("superscript", "<sup>", "</sup>"), ("subscript", "<sub>", "</sub>"), ("underline", "<u>", "</u>")):
        text = F.when(F.coalesce(style[flag], F.lit(False)), F.concat(F.lit(before), text, F.lit(after))).otherwise(text)
    return text


def inline(content: Column, options: RenderOptions) -> Column:
    """Inline elements array<struct<type,text,style,url,title,resource_id,alt_text>> as Markdown."""

    def one(x: Column) -> Column:
        run = tf.escape_markdown(x["text"]) if options.escape_special_chars else x["text"]
        link = F.concat(F.lit("["), x["text"], F.lit("]("), x["url"], F.when(x["title"].isNotNull(), F.concat(F.lit(' "'), x["title"], F.lit('"'))).otherwise(""), F.lit(")"))
        image = F.concat(F.lit("!["), F.coalesce(x["alt_text"], F.lit("")), F.lit("]("), F.lit(options.image_path_prefix), x["resource_id"], F.lit(")"))
        line_break = F.lit("  \n" if options.preserve_line_breaks else " ")
        return F.when(x["type"] == "text", styled(run, x["style"])).when(x["type"] == "line_break", line_break).when(x["type"] == "link", link).otherwise(image)

    return F.array_join(F.transform(content, one), "")


def list_item(text: Column, level: Column, ordered: Column, number: Column, style: Column, options: RenderOptions) -> Column:
    marker = F.when(ordered, tf.list_number(F.coalesce(number, F.lit(1)), style)).otherwise(options.list_marker)
    return F.concat(F.repeat(F.lit("  "), level), marker, F.lit(" "), text, F.lit("\n"))


def table_markdown(cells: Column, alignment: Column | None = None, header_rows: Column | None = None) -> Column:
    """Rows with pipes; a rule follows the first row, and the last header row if that is another one."""
    rule = F.transform(alignment, lambda a: F.when(a == "center", " :---: |").when(a == "right", " ---: |").otherwise(" --- |")) if alignment is not None else None
    header = header_rows if header_rows is not None else F.lit(1)

    def row(cells_of: Column, i: Column) -> Column:
        shown = F.transform(cells_of, lambda c: F.concat(F.lit(" "), cleanup.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), F.lit(" |")))
        rules = F.array_join(rule, "") if rule is not None else F.repeat(F.lit(" --- |"), F.size(cells_of))
        after = F.when((i == 0) | ((header > 0) & (i == header - 1)), F.concat(F.lit("|"), rules, F.lit("\n"))).otherwise("")
        return F.concat(F.lit("|"), F.array_join(shown, ""), F.lit("\n"), after)

    return F.when(F.size(cells) > 0, F.concat(F.array_join(F.transform(cells, row), ""), F.lit("\n"))).otherwise("")


def table_html(rows: Column, header_rows: Column) -> Column:
    """array<array<struct<text,rowspan,colspan>>> as HTML, spans kept."""

    def part(own: Column, tag: str) -> Column:
        def cell(c):
            spans = F.concat(F.when(c["rowspan"] > 1, F.concat(F.lit(' rowspan="'), c["rowspan"].cast("string"), F.lit('"'))).otherwise(""), F.when(c["colspan"] > 1, F.concat(F.lit(' colspan="'), c["colspan"].cast("string"), F.lit('"'))).otherwise(""))
            return F.concat(F.lit(f"<{tag}"), spans, F.lit(">"), c["text"], F.lit(f"</{tag}>"))

        return F.array_join(F.transform(own, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>\n"))), "")

    head = F.when(header_rows > 0, F.concat(F.lit("<thead>\n"), part(F.slice(rows, 1, F.greatest(header_rows, F.lit(1))), "th"), F.lit("</thead>\n"))).otherwise("")
    body = F.slice(rows, header_rows + 1, F.greatest(F.size(rows) - header_rows, F.lit(0)))
    return F.concat(F.lit("<table>\n"), head, F.lit("<tbody>\n"), part(body, "td"), F.lit("</tbody>\n</table>\n\n"))


def block_markdown(options: RenderOptions) -> Column:
    """Markdown of a row of page_blocks."""
    text = tf.escape_markdown(F.col("text")) if options.escape_special_chars else F.col("text")
    level = F.least(F.col("heading_level"), F.lit(options.max_heading_level))
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text, F.lit("\n\n"))
    if options.streaming_images:
        image = F.concat(F.lit("![]("), F.lit(options.image_path_prefix), F.col("resource_id"), F.lit(")\n\n"))
    else:
        image = F.lit("\n<!-- [Image] -->\n\n")
    kind = F.col("type")
    return (
        F.when((kind == "paragraph") & (F.col("heading_level") > 0), heading).when(kind == "paragraph", F.concat(text, F.lit("\n\n"))).when(kind == "table", table_markdown(F.col("cells")))
        .when(kind == "image", image).when(kind == "horizontal_rule", "\n---\n\n").when(kind.isin("page_break", "section_break"), "\n\n").otherwise(F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("\n\n")))
    )


def _selected(rows: DataFrame, options: RenderOptions) -> DataFrame:
    return rows.where(options.pages.column(F.col("page")))


def _joined(pieces: DataFrame, separator: str = "") -> DataFrame:
    """(doc_id, body) of (doc_id, page, ord, piece) rows, in order."""
    own = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "ord", "piece"))).alias("own"))
    return own.select("doc_id", F.array_join(F.transform("own", lambda x: x["piece"]), separator).alias("body"))


def form_section(fields: Column) -> Column:
    """The form fields of a document row as a Markdown section; nothing if there are none."""

    def line(f: Column) -> Column:
        shown = pdf.display(f)
        return F.concat(F.lit("- **"), f["name"], F.lit("**: "), F.when(shown == "", "_(empty)_").otherwise(shown), F.lit("\n"))

    return F.when(F.size(fields) > 0, F.concat(F.lit("\n---\n\n## Form Fields\n\n"), F.array_join(F.transform(fields, line), ""))).otherwise("")


def markdown(parsed: DataFrame, blocks: DataFrame, options: RenderOptions | None = None) -> DataFrame:
    """(doc_id, markdown): front matter, selected pages, form fields, then cleanup."""
    options = options or RenderOptions()
    pieces = _selected(blocks, options).select("doc_id", "page", F.col("block_ord").alias("ord"), block_markdown(options).alias("piece"))
    if options.page_markers:
        marks = _selected(parsed.where("kind = 'page'"), options).select("doc_id", "page", F.lit(-1).alias("ord"), F.format_string("<!-- page %d -->\n\n", "page").alias("piece"))
        pieces = pieces.unionByName(marks)
    d, empty = F.col("document"), F.lit("")
    head = tf.frontmatter(d["title"], d["author"], d["keywords"], d["page_count"]) if options.include_frontmatter else empty
    out = parsed.where("kind = 'document'").select("doc_id", head.alias("head"), form_section(d["fields"]).alias("form")).join(_joined(pieces), "doc_id", "left")
    body = F.concat("head", F.coalesce("body", empty), "form")
    body = cleanup.clean(body, options.cleanup) if options.cleanup else body
    return out.select("doc_id", cleanup.trim(body).alias("markdown"))


def plain_text(parsed: DataFrame, blocks: DataFrame, options: RenderOptions | None = None) -> DataFrame:
    """(doc_id, text): elements and pages apart by an empty line, then cleanup; page selection is parsing's."""
    options = options or RenderOptions()
    own = block_text(blocks).where(F.col("type").isin("paragraph", "table")).select("doc_id", "page", F.col("block_ord").alias("ord"), F.col("plain").alias("piece"))
    pages = own.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "piece"))).alias("own"))
    pages = pages.select("doc_id", "page", F.lit(0).alias("ord"), F.array_join(F.transform("own", lambda x: x["piece"]), "\n\n").alias("piece"))
    every = parsed.where("kind = 'page'").select("doc_id", "page").join(pages, ["doc_id", "page"], "left").select("doc_id", "page", F.lit(0).alias("ord"), F.coalesce("piece", F.lit("")).alias("piece"))
    out = pdf.metadata(parsed).select("doc_id").join(_joined(every, "\n\n"), "doc_id", "left")
    body = F.coalesce("body", F.lit(""))
    body = cleanup.clean(body, options.cleanup) if options.cleanup else body
    return out.select("doc_id", cleanup.trim(body).alias("text"))


def json_documents(parsed: DataFrame, blocks: DataFrame, pretty: bool = False) -> DataFrame:
    """(doc_id, json): metadata, page count and pages with their elements."""
    element = F.struct("block_ord", "type", "text", "heading_level", "cells", "resource_id")
    per = blocks.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(element)).alias("elements"))
    sizes = pdf.pages(parsed).select("doc_id", "page", "width", "height", "text_op_count", "image_op_count", "ocr_text_suppressed")
    pages = sizes.join(per, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("page").alias("number"), "width", "height", F.coalesce("elements", F.array()).alias("elements"), "text_op_count", "image_op_count", "ocr_text_suppressed"))).alias("pages"))
    meta = pdf.metadata(parsed)
    fields = [c for c in meta.columns if c != "doc_id"]
    out = meta.join(pages, "doc_id", "left")
    whole = F.struct(F.struct(*fields).alias("metadata"), F.col("page_count"), F.coalesce("pages", F.array()).alias("pages"))
    return out.select("doc_id", F.to_json(whole, {"pretty": str(pretty).lower()}).alias("json"))


EVENTS = ("document_start", "frontmatter", "page_start", "block", "page_end", "document_end")


def render_events(parsed: DataFrame, blocks: DataFrame, options: RenderOptions | None = None) -> DataFrame:
    """(doc_id, seq, event, page, content): what a streaming renderer would say, in order."""
    options = options or RenderOptions()
    event = lambda page, rank, order, name, content: F.struct(page.cast("int").alias("at"), F.lit(rank).alias("rank"), order.cast("int").alias("ord"), F.lit(name).alias("event"), content.cast("string").alias("content"))
    none, zero, page = F.lit(None), F.lit(0), F.col("page")
    whole = [event(zero, 0, zero, "document_start", none), event(F.lit(2**31 - 1), 9, zero, "document_end", none)]
    if options.include_frontmatter:
        d = F.col("document")
        whole.insert(1, event(zero, 1, zero, "frontmatter", tf.frontmatter(d["title"], d["author"], d["keywords"], d["page_count"])))
    own = F.when(F.col("kind") == "document", F.array(*whole)).otherwise(F.array(event(page, 2, zero, "page_start", none), event(page, 4, zero, "page_end", none)))
    frame = parsed.where((F.col("kind") == "document") | ((F.col("kind") == "page") & options.pages.column(page))).select("doc_id", F.explode(own).alias("e")).select("doc_id", "e.*")
    inner = _selected(blocks, options).select("doc_id", page.alias("at"), F.lit(3).alias("rank"), F.col("block_ord").alias("ord"), F.lit("block").alias("event"), block_markdown(options).alias("content"))
    out = frame.unionByName(inner)
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "rank", "ord")) - 1
    return out.select("doc_id", seq.cast("int").alias("seq"), "event", F.when(~F.col("event").isin("document_start", "document_end", "frontmatter"), F.col("at")).alias("page"), "content")


def collect_content(events: DataFrame) -> DataFrame:
    """(doc_id, body): the contents of events with any, trimmed."""
    own = events.where(F.col("event").isin("block", "frontmatter")).select("doc_id", F.lit(0).alias("page"), F.col("seq").alias("ord"), F.col("content").alias("piece"))
    return _joined(own).withColumn("body", cleanup.trim(F.col("body")))


def has_content(events: DataFrame) -> Column:
    return events["content"].isNotNull()


def is_document_boundary(events: DataFrame) -> Column:
    return events["event"].isin("document_start", "document_end")


def is_page_boundary(events: DataFrame) -> Column:
    return events["event"].isin("page_start", "page_end")


# ---- visitors: each looks at a block row and gives (action, replacement); the first that does not continue decides

Visitor = Callable[[], tuple[Column, Column]]
CONTINUE, REPLACE, SKIP = "continue", "replace", "skip"


def skip_images() -> tuple[Column, Column]:
    return F.when(F.col("type") == "image", SKIP).otherwise(CONTINUE), F.lit("")


def simple_table() -> tuple[Column, Column]:
    rows = F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n")
    return F.when(F.col("type") == "table", REPLACE).otherwise(CONTINUE), F.concat(rows, F.lit("\n\n"))


def max_heading_depth(depth: int) -> Visitor:
    def visit():
        deep = (F.col("type") == "paragraph") & (F.col("heading_level") > depth)
        return F.when(deep, REPLACE).otherwise(CONTINUE), F.concat(F.col("text"), F.lit("\n\n"))

    return visit


def visit_blocks(blocks: DataFrame, visitors: list[Visitor], options: RenderOptions | None = None) -> DataFrame:
    """blocks plus rendered, without those that a visitor skips."""
    action, rendered = F.lit(CONTINUE), block_markdown(options or RenderOptions())
    for visit in reversed(visitors):
        own, text = visit()
        rendered = F.when(own == REPLACE, text).otherwise(rendered)
        action = F.when(own != CONTINUE, own).otherwise(action)
    return blocks.withColumn("rendered", rendered).where(action != SKIP)


def table_cells(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_ord, row, col, text, rowspan, colspan, is_header) of all tables."""
    rows = blocks.where("type = 'table'").select("doc_id", "page", "block_ord", F.size("cells").alias("n"), F.posexplode("cells").alias("row", "line"))
    cells = rows.select("doc_id", "page", "block_ord", "row", "n", F.posexplode("line").alias("col", "text"))
    return cells.select("doc_id", "page", "block_ord", "row", "col", "text", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), ((F.col("row") == 0) & (F.col("n") > 1)).alias("is_header"))


__all__ = ["markdown", "plain_text", "json_documents", "render_events", "collect_content", "visit_blocks", "table_cells", "table_text"]
