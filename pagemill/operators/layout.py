"""Lines, headings and blocks of pages, and the pages' element order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import NO_HEADING_BULLETS, extension_of
from ..kernel import layout as kernel
from ..session import importable

PAGE_KEYS = ("doc_id", "page")
PAGE_KEYS_RANK = ("doc_id", "page", "rank")
LINE_SCHEMA = "doc_id string, page int, line_ord int, text string, x float, y float, font_size float, bold boolean"
SAME_ROW = 6.0
LOW_CONFIDENCE = 0.4
TABLE_ROWS = 1 << 20  # order numbers of a page's k-th table begin at so many times k


def _by_page(spans: DataFrame, schema: str, run) -> DataFrame:
    importable(spans.sparkSession)
    keep = spans.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "span_ord", "text", "x", "y", "width", "font_size", "font_name")

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["span_ord"])
        return pa.Table.from_pylist([{"doc_id": rows[0]["doc_id"], "page": rows[0]["page"]} | r for r in run(rows)], shape)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(T._parse_datatype_string(schema))
    return keep.groupBy(*PAGE_KEYS).applyInArrow(one, schema)


def lines_of_spans(spans: DataFrame, estimate_widths: bool = False) -> DataFrame:
    """Lines of a span table; files that come from parse_files have them already. A page is one group."""
    return _by_page(spans, LINE_SCHEMA, lambda rows: [{"line_ord": i} | x for i, x in enumerate(kernel.page_lines(rows, estimate_widths))])


def tables_of_spans(spans: DataFrame) -> DataFrame:
    schema = "doc_id string, page int, table_ord int, top float, bottom float, left float, right float, columns array<float>, cells array<array<string>>, confidence float"
    return _by_page(spans, schema, lambda rows: [{"table_ord": i} | x for i, x in enumerate(kernel.detect_tables(rows)[0])])


def regions_of_spans(spans: DataFrame, least_x: float, least_y: float) -> DataFrame:
    """(doc_id, page, span_ord, region): reading-order regions by recursive cuts."""

    def run(rows):
        cut = kernel.regions(*([r[c] for r in rows] for c in ("x", "y", "width", "font_size")), least_x, least_y)
        return [{"span_ord": rows[i]["span_ord"], "region": k} for k, own in enumerate(cut) for i in sorted(own)]

    return _by_page(spans, "doc_id string, page int, span_ord int, region int", run)


def merge_fragments(spans: DataFrame) -> DataFrame:
    """Spans in which short neighbours without width are one."""
    schema = "doc_id string, page int, span_ord int, text string, x float, y float, width float, font_size float, font_name string"
    return _by_page(spans, schema, lambda rows: [{k: v for k, v in r.items() if k not in PAGE_KEYS} for r in kernel.merge_fragments(rows)])


def size_key(size: Column) -> Column:
    return (size.cast("float") * F.lit(10).cast("float")).cast("int")


def font_statistics(spans: DataFrame, keys=PAGE_KEYS, size: str = "font_size") -> DataFrame:
    """keys, body_size (the commonest size, of equals the largest) and heading_sizes (larger ones, falling)."""
    counts = spans.groupBy(*keys, size_key(F.col(size)).alias("key")).agg(F.count("*").alias("n"))
    found = counts.groupBy(*keys).agg(F.max_by("key", F.struct("n", "key")).alias("body"), F.collect_set("key").alias("all"))
    return found.select(*keys, (F.col("body") / 10).alias("body_size"), _heading_sizes(F.col("all"), F.col("body")).alias("heading_sizes"))


def _heading_sizes(keys: Column, body: Column) -> Column:
    return F.transform(F.sort_array(F.filter(keys, lambda k: k / 10 > body / 10 + 0.5), asc=False), lambda k: k / 10)


def array_statistics(sizes: Column) -> Column:
    """font_statistics of one page's array of sizes, without a shuffle."""
    keys = F.transform(sizes, size_key)
    distinct = F.array_distinct(keys)
    best = F.array_max(F.transform(distinct, lambda k: F.struct(F.size(F.filter(keys, lambda x: x == k)).alias("n"), k.alias("key"))))["key"]
    body = F.coalesce(best, F.lit(120))
    return F.struct((body / 10).alias("body_size"), _heading_sizes(distinct, body).alias("heading_sizes")).cast("struct<body_size:double,heading_sizes:array<double>>")


def heading_level(size: Column, strong: Column, body: Column, heading_sizes: Column) -> Column:
    """0 for body text, else the tier (sizes under two points apart are one) of the size, four at most."""
    start = F.struct(F.lit(0).alias("tier"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("found"))

    def step(acc, s):
        fresh = acc["last"].isNull() | (F.abs(acc["last"] - s) >= 2.0)
        tier = acc["tier"] + F.when(fresh, 1).otherwise(0)
        hit = F.when((acc["found"] == 0) & (size >= s - 0.5), F.least(tier, F.lit(4))).otherwise(acc["found"])
        return F.struct(tier.alias("tier"), F.when(fresh, s).otherwise(acc["last"]).alias("last"), hit.alias("found"))

    found = F.aggregate(heading_sizes, start, step, lambda acc: F.when(acc["found"] > 0, acc["found"]).otherwise(4))
    return F.when((size >= body + 2.5) | (strong & (size >= body + 1.5)), found).otherwise(0)


def mark_headings(lines: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """lines (with body_size and heading_sizes) plus heading_level; neighbours of one size are no headings."""
    w = Window.partitionBy(*keys).orderBy("line_ord")
    text, size = F.col("text"), F.col("font_size").cast("double")
    visible = F.length(F.regexp_replace(text, r"(?U)[\s!-/:-@\[-`{-~]", ""))
    letters = F.regexp_replace(text, r"[^\p{IsAlphabetic}]", "")
    upper = (letters != "") & ~letters.rlike(r"[^\p{IsUppercase}]")
    bullet = F.instr(F.lit(NO_HEADING_BULLETS), F.substring(F.regexp_replace(text, r"(?U)\A\s+", ""), 1, 1)) > 0
    level = heading_level(size, F.coalesce(F.col("bold"), F.lit(False)) | upper, F.col("body_size"), F.col("heading_sizes"))
    alike = lambda other: F.coalesce(F.abs(other - F.col("font_size")) < 0.5, F.lit(False))
    run = (alike(F.lag("font_size").over(w)) | alike(F.lead("font_size").over(w))) & (size < F.col("body_size") + 6.0)
    return lines.withColumn("heading_level", F.when((visible >= 3) & ~bullet & ~run, level).otherwise(0).cast("int"))


def number_blocks(lines: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """lines plus block_ord: a block ends at headings, wide gaps, size changes and changes of the left edge."""
    w = Window.partitionBy(*keys).orderBy("line_ord")
    whole = Window.partitionBy(*keys)
    before = lambda c: F.lag(c).over(w)
    gap = F.abs(before("y") - F.col("y"))
    lines = lines.withColumn("gap", gap).withColumn("average", F.coalesce(F.avg(F.when(F.col("gap") > 0.1, F.col("gap"))).over(whole), F.lit(12.0)))
    change = F.abs(before("font_size") - F.col("font_size"))
    stacked = (before("heading_level") > 0) & (change <= 2.0) & (F.col("gap") <= F.greatest(F.greatest(before("font_size"), F.col("font_size")).cast("double") * 2.5, F.col("average") * 2.0))
    starts = F.when(F.col("heading_level") > 0, ~stacked).otherwise((before("heading_level") > 0) | (F.col("gap") > F.col("average") * 1.5) | (change >= 2.0) | (F.abs(before("x") - F.col("x")) > 40.0))
    lines = lines.withColumn("starts", F.when(before("y").isNull(), 1).when(starts, 1).otherwise(0))
    return lines.withColumn("block_ord", (F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("gap", "average", "starts")


def text_blocks(lines: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """One row a block: text (lines joined by a space), y of its first line, heading_level (0: paragraph)."""
    found = number_blocks(lines, keys).groupBy(*keys, "block_ord").agg(
        F.sort_array(F.collect_list(F.struct("line_ord", "text", "y"))).alias("own"), F.coalesce(F.min(F.when(F.col("heading_level") > 0, F.col("heading_level"))), F.lit(0)).alias("heading_level"))
    return found.select(*keys, "block_ord", F.array_join(F.transform("own", lambda x: x["text"]), " ").alias("text"), F.col("own")[0]["y"].alias("y"), "heading_level")


def page_lines(parsed: DataFrame) -> DataFrame:
    """Lines of parsed pages with the page's font statistics; nothing is shuffled."""
    found = parsed.where("kind = 'page'").select("doc_id", "page", F.col("content.lines").alias("lines"), array_statistics(F.col("content.sizes")).alias("s"))
    return found.select("doc_id", "page", "s.*", F.posexplode("lines").alias("line_ord", "l")).select("doc_id", "page", "body_size", "heading_sizes", "line_ord", "l.*")


BLOCK = "struct<at:struct<down:float,rank:int,ord:int>,type:string,text:string,heading_level:int,cells:array<array<string>>,resource_id:string,width:int,height:int>"
ELEMENT = "struct<rank:int,ord:int,line:struct<text:string,x:float,y:float,font_size:float,bold:boolean>,block:" + BLOCK + ">"


def _block(rank: int, order: Column, down: Column, kind: str, text: Column, cells: Column, image: Column | None = None) -> Column:
    none = F.lit(None)
    at = F.struct(down.cast("float").alias("down"), F.lit(rank).alias("rank"), order.cast("int").alias("ord"))
    picture = [image[c].alias(c) for c in ("resource_id", "width", "height")] if image is not None else [none.alias(c) for c in ("resource_id", "width", "height")]
    return F.struct(at.alias("at"), F.lit(kind).alias("type"), text.alias("text"), F.lit(0).alias("heading_level"), cells.alias("cells"), *picture).cast(BLOCK)


def _element(rank: int, order: Column, line: Column, block: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), order.cast("int").alias("ord"), line.alias("line"), block.alias("block")).cast(ELEMENT)


def _elements(content: Column, page: Column) -> Column:
    """All elements of a page row, tables 0, rows of unsure tables 1, lines 2, plain lines 3, images 4."""
    none = F.lit(None)

    def flat_rows(t, k):
        step = (t["top"] - t["bottom"]) / F.greatest(F.size(t["cells"]) - 1, F.lit(1))
        row = lambda cells, r: _element(1, k * TABLE_ROWS + r, none, _block(1, k * TABLE_ROWS + r, r * step - t["top"], "paragraph", F.array_join(F.filter(cells, lambda c: c != ""), "  "), none))
        return F.filter(F.transform(t["cells"], row), lambda e: F.trim(e["block"]["text"]) != "")

    one_table = lambda t, k: F.when(t["confidence"] >= LOW_CONFIDENCE, F.array(_element(0, k, none, _block(0, k, -t["top"], "table", none, t["cells"])))).otherwise(flat_rows(t, k))
    tables = F.flatten(F.transform(content["tables"], one_table))
    lines = F.transform(content["lines"], lambda x, k: _element(2, k, x, none))
    plain = F.when(content["fallback"].isNotNull(), F.array(_element(3, F.lit(0), none, _block(3, F.lit(0), F.lit(0.0), "paragraph", content["fallback"], none)))).otherwise(F.array().cast(f"array<{ELEMENT}>"))
    images = F.transform(shown_images(content["images"], page), lambda i, k: _element(4, k, none, _block(4, k, F.lit(0.0), "image", none, none, i)))
    return F.concat(tables, lines, plain, images)


def page_blocks(parsed: DataFrame) -> DataFrame:
    """(doc_id, page, block_ord, type, text, heading_level, cells, resource_id, width, height): a page's elements in order.

    Pages with tables are ordered by height, and paragraphs of one visual row become one; other pages keep the reading
    order of their lines. Tables of low confidence are a paragraph a row. Images come last. A page without any of these
    gets its plain lines as one paragraph. One pass over the parsed rows, one shuffle on (doc_id, page).
    """
    page = parsed.where("kind = 'page'").select("doc_id", "page", array_statistics(F.col("content.sizes")).alias("s"), F.explode(_elements(F.col("content"), F.col("page"))).alias("e"))
    rows = page.select("doc_id", "page", F.col("s.body_size").alias("body_size"), F.col("s.heading_sizes").alias("heading_sizes"), "e.rank", F.col("e.ord").alias("line_ord"), "e.line.*", "e.block")
    keys = (*PAGE_KEYS, "rank")
    rows = number_blocks(mark_headings(rows, PAGE_KEYS_RANK), PAGE_KEYS_RANK)
    lines = F.sort_array(F.collect_list(F.struct("line_ord", "text", "y")))
    found = rows.groupBy(*keys, F.when(F.col("rank") == 2, F.col("block_ord")).otherwise(F.col("line_ord")).alias("ord")).agg(
        lines.alias("own"), F.first("block").alias("block"), F.coalesce(F.min(F.when(F.col("heading_level") > 0, F.col("heading_level"))), F.lit(0)).alias("heading_level"))
    text = F.array_join(F.transform("own", lambda x: x["text"]), " ")
    made = _block(2, F.col("ord"), -F.col("own")[0]["y"], "paragraph", text, F.lit(None)).withField("heading_level", F.col("heading_level"))
    found = found.where((F.col("rank") != 2) | (F.regexp_replace(text, r"(?U)\s", "") != "")).select("doc_id", "page", F.when(F.col("rank") == 2, made).otherwise(F.col("block")).alias("b"))
    found = found.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("b")).alias("all"))
    body, images = F.filter("all", lambda b: b["at"]["rank"] < 4), F.filter("all", lambda b: b["at"]["rank"] == 4)
    tabled = F.exists("all", lambda b: b["at"]["rank"] < 2)
    flow = F.array_sort(body, lambda a, b: F.when(a["at"]["ord"] < b["at"]["ord"], -1).when(a["at"]["ord"] > b["at"]["ord"], 1).otherwise(0))
    found = found.select("doc_id", "page", F.concat(F.when(tabled, merge_rows(body)).otherwise(flow), F.array_sort(images, lambda a, b: a["at"]["ord"] - b["at"]["ord"])).alias("all"))
    return found.select("doc_id", "page", F.posexplode("all").alias("block_ord", "b")).select("doc_id", "page", "block_ord", "b.type", "b.text", "b.heading_level", "b.cells", "b.resource_id", "b.width", "b.height")


def merge_rows(blocks: Column) -> Column:
    """A fold: a plain paragraph within SAME_ROW points of the paragraph before it is appended to that one."""

    def step(acc, b):
        last = F.element_at(acc, -1)
        both = (F.size(acc) > 0) & (b["type"] == "paragraph") & (last["type"] == "paragraph") & (b["heading_level"] == 0) & (last["heading_level"] == 0) & (F.abs(b["at"]["down"] - last["at"]["down"]) <= SAME_ROW)
        glue = F.when(last["text"].rlike(r"(?U)\s\z") | b["text"].rlike(r"(?U)\A\s"), "").otherwise(" ")
        joined = last.withField("text", F.concat(last["text"], glue, b["text"]))
        return F.when(F.coalesce(both, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(blocks, F.array().cast(f"array<{BLOCK}>"), lambda acc, b: F.when(F.size(acc) == 0, F.array(b)).otherwise(step(acc, b)))


def shown_images(images: Column, page: Column, least: int | None = None) -> Column:
    """Of an array of images those that a viewer can show, with their resource ids; those known to be smaller
    than `least` (if not given: than parsing's min_image_size) are left out."""
    named = lambda i: i.withField("extension", extension_of(i["mime"])).withField("resource_id", F.concat(F.lit("page"), page.cast("string"), F.lit("_"), i["name"], F.lit("."), extension_of(i["mime"])))
    large = lambda i: i["large"] if least is None else i["width"].isNull() | i["height"].isNull() | (F.least(i["width"], i["height"]) >= least)
    return F.filter(F.transform(images, named), lambda i: i["mime"].startswith("image/") & ~i["extension"].isin("raw", "bin") & large(i))


def page_images(parsed: DataFrame, least: int | None = None) -> DataFrame:
    """A row for each image of shown_images."""
    rows = parsed.where("kind = 'page'").select("doc_id", "page", F.posexplode(shown_images(F.col("content.images"), F.col("page"), least)).alias("ord", "i"))
    return rows.select("doc_id", "page", "ord", "i.*")
