"""Extraction quality, statistics, and the deduplication of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tf
from ..sources import pdf

SCAN_SAMPLE = 5


def text_quality(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows plus char_count, word_count, replacement_char_count, replacement_ratio, is_good."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("char_count", F.length(t)).withColumn("word_count", tf.word_count(t)).withColumn("replacement_char_count", tf.replacement_count(t))
    chars, replaced = F.col("char_count"), F.col("replacement_char_count")
    return rows.withColumn("replacement_ratio", tf.replacement_ratio(chars, replaced)).withColumn("is_good", tf.is_good(chars, replaced))


def scan_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, is_scan_pdf): the first five pages show no text but draw something."""
    first = pages.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("k") <= SCAN_SAMPLE)
    return first.groupBy("doc_id").agg(((F.sum("text_op_count") == 0) & (F.sum("image_op_count") > 0)).alias("is_scan_pdf"))


def classify_pages(pages: DataFrame) -> DataFrame:
    kind = F.when(F.col("text_op_count") > 0, "text").when(F.col("image_op_count") > 0, "image_only").otherwise("blank")
    return pages.withColumn("page_class", kind)


def table_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, "\t")), "\n")


def block_text(blocks: DataFrame) -> DataFrame:
    """blocks plus plain: the text that an element contributes."""
    return blocks.withColumn("plain", F.when(F.col("type") == "table", table_text(F.col("cells"))).when(F.col("type") == "paragraph", F.col("text")).otherwise(""))


def document_quality(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a document. Blocks add up on their own, since a line break after each keeps their words apart."""
    own = block_text(blocks).where(F.col("type").isin("paragraph", "table"))
    sums = own.groupBy("doc_id").agg(F.sum(F.length("plain") + 1).alias("char_count"), F.sum(tf.word_count(F.col("plain"))).alias("word_count"), F.sum(tf.replacement_count(F.col("plain"))).alias("replacement_char_count"))
    pages = pdf.pages(parsed)
    dropped = pages.groupBy("doc_id").agg(F.count_if("ocr_text_suppressed").alias("suppressed_ocr_pages"))
    out = pdf.metadata(parsed).select("doc_id", "encrypted").join(sums, "doc_id", "left").join(scan_documents(pages), "doc_id", "left").join(dropped, "doc_id", "left")
    out = out.na.fill(0, ["char_count", "word_count", "replacement_char_count", "suppressed_ocr_pages"]).na.fill(False, ["is_scan_pdf"])
    c = F.col
    return (
        out.withColumn("replacement_ratio", tf.replacement_ratio(c("char_count"), c("replacement_char_count")))
        .withColumn("is_good", tf.is_good(c("char_count"), c("replacement_char_count")))
        .withColumn("warning", tf.warning(c("encrypted"), c("char_count"), c("is_scan_pdf"), c("suppressed_ocr_pages"), c("replacement_char_count")))
    )


def extraction_stats(blocks: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Counts of pages, paragraphs, headings, tables, images, words and characters that are no white space."""
    own = block_text(blocks)
    plain = F.col("plain")
    return own.groupBy(*keys).agg(
        F.countDistinct("page").alias("page_count"), F.count_if((F.col("type") == "paragraph") & (F.col("heading_level") == 0)).alias("paragraph_count"),
        F.count_if((F.col("type") == "paragraph") & (F.col("heading_level") > 0)).alias("heading_count"), F.count_if(F.col("type") == "table").alias("table_count"),
        F.count_if(F.col("type") == "image").alias("image_count"), F.sum(tf.word_count(plain)).alias("word_count"), F.sum(F.length(F.regexp_replace(plain, r"(?U)\s", ""))).alias("char_count"))


def document_info(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Metadata with words, text bytes, images and bookmarks."""
    own = block_text(blocks)
    plain = own.groupBy("doc_id").agg(F.sum(tf.word_count(F.col("plain"))).alias("word_count"), F.sum(F.octet_length("plain")).alias("text_bytes"))
    pictures = pdf.images(parsed).groupBy("doc_id").agg(F.count("*").alias("image_count"))
    marks = pdf.outline(parsed).groupBy("doc_id").agg(F.count("*").alias("bookmark_count"))
    out = pdf.metadata(parsed).join(plain, "doc_id", "left").join(pictures, "doc_id", "left").join(marks, "doc_id", "left")
    return out.na.fill(0, ["word_count", "text_bytes", "image_count", "bookmark_count"])


def content_key(data: Column) -> list[Column]:
    """Equal for equal images: length, first and last 64 bytes; the work does not grow with the image."""
    return [F.octet_length(data).alias("key_size"), F.substring(data, 1, 64).alias("key_head"), F.when(F.octet_length(data) > 64, F.substring(data, -64, 64)).otherwise(F.lit(b"")).alias("key_tail")]


def dedup_by_content(rows: DataFrame, data: str, order: list[str], keys: list[str], name: str) -> DataFrame:
    """rows plus first_<name> (the earliest row of equal content within keys) and is_first; no row is dropped."""
    marked = rows.select("*", *content_key(F.col(data)))
    w = Window.partitionBy(*keys, "key_size", "key_head", "key_tail")
    first = F.min_by(F.col(name), F.struct(*order)).over(w)
    return marked.withColumn(f"first_{name}", first).withColumn("is_first", F.col(name) == F.col(f"first_{name}")).drop("key_size", "key_head", "key_tail")
