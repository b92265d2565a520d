"""Writers: tables for a cluster, and a folder of files a document."""

from __future__ import annotations

import os
from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from ..operators.layout import page_blocks, page_images
from ..operators.quality import dedup_by_content, extraction_stats
from ..options import RenderOptions
from . import render

FORMATS = {"markdown": "extract.md", "text": "extract.txt", "json": "content.json"}


def rendered(parsed: DataFrame, blocks: DataFrame, formats=tuple(FORMATS), options: RenderOptions | None = None) -> DataFrame:
    """(doc_id, format, file, body). Cleanup is for Markdown alone, as a last step; text and JSON stay as parsed."""
    options = options or RenderOptions()
    plain = options.but(cleanup=None)
    make = {
        "markdown": lambda: render.markdown(parsed, blocks, options).withColumnRenamed("markdown", "body"),
        "text": lambda: render.plain_text(parsed, blocks, plain).withColumnRenamed("text", "body"),
        "json": lambda: render.json_documents(parsed, blocks).withColumnRenamed("json", "body"),
    }
    out = None
    for name in formats:
        own = make[name]().select("doc_id", F.lit(name).alias("format"), F.lit(FORMATS[name]).alias("file"), "body")
        out = own if out is None else out.unionByName(own)
    return out


def unique_images(parsed: DataFrame, least: int | None = None) -> DataFrame:
    """Images with first_resource_id, the id under which equal content of the document is kept."""
    return dedup_by_content(page_images(parsed, least), "data", ["page", "ord"], ["doc_id"], "resource_id")


def redirect_images(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """blocks whose image references name the kept copy."""
    to = images.select("doc_id", "page", F.col("resource_id").alias("old"), "first_resource_id").distinct()
    joined = blocks.join(to, (blocks["doc_id"] == to["doc_id"]) & (blocks["page"] == to["page"]) & (blocks["resource_id"] == to["old"]), "left").drop(to["doc_id"]).drop(to["page"])
    return joined.withColumn("resource_id", F.coalesce("first_resource_id", "resource_id")).drop("old", "first_resource_id")


def write_tables(parsed: DataFrame, path: str, formats=tuple(FORMATS), options: RenderOptions | None = None) -> DataFrame:
    """Renderings and images as Parquet below path; the summary, one row a document."""
    blocks = page_blocks(parsed)
    images = unique_images(parsed)
    rendered(parsed, redirect_images(blocks, images), formats, options).write.mode("overwrite").partitionBy("format").parquet(f"{path}/documents")
    images.where("is_first").select("doc_id", "page", "resource_id", "mime", "width", "height", "data").write.mode("overwrite").parquet(f"{path}/images")
    return summary(blocks, images)


def summary(blocks: DataFrame, images: DataFrame) -> DataFrame:
    kept = images.where("is_first").groupBy("doc_id").agg(F.count("*").alias("images_written"))
    return extraction_stats(blocks).join(kept, "doc_id", "left").na.fill(0, ["images_written"]).select("doc_id", "word_count", F.col("images_written").alias("image_count"))


def folder_name(doc_id: str) -> str:
    """A document's folder: its id, and if a character had to be replaced or left out, a hash that keeps ids apart."""
    name = "".join(c if c.isalnum() or c in "-_." else "_" for c in doc_id)[-150:]
    return name if name == doc_id else f"{name}-{sha256(doc_id.encode()).hexdigest()[:16]}"


def write_files(parsed: DataFrame, folder: str, formats=tuple(FORMATS), options: RenderOptions | None = None) -> DataFrame:
    """A folder a document with its renderings and an images folder, written by the tasks; folder is a path that driver
    and executors share. Each file is written whole under another name and renamed, so a task that runs again is harmless."""
    blocks = page_blocks(parsed)
    images = unique_images(parsed)
    texts = rendered(parsed, redirect_images(blocks, images), formats, options).select("doc_id", "file", F.encode("body", "UTF-8").alias("data"))
    pictures = images.where("is_first").select("doc_id", F.concat(F.lit("images/"), "resource_id").alias("file"), "data")

    def put(rows):
        for r in rows:
            path = os.path.join(folder, folder_name(r.doc_id), r.file)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.{os.getpid()}.part", "wb") as f:
                f.write(r.data)
            os.replace(f"{path}.{os.getpid()}.part", path)

    texts.unionByName(pictures).foreachPartition(put)
    return summary(blocks, images)
