"""Single-call functions and a fluent builder over the DataFrame operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .functions.cleanup import CleanupOptions
from .operators import layout, quality
from .options import PageSelection, ParseOptions, RenderOptions
from .plans import render
from .sources import pdf

VERSION = "0.1.0"


def version() -> str:
    return VERSION


@dataclass(frozen=True)
class Pdf:
    """Pdf(spark).lenient().with_pages("1-3").parse("/data/*.pdf").to_markdown(): every step gives a new value."""

    spark: SparkSession
    parse_options: ParseOptions = field(default_factory=ParseOptions)
    render_options: RenderOptions = field(default_factory=RenderOptions)

    def _parse(self, **changes) -> Pdf:
        return Pdf(self.spark, self.parse_options.but(**changes), self.render_options)

    def _render(self, **changes) -> Pdf:
        return Pdf(self.spark, self.parse_options, self.render_options.but(**changes))

    def lenient(self) -> Pdf:
        return self._parse(lenient=True)

    def strict(self) -> Pdf:
        return self._parse(lenient=False)

    def text_only(self) -> Pdf:
        return self._parse(mode="text_only")

    def sequential(self) -> Pdf:
        return self  # tasks are the cluster's business

    def with_images(self, on: bool = True) -> Pdf:
        return self._parse(extract_resources=on)

    def with_image_dir(self, folder: str) -> Pdf:
        return self._render(image_dir=folder)

    def with_image_prefix(self, prefix: str) -> Pdf:
        return self._render(image_path_prefix=prefix)

    def with_frontmatter(self, on: bool = True) -> Pdf:
        return self._render(include_frontmatter=on)

    def with_table_fallback(self, kind: str) -> Pdf:
        return self._render(table_fallback=kind)

    def with_cleanup(self, preset: str | None) -> Pdf:
        return self._render(cleanup=CleanupOptions.preset(preset) if preset else None)

    def with_password(self, password: str) -> Pdf:
        return self._parse(password=password)

    def with_ocr_suppression(self, on: bool) -> Pdf:
        return self._parse(suppress_low_confidence_ocr=on)

    def with_pages(self, selection: str) -> Pdf:
        pages = PageSelection.parse(selection)
        return Pdf(self.spark, self.parse_options.but(pages=pages), self.render_options.but(pages=pages))

    def parse(self, path: str) -> Parsed:
        """Files below a path or glob, read by Spark."""
        return self.parse_rows(pdf.binary_files(self.spark, path))

    def parse_rows(self, files: DataFrame) -> Parsed:
        """Any (doc_id, content) rows."""
        return Parsed(pdf.parse_files(files, self.parse_options), self.render_options)

    def parse_bytes(self, content: bytes) -> Parsed:
        return self.parse_rows(self.spark.createDataFrame([("bytes", bytearray(content))], "doc_id string, content binary"))


class Parsed:
    """Tables of parsed files, each computed when asked for; persist() if several are needed."""

    def __init__(self, rows: DataFrame, options: RenderOptions):
        self.rows, self.options = rows, options

    def persist(self) -> Parsed:
        self.rows = self.rows.persist()
        return self

    @property
    def blocks(self) -> DataFrame:
        return layout.page_blocks(self.rows)

    def document(self) -> DataFrame:
        return pdf.metadata(self.rows)

    def pages(self) -> DataFrame:
        return quality.classify_pages(pdf.pages(self.rows))

    def to_markdown(self) -> DataFrame:
        return render.markdown(self.rows, self.blocks, self.options)

    def to_markdown_with_stats(self) -> DataFrame:
        return self.to_markdown().join(quality.extraction_stats(self.blocks), "doc_id", "left")

    def to_text(self) -> DataFrame:
        return render.plain_text(self.rows, self.blocks, self.options)

    def plain_text(self) -> DataFrame:
        return render.plain_text(self.rows, self.blocks, self.options.but(cleanup=None))

    def to_json(self, pretty: bool = False) -> DataFrame:
        return render.json_documents(self.rows, self.blocks, pretty)

    def quality(self) -> DataFrame:
        return quality.document_quality(self.rows, self.blocks)

    def info(self) -> DataFrame:
        return quality.document_info(self.rows, self.blocks)

    def errors(self) -> DataFrame:
        return pdf.errors(self.rows)


def _one(df: DataFrame) -> Row:
    row = df.first()
    if row is None:
        raise ValueError("the file has no document; see errors()")
    return row


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _parsed(path: str) -> Parsed:
    return Pdf(_session()).parse(path)


def to_markdown(path: str) -> str:
    return _one(_parsed(path).to_markdown()).markdown


def to_text(path: str) -> str:
    return _one(_parsed(path).to_text()).text


def to_json(path: str, pretty: bool = False) -> str:
    return _one(_parsed(path).to_json(pretty)).json


def get_info(path: str) -> dict:
    return _one(_parsed(path).info()).asDict(True)


def get_extraction_quality(path: str) -> dict:
    return _one(_parsed(path).quality()).asDict(True)


def get_page_stats(path: str, page: int) -> dict:
    return _one(_parsed(path).pages().where(F.col("page") == page)).asDict(True)


def page_to_markdown(path: str, page: int) -> str:
    return _one(Pdf(_session()).with_pages(str(page)).parse(path).to_markdown()).markdown


def page_to_text(path: str, page: int) -> str:
    return _one(Pdf(_session()).with_pages(str(page)).parse(path).to_text()).text


def get_page_count(path: str) -> int:
    """-1 if the file cannot be read."""
    row = _parsed(path).document().first()
    return -1 if row is None else row.page_count


def is_pdf(path: str) -> bool:
    row = pdf.detect(pdf.binary_files(_session(), path, "*")).select("is_pdf").first()
    return bool(row and row.is_pdf)


def resources(path: str) -> list[dict]:
    found = layout.page_images(_parsed(path).rows, least=0).select("resource_id", "mime", "width", "height", F.octet_length("data").alias("size"))
    return [r.asDict() for r in found.orderBy("resource_id").collect()]


def dumps(value: dict) -> str:
    return json.dumps(value, default=str, ensure_ascii=False)
