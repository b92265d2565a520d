"""Converters by name and file extension."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..options import ParseOptions, RenderOptions


@dataclass(frozen=True)
class ConvertOptions:
    format: str = "markdown"  # markdown, text, json
    parse: ParseOptions = field(default_factory=ParseOptions)
    render: RenderOptions = field(default_factory=RenderOptions)
    stats: bool = False


class Converter(Protocol):
    name: str
    extensions: tuple[str, ...]

    def convert(self, files: DataFrame, options: ConvertOptions) -> DataFrame: ...


class PdfConverter:
    name, extensions = "pdf", ("pdf",)
    MIME = {"markdown": "text/markdown", "text": "text/plain", "json": "application/json"}

    def convert(self, files: DataFrame, options: ConvertOptions) -> DataFrame:
        """(doc_id, content, mime_type), and the counts of the text if asked for."""
        from ..operators.layout import page_blocks
        from ..operators.quality import extraction_stats
        from ..plans import render
        from .pdf import parse_files

        parsed = parse_files(files, options.parse)
        blocks = page_blocks(parsed)
        make = {"markdown": lambda: render.markdown(parsed, blocks, options.render), "text": lambda: render.plain_text(parsed, blocks, options.render), "json": lambda: render.json_documents(parsed, blocks)}
        out = make[options.format]().toDF("doc_id", "content").withColumn("mime_type", F.lit(self.MIME[options.format]))
        return out.join(extraction_stats(blocks), "doc_id", "left") if options.stats else out


class ConverterRegistry:
    """Names and extensions are compared without case; a later registration replaces an earlier one."""

    def __init__(self):
        self._by_name: dict[str, Converter] = {}
        self._by_extension: dict[str, Converter] = {}

    @classmethod
    def with_defaults(cls) -> ConverterRegistry:
        out = cls()
        out.register(PdfConverter())
        return out

    def register(self, converter: Converter) -> None:
        self._by_name[converter.name.lower()] = converter
        for extension in converter.extensions:
            self._by_extension[extension.lower()] = converter

    def get_by_name(self, name: str) -> Converter | None:
        return self._by_name.get(name.lower())

    def get_by_extension(self, extension: str) -> Converter | None:
        return self._by_extension.get(extension.lower().lstrip("."))

    def supports(self, extension: str) -> bool:
        return self.get_by_extension(extension) is not None

    def supported_extensions(self) -> list[str]:
        return sorted(self._by_extension)

    def convert(self, files: DataFrame, options: ConvertOptions | None = None) -> DataFrame:
        """Dispatches (doc_id, content) rows by the extension of doc_id; files of no converter are left out."""
        out, extension = None, F.lower(F.element_at(F.split("doc_id", r"\."), -1))
        for converter in dict.fromkeys(self._by_extension.values()):
            own = converter.convert(files.where(extension.isin([e for e, c in self._by_extension.items() if c is converter])), options or ConvertOptions())
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        if out is None:
            raise ValueError("no converter is registered")
        return out
