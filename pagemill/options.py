"""Options of parsing and rendering, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

from .functions.cleanup import CleanupOptions


@dataclass(frozen=True)
class PageSelection:
    """All pages, an inclusive range, or a list."""

    pages: tuple[int, ...] | None = None
    low: int | None = None
    high: int | None = None

    @classmethod
    def parse(cls, text: str) -> PageSelection:
        text = text.strip()

        def number(part: str) -> int:
            part = part.strip().removeprefix("+")
            if not (part.isascii() and part.isdigit()):
                raise ValueError(f"no page number: {part!r}")
            return int(part)

        if text in ("", "all"):
            return cls()
        if "-" in text and "," not in text:
            low, high = text.split("-", 1)
            return cls(low=number(low), high=number(high))
        pages: set[int] = set()
        for part in text.split(","):
            low, dash, high = part.strip().partition("-")
            pages.update(range(number(low), number(high) + 1) if dash else [number(low)])
        return cls(pages=tuple(sorted(pages)))

    def includes(self, page: int) -> bool:
        if self.pages is not None:
            return page in self.pages
        return self.low is None or self.low <= page <= self.high

    def column(self, page: Column) -> Column:
        if self.pages is not None:
            return page.isin(list(self.pages))
        return F.lit(True) if self.low is None else page.between(self.low, self.high)


@dataclass(frozen=True)
class ParseOptions:
    """What to read from a file. password is tried after the empty one; memory limits are the cluster's.

    Images known to be narrower or lower than min_image_size are no elements of their page, but stay in the image table. Without `layout` no lines and tables are
    built, for those who only want spans, counts or images. With spec_matrices `cm` is applied as the format has it.
    """

    lenient: bool = True
    pages: PageSelection = field(default_factory=PageSelection)
    mode: str = "full"  # full, text_only, structure_only
    extract_resources: bool = True
    min_image_size: int = 64
    suppress_low_confidence_ocr: bool = True
    password: str = ""
    estimate_widths: bool = False  # a span's width is zero unless estimated
    layout: bool = True
    spec_matrices: bool = False

    def but(self, **changes) -> ParseOptions:
        return replace(self, **changes)


@dataclass(frozen=True)
class RenderOptions:
    """How to write Markdown and text. line_width, heading_config and image_dir are accepted and change nothing."""

    include_frontmatter: bool = False
    pages: PageSelection = field(default_factory=PageSelection)
    page_markers: bool = False
    table_fallback: str = "markdown"  # markdown, html, ascii (as markdown)
    max_heading_level: int = 6
    list_marker: str = "-"
    image_path_prefix: str = ""
    preserve_line_breaks: bool = False
    escape_special_chars: bool = True
    cleanup: CleanupOptions | None = field(default_factory=CleanupOptions)
    streaming_images: bool = False
    line_width: int = 0
    heading_config: object = None
    image_dir: str | None = None

    def but(self, **changes) -> RenderOptions:
        return replace(self, **changes)
