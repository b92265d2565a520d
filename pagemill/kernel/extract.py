"""One file's bytes to rows: a document row, a row a page, and error rows."""

from __future__ import annotations

import re

from .content import PageText, interpret
from .document import Document
from .fonts import page_fonts
from .layout import detect_tables, page_lines
from .objects import PdfError

# Characters that failed recognition leaves: jamo and radicals, which count as no letters here.
_NOISE = re.compile("[ᄀ-ᇿ㄰-㆏ﾠ-ￜ⺀-⻿⼀-⿟]")
_PAGE_NUMBER = re.compile(r"[0-9]*|([-–—])\s*[0-9]*\s*\1|[Pp]age \s*[0-9]*\s*|[/\s]*[0-9]+[/\s]+of[/\s]+[0-9]+[/\s]*")
_FRACTION = re.compile(r"[/\s]*[0-9]+[/\s]+[0-9]+[/\s]*")


def is_incoherent(text: str) -> bool:
    tokens = text.split()
    chars = sum(map(len, tokens))
    if chars < 40:
        return False
    means = lambda c: (c.isalpha() or c.isnumeric()) and not _NOISE.match(c)
    like = sum(len(t) >= 2 and any(map(means, t)) for t in tokens) / len(tokens)
    return like < 0.40 and sum(map(means, text)) / chars < 0.55


def is_page_number(text: str) -> bool:
    text = text.strip()
    return bool(_PAGE_NUMBER.fullmatch(text)) or ("/" in text and bool(_FRACTION.fullmatch(text)))


def drop_margins(spans: list[dict], height: float) -> list[dict]:
    """Without page numbers and blanks in the top and bottom twentieth of the page."""
    edge = height * 0.05
    if height <= 0:
        return spans
    return [s for s in spans if edge < s["y"] < height - edge or not is_page_number(s["text"])]


def parse(content: bytes, options) -> list[dict]:
    """Rows as SCHEMA in sources.pdf has them; a defect of the whole file is one error row."""
    try:
        doc = Document(content, options.password)
        pages = doc.pages()
    except PdfError as e:
        return [_error(0, e.kind, str(e))]
    except Exception as e:  # a defect no check foresaw must not fail the job
        return [_error(0, "Unreadable", f"{type(e).__name__}: {e}")]
    numbers = {ref.number: k for k, (ref, _) in enumerate(pages, 1) if ref}
    meta = doc.metadata()
    document = {
        "title": meta["Title"], "author": meta["Author"], "subject": meta["Subject"], "keywords": meta["Keywords"], "creator": meta["Creator"], "producer": meta["Producer"],
        "created": meta["CreationDate"], "modified": meta["ModDate"], "pdf_version": doc.version, "page_count": len(pages), "encrypted": doc.encrypted, "tagged": False,
        "outline": _safely(lambda: [dict(zip(("item_id", "parent_id", "ord", "level", "title", "page"), r)) for r in doc.outline(numbers)], []),
        "fields": _safely(lambda: [{"name": n, "type": t, "value": _value(v), "default": _value(d)} for n, t, v, d in doc.fields()], []),
    }
    rows = [{"kind": "document", "page": 0, "document": document}]
    memory: dict = {}
    for number, (_, page) in enumerate(pages, 1):
        if not options.pages.includes(number):
            continue
        try:
            rows.append({"kind": "page", "page": number, "content": _page(doc, page, number, memory, options)})
        except Exception as e:
            rows.append(_error(number, getattr(e, "kind", "BadPage"), str(e)))
    return rows


def _safely(make, default):
    try:
        return make()
    except Exception:
        return default


def _error(page: int, kind: str, message: str) -> dict:
    return {"kind": "error", "page": page, "error": {"class": kind, "message": message}}


def _value(v):
    return None if v is None else dict(zip(("kind", "text", "bool", "choices"), v))


def _page(doc: Document, page: dict, number: int, memory: dict, options) -> dict:
    width, height = doc.page_size(page)
    found = PageText()
    if options.mode != "structure_only":
        found = interpret(doc.content(page), page_fonts(doc, page, memory), (width, height), options.spec_matrices)
    scanned = found.covered and found.shown > 0 and found.unseen / found.shown >= 0.9
    dropped = options.suppress_low_confidence_ocr and scanned and is_incoherent(" ".join(s["text"] for s in found.spans))
    spans = [] if dropped else found.spans
    body = drop_margins(spans, height)
    tables, rest = detect_tables(body) if options.layout else ([], [])
    lines = page_lines(rest, options.estimate_widths) if options.layout else []
    out = {
        "width": width, "height": height, "text_op_count": found.text_ops, "image_op_count": found.image_ops, "page_image": found.covered, "shown_chars": found.shown, "unseen_chars": found.unseen,
        "ocr_text_suppressed": dropped, "spans": spans, "lines": lines, "sizes": [s["font_size"] for s in rest], "tables": tables, "images": [],
        "fallback": "\n".join(x["text"] for x in page_lines(spans, options.estimate_widths)) if options.layout and spans and not lines and not tables else None,
    }
    if options.extract_resources and options.mode != "structure_only":
        for name, info, data, mime in doc.images(page):
            size = [doc.resolve(info.get(k)) for k in ("Width", "Height", "BitsPerComponent")]
            large = not all(isinstance(v, int) for v in size[:2]) or min(size[:2]) >= options.min_image_size
            space = doc.resolve(info.get("ColorSpace"))
            space = space[0] if isinstance(space, list) and space else space
            out["images"].append({"name": name, "data": data, "mime": mime, "width": _int(size[0]), "height": _int(size[1]), "bits": _int(size[2]), "color_space": str(space) if isinstance(space, str) else None, "large": large})
    return out


def _int(x):
    return x if isinstance(x, int) else None
