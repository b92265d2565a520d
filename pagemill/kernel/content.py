"""A page's content stream as positioned spans and operator counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import hypot

import numpy as np

from .fonts import Font
from .objects import Name, operations

TEXT_OPERATORS = ("Tj", "TJ", "'", '"')
LEADING, LATIN_GAP, HANGUL_GAP = 12.0, 200, 500
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
# Code point ranges of scripts without word spaces, and of Hangul.
SPACELESS = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF), (0x3040, 0x30FF), (0x3000, 0x303F)]
HANGUL = [(0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xD7B0, 0xD7FF)]


def char_class(ranges) -> re.Pattern:
    """Matches one character of the code point ranges."""
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


def within(char: str, ranges) -> bool:
    return any(a <= ord(char) <= b for a, b in ranges)


@dataclass
class PageText:
    spans: list[dict] = field(default_factory=list)
    text_ops: int = 0
    image_ops: int = 0
    covered: bool = False
    shown: int = 0
    unseen: int = 0


def _numbers(operands, count, default=UNIT):
    if len(operands) < count:
        return None
    return tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else d for x, d in zip(operands, default))


def _multiply(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _join(parts, font: Font) -> str:
    """Text of a TJ array: a large move to the right stands for a space, but not in scripts without spaces."""
    out = ""
    for x in parts:
        if isinstance(x, bytes):
            out += font.decode(x)
        elif isinstance(x, (int, float)) and out and out[-1] not in " \xa0" and not within(out[-1], SPACELESS) and -x > (HANGUL_GAP if within(out[-1], HANGUL) else LATIN_GAP):
            out += " "
    return out


def interpret(data: bytes, fonts: dict[str, Font], size: tuple[float, float], spec_matrices: bool = False) -> PageText:
    """Runs the operators that matter for text. With spec_matrices `cm` goes before the current matrix, as the format has
    it; otherwise after it."""
    page, area = PageText(), size[0] * size[1]
    ctm, mode, stack = UNIT, 0, []
    matrix, inside = UNIT, False
    font, font_size = Font(None, None, ""), 12.0

    def show(text: str):
        if not text.strip():
            return
        chars = sum(map(len, text.split()))
        page.shown += chars
        page.unseen += chars if mode in (3, 7) else 0
        x, y = ctm[0] * matrix[4] + ctm[2] * matrix[5] + ctm[4], ctm[1] * matrix[4] + ctm[3] * matrix[5] + ctm[5]
        scale = hypot(matrix[0], matrix[2]) * max(hypot(ctm[2], ctm[3]), 0.01)
        page.spans.append({"text": text, "x": float(np.float32(x)), "y": float(np.float32(y)), "width": 0.0, "font_size": float(np.float32(font_size * scale)), "font_name": font.base})

    for op, args in operations(data):
        page.text_ops += op in TEXT_OPERATORS
        if op == "q":
            stack.append((ctm, mode))
        elif op == "Q" and stack:
            ctm, mode = stack.pop()
        elif op == "cm" and (m := _numbers(args, 6)):
            ctm = _multiply(m, ctm) if spec_matrices else _multiply(ctm, m)
        elif op == "Tr" and args and isinstance(args[0], (int, float)):
            mode = int(args[0])
        elif op == "Do":
            page.image_ops += 1
            if area > 0 and hypot(ctm[0], ctm[1]) * hypot(ctm[2], ctm[3]) / area >= 0.9:
                page.covered = True
        elif op == "BT":
            matrix, inside = UNIT, True
        elif op == "ET":
            inside = False
        elif op == "Tf" and len(args) >= 2:
            if isinstance(args[0], Name):
                font = fonts.get(str(args[0])) or Font(None, None, str(args[0]))
            font_size = float(args[1]) if isinstance(args[1], (int, float)) else 12.0
        elif op in ("Td", "TD") and (m := _numbers(args, 2, (0.0, 0.0))):
            matrix = (*matrix[:4], matrix[4] + m[0] * matrix[0] + m[1] * matrix[2], matrix[5] + m[0] * matrix[1] + m[1] * matrix[3])
        elif op == "Tm" and (m := _numbers(args, 6)):
            matrix = m
        elif op in ("T*", "'", '"'):
            matrix = (*matrix[:5], matrix[5] - LEADING * matrix[3])
        if inside:
            if op == "Tj" and args and isinstance(args[0], bytes):
                show(font.decode(args[0]))
            elif op == "TJ" and args and isinstance(args[0], list):
                show(_join(args[0], font))
            elif op in ("'", '"'):
                at = 2 if op == '"' else 0
                if len(args) > at and isinstance(args[at], bytes):
                    show(font.decode(args[at]))
    return page
