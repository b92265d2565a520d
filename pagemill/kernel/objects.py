"""PDF object syntax: one scanner for file bodies, object streams and content streams."""

from __future__ import annotations

import re
from dataclasses import dataclass


class PdfError(Exception):
    """A defect of the file; `kind` becomes the error_class column."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


class Name(str):
    __slots__ = ()


class Keyword(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    info: dict
    raw: bytes


END = object()
_SPACE = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_HEX = re.compile(rb"<([^>]*)>")
_TEXT = re.compile(rb"[()\\\r]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def skip(data: bytes, at: int) -> int:
    return _SKIP.match(data, at).end()


def _name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("latin-1"))


def _text(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string; `at` is after its opening parenthesis."""
    out, depth = [], 1
    while True:
        m = _TEXT.search(data, at)
        if not m:
            return b"".join([*out, data[at:]]), len(data)
        out.append(data[at : m.start()])
        c, at = m[0], m.end()
        if c == b"(":
            depth += 1
            out.append(c)
        elif c == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(c)
        elif c == b"\r":
            out.append(b"\n")
            at += data[at : at + 1] == b"\n"
        else:
            e = data[at : at + 1]
            if e in b"01234567" and e:
                digits = re.compile(rb"[0-7]{1,3}").match(data, at)
                out.append(bytes([int(digits[0], 8) & 255]))
                at = digits.end()
            elif e in (b"\r", b"\n"):
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out.append(_ESCAPES.get(e, e))
                at += 1


def read(data: bytes, at: int, refs: bool = True):
    """(object, position after it); END at the end, Keyword for anything that is no object."""
    at = skip(data, at)
    c = data[at : at + 1]
    if not c:
        return END, at
    if c == b"/":
        m = _NAME.match(data, at)
        return _name(m[1]), m.end()
    if c == b"(":
        return _text(data, at + 1)
    if c == b"<":
        if data[at + 1 : at + 2] == b"<":
            return _dict(data, at + 2, refs)
        m = _HEX.match(data, at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", m[1] if m else data[at + 1 :])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), m.end() if m else len(data)
    if c == b"[":
        out, at = [], at + 1
        while True:
            x, at = read(data, at, refs)
            if x is END or isinstance(x, Keyword) and x == "]":
                return out, at
            if not isinstance(x, Keyword):
                out.append(x)
    if c in b"]{}":
        return Keyword(c.decode()), at + 1
    if c in b">)":
        return Keyword(">>"), at + (2 if data[at : at + 2] == b">>" else 1)
    if refs and (m := _REF.match(data, at)):
        return Ref(int(m[1]), int(m[2])), m.end()
    if m := _NUMBER.match(data, at):
        word = m[0]
        return (float(word) if b"." in word else int(word)), m.end()
    m = _WORD.match(data, at)
    return (_CONSTANTS[m[0]] if m[0] in _CONSTANTS else Keyword(m[0].decode("latin-1"))), m.end()


def _dict(data: bytes, at: int, refs: bool):
    out = {}
    while True:
        key, at = read(data, at, refs)
        if key is END or isinstance(key, Keyword):
            return out, at
        value, at = read(data, at, refs)
        if value is END:
            return out, at
        if isinstance(value, Keyword):
            return out, at
        if isinstance(key, Name):
            out[str(key)] = value


_STREAM = re.compile(rb"stream(\r\n|\n|\r)?")


def read_indirect(data: bytes, at: int, length_of=None):
    """(number, generation, object) of `N G obj ...` at a position; a stream's length is checked against endstream."""
    number, at = read(data, at, refs=False)
    generation, at = read(data, at, refs=False)
    word, at = read(data, at, refs=False)
    if word != "obj" or not isinstance(number, int) or not isinstance(generation, int):
        raise PdfError("BadObject", f"no object at {at}")
    value, at = read(data, at)
    if isinstance(value, dict) and (m := _STREAM.match(data, skip(data, at))):
        start, size = m.end(), value.get("Length")
        if isinstance(size, Ref) and length_of:
            size = length_of(size)
        fits = isinstance(size, int) and 0 <= size <= len(data) - start
        if not (fits and data.startswith(b"endstream", skip(data, start + size))):
            end = data.find(b"endstream", start)
            if end < 0:
                raise PdfError("BadStream", "endstream is missing")
            size = end - start
            for tail in (b"\r\n", b"\n", b"\r"):
                if data.endswith(tail, start, start + size):
                    size -= len(tail)
                    break
        value = Stream(value, data[start : start + size])
    return number, generation, None if isinstance(value, Keyword) else value


_INLINE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")


def operations(data: bytes):
    """(operator, operands) of a content stream; inline images are passed over."""
    stack, at = [], 0
    while True:
        x, at = read(data, at, refs=False)
        if x is END:
            return
        if not isinstance(x, Keyword):
            stack.append(x)
            continue
        if x == "ID":
            m = _INLINE_END.search(data, at)
            at, stack = (m.end() if m else len(data)), []
            continue
        if x not in ("BI", ">>", "]", "{", "}"):
            yield str(x), stack
        stack = []
