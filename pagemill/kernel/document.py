"""A PDF file's structure: cross-references, objects, pages and the document-level tables."""

from __future__ import annotations

import re

from .crypt import Decryptor
from .filters import decode
from .objects import Keyword, Name, PdfError, Ref, Stream, read, read_indirect, skip

HOPS, OUTLINE_DEPTH, TAIL = 10, 64, 1024
INHERITED = 64
PAGE = (612.0, 792.0)


class Document:
    """Objects are read when asked for; every walk keeps a set of visited objects, so loops end."""

    def __init__(self, data: bytes, password: str = ""):
        if not re.match(rb"%PDF-\d\.\d", data[:8]):
            raise PdfError("NotPdf", "no %PDF header")
        self.data, self.cache, self.busy = data, {}, set()
        self.opened: dict[int, tuple[bytes, dict[int, int]]] = {}
        self.version = re.match(rb"%PDF-(\S*)", data)[1].decode("latin-1")
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self._chain(self._start())
        self.crypt = None
        self.encrypted = "Encrypt" in self.trailer
        if self.encrypted:
            ids = self.resolve(self.trailer.get("ID")) or [b""]
            info = {k: self.resolve(v) for k, v in (self.resolve(self.trailer["Encrypt"]) or {}).items()}
            self.cache.clear()
            self.opened.clear()
            secret = self.trailer["Encrypt"].number if isinstance(self.trailer["Encrypt"], Ref) else None
            self.crypt, self.plain = Decryptor(info, ids[0] if isinstance(ids[0], bytes) else b"", [b"", password.encode("latin-1", "replace")]), secret

    def _start(self) -> int:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - TAIL))
        found, _ = read(self.data, at + 9, refs=False) if at >= 0 else (None, 0)
        if not isinstance(found, int):
            raise PdfError("BadXref", "no startxref")
        return found

    def _chain(self, at: int) -> None:
        seen, todo = set(), [at]
        while todo:
            at = todo.pop()
            if at in seen or not 0 <= at < len(self.data):
                if not seen:
                    raise PdfError("BadXref", "startxref points outside the file")
                continue
            seen.add(at)
            trailer = self._table(at) if self.data.startswith(b"xref", skip(self.data, at)) else self._stream(at)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            for key in ("Prev", "XRefStm"):  # XRefStm is older than its own table, newer than Prev
                if isinstance(trailer.get(key), int):
                    todo.append(trailer[key])

    def _table(self, at: int) -> dict:
        at = skip(self.data, at) + 4
        while True:
            first, after = read(self.data, at, refs=False)
            if not isinstance(first, int):
                break
            count, at = read(self.data, after, refs=False)
            for number in range(first, first + (count if isinstance(count, int) else 0)):
                offset, at = read(self.data, at, refs=False)
                _, at = read(self.data, at, refs=False)
                kind, at = read(self.data, at, refs=False)
                if kind == "n" and isinstance(offset, int):
                    self.entries.setdefault(number, (offset,))
                elif kind == "f":
                    self.entries.setdefault(number, ())
        if first != "trailer":
            raise PdfError("BadXref", "no trailer")
        trailer, _ = read(self.data, after)
        return trailer if isinstance(trailer, dict) else {}

    def _stream(self, at: int) -> dict:
        _, _, found = read_indirect(self.data, at)
        if not isinstance(found, Stream):
            raise PdfError("BadXref", "no cross-reference stream")
        info, body = found.info, decode(found.raw, found.info.get("Filter"), found.info.get("DecodeParms"))
        a, b, c = info["W"]
        index = info.get("Index") or [0, info.get("Size", 0)]
        at = 0
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                row = body[at : at + a + b + c]
                if len(row) < a + b + c:
                    return info
                at += a + b + c
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a : a + b], "big"), int.from_bytes(row[a + b :], "big")
                self.entries.setdefault(number, (x,) if kind == 1 else (x, y) if kind == 2 else ())
        return info

    def load(self, number: int):
        if number in self.cache:
            return self.cache[number]
        entry = self.entries.get(number, ())
        if not entry or number in self.busy:
            return None
        self.busy.add(number)
        value = None
        try:
            if len(entry) == 1:
                own, generation, value = read_indirect(self.data, entry[0], self.resolve)
                if own != number:
                    value = None
                elif self.encrypted and self.__dict__.get("crypt") and number != self.plain:
                    value = self._open(value, own, generation)
            else:
                body, places = self._unpack(entry[0])
                if number in places:
                    value, _ = read(body, places[number])
                    value = None if isinstance(value, Keyword) else value
        except (PdfError, IndexError, ValueError, TypeError, KeyError, RecursionError):
            value = None
        self.busy.discard(number)
        self.cache[number] = value
        return value

    def _unpack(self, number: int) -> tuple[bytes, dict[int, int]]:
        """An object stream's decoded body and where its objects begin; read once, however many objects it holds."""
        if number not in self.opened:
            self.opened[number] = b"", {}
            holder = self.load(number)
            if isinstance(holder, Stream):
                body, at, places = self.body(holder), 0, {}
                for _ in range(self.resolve(holder.info.get("N", 0))):
                    own, at = read(body, at, refs=False)
                    offset, at = read(body, at, refs=False)
                    if isinstance(own, int) and isinstance(offset, int):
                        places[own] = holder.info.get("First", 0) + offset
                self.opened[number] = body, places
        return self.opened[number]

    def _open(self, value, number, generation):
        if isinstance(value, bytes):
            return self.crypt.decrypt(value, number, generation)
        if isinstance(value, list):
            return [self._open(v, number, generation) for v in value]
        if isinstance(value, dict):
            return {k: self._open(v, number, generation) for k, v in value.items()}
        if isinstance(value, Stream):
            raw = value.raw if value.info.get("Type") in ("XRef",) else self.crypt.decrypt(value.raw, number, generation)
            return Stream(self._open(value.info, number, generation), raw)
        return value

    def resolve(self, value):
        for _ in range(HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.load(value.number)
        return None

    def get(self, info, key, kind=object):
        value = self.resolve(info.get(key)) if isinstance(info, dict) else None
        return value if isinstance(value, kind) else None

    def body(self, stream: Stream) -> bytes:
        filters, parms = self.resolve(stream.info.get("Filter")), self.resolve(stream.info.get("DecodeParms"))
        parms = [self.resolve(p) for p in parms] if isinstance(parms, list) else parms
        return decode(stream.raw, [self.resolve(f) for f in filters] if isinstance(filters, list) else filters, parms)

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise PdfError("NoCatalog", "no document catalog")
        return root

    def pages(self) -> list[tuple[Ref | None, dict]]:
        out, seen, todo = [], set(), [self.catalog.get("Pages")]
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            if node.get("Type") == "Page":
                out.append((ref if isinstance(ref, Ref) else None, node))
            elif node.get("Type") in ("Pages", None):
                kids = self.get(node, "Kids", list) or []
                todo.extend(reversed(kids))
        return out

    def inherited(self, node: dict, key: str):
        for _ in range(INHERITED):
            found = self.resolve(node.get(key))
            if found is not None:
                return found
            node = self.resolve(node.get("Parent"))
            if not isinstance(node, dict):
                return None
        return None

    def page_size(self, page: dict) -> tuple[float, float]:
        box = self.inherited(page, "MediaBox")
        box = [self.resolve(x) for x in box] if isinstance(box, list) else []
        ok = len(box) >= 4 and all(isinstance(x, (int, float)) for x in box[2:4])
        return (float(box[2]), float(box[3])) if ok else PAGE

    def content(self, page: dict) -> bytes:
        found = self.resolve(page.get("Contents"))
        parts = []
        for part in found if isinstance(found, list) else [found]:
            part = self.resolve(part)
            if isinstance(part, Stream):
                try:
                    parts.append(self.body(part))
                except PdfError:
                    if not isinstance(found, list):
                        raise
        return b" ".join(parts)

    def metadata(self) -> dict:
        info = self.resolve(self.trailer.get("Info"))
        names = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
        return {n: text(v) if isinstance(v := self.get(info, n), bytes) else None for n in names}

    def images(self, page: dict):
        """(name, info, data, mime) of the page's own image XObjects, by name."""
        found = self.get(self.get(page, "Resources", dict), "XObject", dict) or {}
        for name in sorted(found):
            x = self.resolve(found[name])
            if not isinstance(x, Stream) or self.resolve(x.info.get("Subtype")) != "Image":
                continue
            filters = self.resolve(x.info.get("Filter"))
            last = filters[-1] if isinstance(filters, list) and filters else filters
            mime = {"DCTDecode": "image/jpeg", "JPXDecode": "image/jp2"}.get(last)
            try:
                if mime and isinstance(filters, list) and len(filters) > 1:
                    data = decode(x.raw, filters[:-1], self.resolve(x.info.get("DecodeParms")))
                else:
                    data = x.raw if mime else self.body(x)
            except PdfError:
                data = x.raw
            yield name, x.info, data, mime or "application/octet-stream"

    def outline(self, numbers: dict[int, int]):
        """(item, parent, order, level, title, page) rows, depth first."""
        top = self.get(self.catalog, "Outlines", dict)
        out, seen = [], set()

        def walk(ref, parent, level):
            order = 0
            while isinstance(ref, Ref) and ref.number not in seen and level < OUTLINE_DEPTH:
                seen.add(ref.number)
                item = self.resolve(ref)
                if not isinstance(item, dict):
                    return
                title, own = self.get(item, "Title", bytes), len(out)
                out.append((own, parent, order, level, text(title) if title is not None else "", self._target(item, numbers)))
                walk(item.get("First"), own, level + 1)
                order, ref = order + 1, item.get("Next")

        if top:
            walk(top.get("First"), None, 0)
        return out

    def _target(self, item: dict, numbers: dict[int, int]):
        dest = self.resolve(item.get("Dest"))
        if dest is None:
            dest = self.resolve((self.get(item, "A", dict) or {}).get("D"))
        return numbers.get(dest[0].number) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None

    def fields(self):
        """(name, type, value, default) of the form's terminal fields."""
        form = self.get(self.catalog, "AcroForm", dict)
        seen = set()

        def walk(ref, prefix, above):
            if isinstance(ref, Ref):
                if ref.number in seen:
                    return
                seen.add(ref.number)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                return
            own = {k: self.resolve(node[k]) if k in node else above.get(k) for k in ("FT", "Ff", "V", "DV")}
            part = self.get(node, "T", bytes)
            name = prefix if part is None else f"{prefix}.{text(part)}" if prefix else text(part)
            kids = self.get(node, "Kids", list) or []
            named = [k for k in kids if isinstance(x := self.resolve(k), dict) and "T" in x]
            if named:
                for kid in named:
                    yield from walk(kid, name, own)
            elif own["FT"] and name:
                yield name, field_type(own["FT"], own["Ff"] or 0), self._value(own["FT"], own["V"]), self._value(own["FT"], own["DV"])

        for ref in (self.get(form, "Fields", list) or []) if form else []:
            yield from walk(ref, "", {})

    def _value(self, kind, value):
        """(kind, text, boolean, choices) or None."""
        if isinstance(value, Name) and kind == "Btn":
            return ("boolean", None, value != "Off", None)
        if isinstance(value, list):
            return ("choices", None, None, [text(v) for v in map(self.resolve, value) if isinstance(v, bytes)])
        if isinstance(value, Stream):
            value = self.body(value)
        if isinstance(value, (bytes, Name)):
            shown = text(value) if isinstance(value, bytes) else str(value)
            return ("choice" if kind == "Ch" else "text", shown, None, None)
        return None


def field_type(kind: str, flags: int) -> str:
    if kind == "Btn":
        return "push_button" if flags >> 16 & 1 else "radio_button" if flags >> 15 & 1 else "checkbox"
    if kind == "Ch":
        return "dropdown" if flags >> 17 & 1 else "list_box"
    return {"Tx": "text", "Sig": "signature"}.get(str(kind), "text")


def text(raw: bytes) -> str:
    """UTF-16 with its mark, else UTF-8, else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")
