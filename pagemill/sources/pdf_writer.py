"""Writes PDF files from rows of text: the fixtures of tests and queries, in several structural variants."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame

from ..kernel.crypt import PAD, _aes_tables, _round_keys, rc4
from ..kernel.fonts import CODECS
from ..kernel.objects import Name, Ref, read
from ..session import importable


@dataclass
class WriterOptions:
    compress: bool = False
    predictor: bool = False
    xref_stream: bool = False  # objects then go to an object stream
    encrypt: bool = False
    revision: int = 3  # of the encryption: 2 and 3 are RC4, 4 is AES-128
    password: str = ""  # the user password
    wrong_lengths: bool = False  # of streams, as damaged files have them
    cut_streams: int = 0  # bytes missing at the end of compressed streams
    old_info: dict[str, str] = field(default_factory=dict)  # of a first version, which an update replaces by info
    encodings: dict[str, str] = field(default_factory=dict)  # font: WinAnsiEncoding if not named here; see encoded()
    raw: dict[int, bytes] = field(default_factory=dict)  # page: operators that follow the spans
    size: tuple[float, float] = (595.0, 842.0)
    info: dict[str, str] = field(default_factory=dict)
    outline: list[tuple[str, int]] = field(default_factory=list)
    fields: list[tuple[str, str, str]] = field(default_factory=list)  # name, type, value
    images: dict[int, list[tuple[str, bytes, str, int, int]]] = field(default_factory=dict)  # page: name, data, filter, width, height


def literal(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    for c in (b"\\", b"(", b")"):
        raw = raw.replace(c, b"\\" + c)
    return b"(" + raw.replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def encoded(kind: str, text: str, chars: list[str]) -> bytes:
    """A show operand for a font of that kind; chars are the font's characters, numbered from 1 (or 65) on."""
    if kind in ("WinAnsiEncoding", "MacRomanEncoding"):
        raw = text.encode("cp1252" if kind[0] == "W" else "mac_roman", "replace")
    elif kind == "Differences":
        raw = bytes(65 + chars.index(c) for c in text)
    elif kind == "ToUnicode":
        raw = b"".join((1 + chars.index(c)).to_bytes(2, "big") for c in text)
    else:
        raw = text.encode("utf-16-be" if "UCS2" in kind or "UTF16" in kind else CODECS[kind.rsplit("-", 1)[0]])
    return b"<" + raw.hex().encode() + b">"


def font_objects(name: str, kind: str, chars: list[str], new) -> dict[int, bytes]:
    """The objects of a font of that kind, the font itself last."""
    if kind in ("WinAnsiEncoding", "MacRomanEncoding"):
        return {new(): f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /{kind} >>".encode()}
    if kind == "Differences":
        glyphs = " ".join(f"/uni{ord(c):04X}" for c in chars)
        return {new(): f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding << /Differences [65 {glyphs}] >> >>".encode()}
    below, cmap, own = new(), new(), new()
    out = {below: f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{name} >>".encode()}
    if kind == "ToUnicode":
        lines = "".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>\n" for k, c in enumerate(chars, 1))
        body = f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(chars)} beginbfchar\n{lines}endbfchar".encode()
        out[cmap] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
    else:
        out[cmap] = b"null"
    more = f" /ToUnicode {cmap} 0 R" if kind == "ToUnicode" else ""
    out[own] = f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /{'Identity-H' if more else kind} /DescendantFonts [{below} 0 R]{more} >>".encode()
    return out


def write_pdf(pages: list[list[tuple[float, float, float, str, str]]], options: WriterOptions | None = None) -> bytes:
    """pages hold (x, y, size, font, text) spans; each becomes one show operator."""
    o = options or WriterOptions()
    objects: dict[int, bytes] = {}
    streams: dict[int, tuple[bytes, bytes]] = {}
    count = [2]

    def new() -> int:
        count[0] += 1
        return count[0]

    fonts: dict[str, int] = {}
    letters = {f: sorted({c for spans in pages for s in spans if s[3] == f for c in s[4]}) for f in o.encodings}
    kids = []
    for number, spans in enumerate(pages, 1):
        body, names = [], {}
        for name, data, kind, w, h in o.images.get(number, []):
            names[name] = new()
            streams[names[name]] = (f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /BitsPerComponent 8 /ColorSpace /DeviceGray".encode() + (f" /Filter /{kind}".encode() if kind else b""), data)
            body.append(f"q {w} 0 0 {h} 0 0 cm /{name} Do Q".encode())
        for x, y, size, font, text in spans:
            if font not in fonts:
                made = font_objects(font, o.encodings.get(font, "WinAnsiEncoding"), letters.get(font, []), new)
                objects.update(made)
                fonts[font] = max(made)
            shown = encoded(o.encodings[font], text, letters[font]) if font in o.encodings else literal(text)
            body.append(b"BT /F%d %g Tf %g %g Td %s Tj ET" % (fonts[font], size, x, y, shown))
        body.append(o.raw.get(number, b""))
        content, page = new(), new()
        streams[content] = (b"", b"\n".join(body))
        used = " ".join(f"/F{n} {n} 0 R" for n in fonts.values())
        held = " ".join(f"/{k} {n} 0 R" for k, n in names.items())
        objects[page] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {o.size[0]:g} {o.size[1]:g}] /Contents {content} 0 R /Resources << /Font << {used} >> /XObject << {held} >> >> >>".encode()
        kids.append(page)
    extra = b""
    if o.outline:
        top, items = new(), [new() for _ in o.outline]
        for i, (title, target) in enumerate(o.outline):
            after = f"/Next {items[i + 1]} 0 R" if i + 1 < len(items) else ""
            objects[items[i]] = b"<< /Title %s /Parent %d 0 R /Dest [%d 0 R /Fit] %s >>" % (literal(title), top, kids[target - 1], after.encode())
        objects[top] = f"<< /Type /Outlines /First {items[0]} 0 R /Last {items[-1]} 0 R /Count {len(items)} >>".encode()
        extra += b" /Outlines %d 0 R" % top
    if o.fields:
        own = []
        for name, kind, value in o.fields:
            own.append(new())
            shown = f"/{value}".encode() if kind == "Btn" else literal(value)
            objects[own[-1]] = b"<< /T %s /FT /%s %s >>" % (literal(name), kind.encode(), b"/V " + shown if value else b"")
        extra += b" /AcroForm << /Fields [%s] >>" % b" ".join(b"%d 0 R" % n for n in own)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R%s >>" % extra
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    trailer = b"/Root 1 0 R"
    if o.info:
        objects[new()] = b"<< " + b" ".join(b"/%s %s" % (k.encode(), literal(v)) for k, v in o.info.items()) + b" >>"
        trailer += b" /Info %d 0 R" % count[0]
    if not o.old_info:
        return _assemble(objects, streams, trailer, count[0], o)
    info = count[0]
    fresh, objects[info] = objects[info], b"<< " + b" ".join(b"/%s %s" % (k.encode(), literal(v)) for k, v in o.old_info.items()) + b" >>"
    return _updated(_assemble(objects, streams, trailer, count[0], o), {info: fresh}, trailer, count[0])


def _updated(data: bytes, objects: dict[int, bytes], trailer: bytes, last: int) -> bytes:
    """An incremental update: new objects and a table of their own behind the old file, which it names as /Prev."""
    before = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    out, table = bytearray(data), b""
    for number, body in sorted(objects.items()):
        table += b"%d 1\n%010d 00000 n \n" % (number, len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    return bytes(out + b"xref\n%strailer\n<< /Size %d %s /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (table, last + 1, trailer, before, at))


def _predicted(data: bytes, columns: int = 8) -> bytes:
    data += b"\0" * (-len(data) % columns)
    out, above = [], bytes(columns)
    for at in range(0, len(data), columns):
        row = data[at : at + columns]
        out.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)))
        above = row
    return b"".join(out)


def _serial(x, seal) -> bytes:
    """An object's syntax, its strings passed through `seal`."""
    if isinstance(x, dict):
        return b"<< " + b" ".join(b"/" + k.encode("latin-1") + b" " + _serial(v, seal) for k, v in x.items()) + b" >>"
    if isinstance(x, list):
        return b"[" + b" ".join(_serial(v, seal) for v in x) + b"]"
    if isinstance(x, bytes):
        return b"<" + seal(x).hex().encode() + b">"
    if isinstance(x, Name):
        return b"/" + x.encode("latin-1")
    if isinstance(x, Ref):
        return b"%d %d R" % (x.number, x.generation)
    return {True: b"true", False: b"false", None: b"null"}[x] if x is None or isinstance(x, bool) else b"%g" % x


def _assemble(objects, streams, trailer, last, o: WriterOptions) -> bytes:
    out, offsets, packed = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}, {}
    seal = None
    if o.encrypt:
        seal, entry, file_id = _encryption(o)
        last += 1
        secret = last
        objects[secret] = entry
        trailer += f" /Encrypt {secret} 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]".encode()
        if not o.xref_stream:  # an object stream is encrypted as a whole
            objects = {n: body if n == secret else _sealed(body, lambda raw, n=n: seal(n, raw)) for n, body in objects.items()}

    def put(number: int, body: bytes) -> None:
        offsets[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    for number, (head, data) in sorted(streams.items()):
        if o.compress and b"/Filter" not in head:
            if o.predictor and not head:
                head, data = head + b" /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 8 >>", zlib.compress(_predicted(data))
            else:
                head, data = head + b" /Filter /FlateDecode", zlib.compress(data)
            if o.cut_streams:
                data = data[: -o.cut_streams]
        if seal:
            data = seal(number, data)
        put(number, b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data) // 2 + 1 if o.wrong_lengths else len(data), data))
    if not o.xref_stream:
        for number, body in sorted(objects.items()):
            put(number, body)
        at = len(out)
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % (last + 1))
        out.extend(b"".join(b"%010d 00000 n \n" % offsets[n] for n in range(1, last + 1)))
        out.extend(b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (last + 1, trailer, at))
        return bytes(out)
    holder, table = last + 1, last + 2
    for number in [n for n, body in objects.items() if b"/Filter /Standard" in body or b"\nstream\n" in body]:  # these cannot be packed
        body = objects.pop(number)
        put(number, body if not seal or b"/Filter /Standard" in body else _sealed(body, lambda raw: seal(number, raw)))  # noqa: B023
    heads, bodies, at = [], [], 0
    for k, (number, body) in enumerate(sorted(objects.items())):
        packed[number] = k
        heads.append(b"%d %d" % (number, at))
        bodies.append(body + b" ")
        at += len(body) + 1
    head = b" ".join(heads) + b" "
    data = zlib.compress(head + b"".join(bodies))
    if seal:
        data = seal(holder, data)
    put(holder, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(heads), len(head), len(data), data))
    at = len(out)
    rows = [(0, 0, 0)] + [(2, holder, packed[n]) if n in packed else (1, offsets[n], 0) for n in range(1, table)] + [(1, at, 0)]
    wide = [max(1, (max(r[k] for r in rows).bit_length() + 7) // 8) for k in (1, 2)]
    body = zlib.compress(b"".join(bytes([kind]) + x.to_bytes(wide[0], "big") + y.to_bytes(wide[1], "big") for kind, x, y in rows))
    out.extend(b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 %d %d] /Filter /FlateDecode %s /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (table, table + 1, *wide, trailer, len(body), body, at))
    return bytes(out)


def _sealed(body: bytes, seal) -> bytes:
    """An object's syntax with its strings, and its stream if it has one, passed through `seal`."""
    value, at = read(body, 0)
    found = body.find(b"stream\n", at)
    if found < 0:
        return _serial(value, seal)
    data = seal(body[found + 7 : body.rindex(b"\nendstream")])
    return b"%s\nstream\n%s\nendstream" % (_serial(value | {"Length": len(data)}, seal), data)


def _aes(key: bytes, start: bytes, data: bytes) -> bytes:
    """CBC mode with padding; the initial vector goes first."""
    box, _, _ = _aes_tables()
    keys, out = _round_keys(key), start
    data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    order = [(i + 4 * (i % 4)) % 16 for i in range(16)]
    twice = lambda a: (a << 1) ^ (0x11B if a & 128 else 0)
    for at in range(0, len(data), 16):
        s = [a ^ b ^ k for a, b, k in zip(data[at : at + 16], out[-16:], keys[0])]
        for r in range(1, 11):
            s = [box[s[order[i]]] for i in range(16)]
            if r < 10:
                whole = [s[c] ^ s[c + 1] ^ s[c + 2] ^ s[c + 3] for c in range(0, 16, 4)]
                s = [s[i] ^ whole[i // 4] ^ twice(s[i] ^ s[i // 4 * 4 + (i + 1) % 4]) for i in range(16)]
            s = [a ^ k for a, k in zip(s, keys[r])]
        out += bytes(s)
    return out


def _encryption(o: WriterOptions):
    """(a function that encrypts an object's bytes, the encryption dictionary, the file's id)."""
    file_id, permissions, size = md5(b"pagemill").digest(), -4, 5 if o.revision == 2 else 16
    again, user = 0 if o.revision == 2 else 50, (o.password.encode("latin-1") + PAD)[:32]

    def digest(seed: bytes) -> bytes:
        out = md5(seed).digest()[:size]
        for _ in range(again):
            out = md5(out).digest()[:size]
        return out

    def chain(key: bytes, text: bytes) -> bytes:
        for i in range(20 if again else 1):
            text = rc4(bytes(b ^ i for b in key), text)
        return text

    owner = chain(digest(PAD), user)
    key = digest(user + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
    known = chain(key, md5(PAD + file_id).digest()) + bytes(16) if again else chain(key, PAD)
    how = {2: "/V 1 /R 2", 3: "/V 2 /R 3 /Length 128", 4: "/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF"}[o.revision]

    def seal(number: int, data: bytes) -> bytes:
        seed = key + number.to_bytes(4, "little")[:3] + b"\0\0"
        if o.revision == 4:
            return _aes(md5(seed + b"sAlT").digest(), md5(b"%d" % number).digest(), data)
        return rc4(md5(seed).digest()[: min(16, size + 5)], data)

    return seal, f"<< /Filter /Standard {how} /P {permissions} /O <{owner.hex()}> /U <{known.hex()}> >>".encode(), file_id


def pdf_of_lines(rows: DataFrame, options: WriterOptions | None = None, lines_a_page: int = 40, size: float = 12.0, leading: float = 18.0) -> DataFrame:
    """(doc_id, content) for rows of (doc_id, lines array<string>): a span a line, top to bottom."""

    def run(batches):
        for batch in batches:
            made = []
            for lines in batch.column("lines").to_pylist():
                lines = lines or []
                cut = [lines[i : i + lines_a_page] for i in range(0, max(1, len(lines)), lines_a_page)]
                made.append(write_pdf([[(72.0, 770.0 - leading * k, size, "Helvetica", t) for k, t in enumerate(page)] for page in cut], options))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array(made, pa.binary())], ["doc_id", "content"])

    importable(rows.sparkSession)
    return rows.selectExpr("cast(doc_id as string) doc_id", "lines").mapInArrow(run, "doc_id string, content binary")


def pdf_of_spans(rows: DataFrame, options: WriterOptions | None = None) -> DataFrame:
    """(doc_id, content) for rows of (doc_id, pages array<array<struct<x, y, size, font, text>>>)."""

    def run(batches):
        for batch in batches:
            made = [write_pdf([[(s["x"], s["y"], s["size"], s["font"], s["text"]) for s in page] for page in pages], options) for pages in batch.column("pages").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array(made, pa.binary())], ["doc_id", "content"])

    importable(rows.sparkSession)
    return rows.selectExpr("cast(doc_id as string) doc_id", "pages").mapInArrow(run, "doc_id string, content binary")
