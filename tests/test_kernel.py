"""Files of every structural variant, broken files, fonts, content operators and layout on known inputs."""

import re
import struct
import zlib

import pytest

from pagemill.kernel import content, filters, fonts, layout
from pagemill.kernel.crypt import Decryptor, aes_cbc, rc4
from pagemill.kernel.document import Document
from pagemill.kernel.extract import is_incoherent, parse
from pagemill.kernel.objects import Keyword, Name, PdfError, Ref, operations, read
from pagemill.options import PageSelection, ParseOptions
from pagemill.sources.pdf_writer import WriterOptions, write_pdf

TEXT = [[(72, 720, 12, "Helvetica", "Hello World (a) \\ é")]]


def page_of(data, **options):
    return [r for r in parse(data, ParseOptions(**options)) if r["kind"] == "page"]


def build(objects, root=1, extra=""):
    out, at = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, extra.encode(), start)


def stream(body, head=b""):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)


def one_page(body, resources=b"<< >>", more=()):
    return build([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources %s >>" % resources, stream(body), *more])


@pytest.mark.parametrize("options", [{}, {"compress": True}, {"compress": True, "predictor": True}, {"xref_stream": True}, {"encrypt": True}, {"compress": True, "xref_stream": True}])
def test_variants_give_the_same_spans(options):
    (page,) = page_of(write_pdf(TEXT, WriterOptions(**options)))
    assert [s["text"] for s in page["content"]["spans"]] == ["Hello World (a) \\ é"]
    assert (page["content"]["spans"][0]["x"], page["content"]["spans"][0]["font_size"], page["content"]["text_op_count"]) == (72.0, 12.0, 1)


@pytest.mark.parametrize("data,kind", [(b"", "NotPdf"), (b"%PDF-1.4 nothing", "BadXref"), (b"PK\x03\x04 zip file", "NotPdf"), (write_pdf(TEXT).replace(b"/Root 1 0 R", b"/Wrong 1 0 R"), "NoCatalog")])
def test_defects_become_rows(data, kind):
    (row,) = parse(data, ParseOptions())
    assert row["kind"] == "error" and row["error"]["class"] == kind


def test_cut_files_never_raise():
    data = write_pdf(TEXT * 3, WriterOptions(compress=True, xref_stream=True))
    for cut in range(0, len(data), 37):
        for row in parse(data[:cut] + data[cut + 5 :], ParseOptions()):
            assert row["kind"] in ("document", "page", "error")


def test_cycles_end():
    looped = build([b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>", b"<< /Type /Pages /Kids [2 0 R 2 0 R] /Parent 2 0 R >>", b"<< /First 4 0 R >>", b"<< /Title (a) /Next 4 0 R /First 4 0 R >>"])
    rows = parse(looped, ParseOptions())
    assert [r["kind"] for r in rows] == ["document"] and len(rows[0]["document"]["outline"]) == 1


def test_tokens():
    whole = b"<< /A#20B [1 -2.5 .5 true null (a\\(b\\)\\101\\\nc(d)) <4a4B4> 3 0 R] >> obj"
    value, at = read(whole, 0)
    assert value == {"A B": [1, -2.5, 0.5, True, None, b"a(b)Ac(d)", b"JK@", Ref(3, 0)]} and read(whole, at)[0] == Keyword("obj")
    assert list(operations(b"q 1 0 0 1 5 5 cm BI /W 1 ID \x00EI\xff EI /F1 12 Tf [(a) -250 (b)] TJ % c\nT* (x) ' Q")) == [
        ("q", []), ("cm", [1, 0, 0, 1, 5, 5]), ("Tf", [Name("F1"), 12]), ("TJ", [[b"a", -250, b"b"]]), ("T*", []), ("'", [b"x"]), ("Q", [])]


def test_filters():
    data = bytes(range(64)) * 3
    assert filters.inflate(zlib.compress(data)) == data and filters.inflate(zlib.compress(data)[2:-4]) == data
    assert data.startswith(filters.inflate(zlib.compress(data * 40)[:-30])[:50])
    assert filters.decode(b"61 62 6>", ["AHx"], None) == b"ab`"
    rows = [bytes([1, 2, 3, 4]), bytes([9, 9, 200, 3]), bytes([7, 0, 0, 255])]
    for kind, code in (("none", 0), ("sub", 1), ("up", 2), ("avg", 3), ("paeth", 4)):
        coded, above = b"", bytes(4)
        for row in rows:
            line = []
            for i, v in enumerate(row):
                a, b, c = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
                near = min(((abs(a + b - c - x), k, x) for k, x in enumerate((a, b, c))))[2]
                line.append((v - {"none": 0, "sub": a, "up": b, "avg": (a + b) // 2, "paeth": near}[kind]) & 255)
            coded, above = coded + bytes([code, *line]), row
        assert filters.predict(coded, {"Predictor": 15, "Columns": 4}) == b"".join(rows), kind
    with pytest.raises(PdfError):
        filters.decode(b"", "LZWDecode", None)


def test_ciphers():
    assert rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    key, block = bytes(range(16)), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
    assert aes_cbc(key, bytes(16) + block).hex() == "00112233445566778899aabbccddeeff"
    with pytest.raises(PdfError) as e:
        Decryptor({"Filter": "Standard", "R": 6, "V": 5}, b"", [b""])
    assert e.value.kind == "UnsupportedEncryption"


def test_fonts():
    assert [fonts.glyph(g) for g in ("eacute", "Zcaron", "uni00E9", "u1F600", "A", "germandbls", "nosuch", "a.alt")] == ["é", "Ž", "é", "😀", "A", "ß", None, "a"]
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <00480069> endbfchar 2 beginbfrange <0001> <0003> <0061> <0010> <0011> [<0078> <0079>] endbfrange"
    assert fonts.ToUnicode(cmap).decode(b"\x00\x41\x00\x01\x00\x03\x00\x11\x00\x99") == "Hiacy"
    segments = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 66, 0xFFFF) + b"\0\0" + struct.pack(">HHhhHH", 65, 0xFFFF, -60, 1, 0, 0)
    table = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + segments
    font = b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(table)) + table
    assert fonts.truetype_codes(font) == {5: "A", 6: "B"}
    resources = b"<< /Font << /F1 5 0 R /F2 6 0 R /F3 7 0 R >> >>"
    more = [b"<< /Type /Font /Encoding << /Differences [65 /eacute /uni4E2D] >> >>", b"<< /Type /Font /Subtype /Type0 /Encoding /KSC-EUC-H /DescendantFonts [8 0 R] >>", b"<< /Type /Font /Subtype /Type0 /Encoding /KSC-Johab-H /DescendantFonts [8 0 R] >>", b"<< /BaseFont /X >>"]
    (page,) = page_of(one_page(b"BT /F1 12 Tf 10 400 Td (ABC) Tj /F2 12 Tf 0 -40 Td <B0CBBEDFA4C3> Tj /F3 12 Tf <B0CB> Tj ET", resources, more))
    assert [s["text"] for s in page["content"]["spans"]] == ["é中C", b"\xb0\xcb\xbe\xdf\xa4\xc3".decode("euc_kr")]
    assert fonts.sanitize("a�bc﷐") == "abc" and fonts.is_likely_binary("\x01\x02ab") and not fonts.is_likely_binary("abc\n")


def test_operators_move_text():
    found = content.interpret(b"q 2 0 0 2 10 20 cm BT /F 10 Tf 1 0 0 1 5 5 Tm (a) Tj T* (b) Tj 3 Tr 0 -5 Td [(c) -300 (d) 100 (e)] TJ ET Q BT (z) ' ET /I Do (no) Tj", {}, (100, 100))
    assert [(s["text"], s["x"], s["y"], s["font_size"]) for s in found.spans] == [("a", 20.0, 30.0, 20.0), ("b", 20.0, 6.0, 20.0), ("c de", 20.0, -4.0, 20.0), ("z", 0.0, -12.0, 10.0)]
    assert (found.text_ops, found.image_ops, found.shown, found.unseen) == (5, 1, 6, 3)


def test_unreadable_scans_lose_their_text():
    noise = b"(" + b" ".join([b"~", b"%", b"$1", b"^", b"|"] * 12) + b") Tj "
    for mode, options, kept in ((b"3 Tr ", {}, 0), (b"0 Tr ", {}, 1), (b"3 Tr ", {"suppress_low_confidence_ocr": False}, 1)):
        (page,) = page_of(one_page(b"q 595 0 0 842 0 0 cm /Im Do Q BT " + mode + b"10 400 Td " + noise + b"ET"), **options)
        assert len(page["content"]["spans"]) == kept and page["content"]["ocr_text_suppressed"] == (not kept)
    assert not is_incoherent("short %") and not is_incoherent("Plain words of a sentence that anybody can read well.")


def spans(*rows):
    return [{"text": t, "x": float(x), "y": float(y), "width": float(w), "font_size": 12.0, "font_name": "Helvetica"} for t, x, y, w in rows]


def test_tables():
    grid = spans(*[(t, 100 * c + 50, 700 - 20 * r, 6 * len(t)) for r, row in enumerate([("Name", "Age"), ("Alice", "30"), ("Bob", "25")]) for c, t in enumerate(row)])
    (table,), rest = layout.detect_tables(grid)
    assert table["cells"] == [["Name", "Age"], ["Alice", "30"], ["Bob", "25"]] and not rest and table["confidence"] == 1.0
    for bad in (spans(*[("one line of text", 50, 700 - 20 * r, 90) for r in range(3)]), spans(*[(t, x, 700 - 20 * r, 10) for r in range(5) for t, x in ((f"{r + 1}.", 50), ("Item text", 80))]),
                spans(*[(t, x, 700 - 20 * r, 10) for r in range(3) for t, x in (("•", 50), ("Item", 80))]), spans(*[("x" * 40, x, 700 - 15 * r, 0) for r in range(20) for x in (50, 320)]),
                spans(*[("line", 50, 700 - 20 * r, 30) for r in range(10)], ("in", 150, 700, 30), ("in", 150, 680, 30))):
        found, rest = layout.detect_tables(bad)
        assert not found and len(rest) == len(bad)


def test_reading_order():
    two = [(50, 700 - 20 * k, 200, 12) for k in range(10)] + [(350, 700 - 20 * k, 200, 12) for k in range(10)]
    cut = lambda boxes, a=20, b=15: [len(g) for g in layout.regions(*zip(*boxes), a, b)]
    assert cut(two) == [10, 10] and cut(two[:10]) == [10] and cut(two[:1]) == [1]
    assert cut([(x, 700 - 15 * k, 150, 12) for x in (50, 250, 450) for k in range(5)]) == [5, 5, 5]
    assert len(cut([(50, 780, 500, 24), *((x, 700 - 15 * k, 200, 12) for x in (50, 350) for k in range(5))])) >= 2
    lines = layout.page_lines(spans(*[(c, 50 + 7.2 * i, 700, 0) for i, c in enumerate("Hello")], ("there", 100, 700, 0), ("below", 50, 680, 0)))
    assert [x["text"] for x in lines] == ["Hello there", "below"]
    assert layout.line_text(spans(("漢", 0, 0, 12), ("字", 30, 0, 12), ("a", 60, 0, 6), ("b", 66, 0, 6))) == "漢字 ab"
    assert layout.reorder("םולש") == "שלום" and layout.reorder("abc") == "abc"


def test_page_selection():
    assert PageSelection.parse("1-3").includes(3) and not PageSelection.parse("1-3").includes(4) and PageSelection.parse(" all ").includes(9)
    assert PageSelection.parse("1,3, 5-7").pages == (1, 3, 5, 6, 7)
    for bad in ("x", "1,,2", "1-x", "-"):
        with pytest.raises(ValueError):
            PageSelection.parse(bad)
    pages = page_of(write_pdf(TEXT * 4), pages=PageSelection.parse("2,4"))
    assert [p["page"] for p in pages] == [2, 4]
    assert re.match("1.5", Document(write_pdf(TEXT)).version)
