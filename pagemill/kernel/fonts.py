"""Bytes of shown text to Unicode, by the font's tables."""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import cache

from .document import Document
from .filters import PdfError
from .objects import END, Keyword, Name, Stream, read

# Adobe StandardEncoding where it differs from ASCII, by code.
STANDARD = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ",
    0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜",
    0xC5: "¯", 0xC6: "˘", 0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ",
    0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}
# Glyph names that no rule gives; accented letters come from their base letter and accent.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(",
    "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}",
    "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª",
    "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶",
    "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "AE": "Æ",
    "Eth": "Ð", "multiply": "×", "Oslash": "Ø", "Thorn": "Þ", "germandbls": "ß", "ae": "æ", "eth": "ð", "divide": "÷", "oslash": "ø", "thorn": "þ", "OE": "Œ", "oe": "œ", "Lslash": "Ł", "lslash": "ł",
    "dotlessi": "ı", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—",
    "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "nbspace": "\xa0", "sfthyphen": "\xad",
}
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
# Predefined CMaps by the codec of their encoding.
CODECS = {"KSC-EUC": "euc_kr", "KSCms-UHC": "cp949", "90ms-RKSJ": "cp932", "GBK-EUC": "gbk", "ETen-B5": "big5"}
WIDE = re.compile(r"^Uni\w+-(UCS2|UTF16)$")
DROP = re.compile("[�﷐-﷯-\U000f0000-\U0010ffff]|[" + "".join(chr(p * 0x10000 + e) for p in range(15) for e in (0xFFFE, 0xFFFF)) + "]")
ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f-]")


def sanitize(text: str) -> str:
    """Without U+FFFD, noncharacters and private-use characters."""
    return DROP.sub("", text)


def is_likely_binary(text: str) -> bool:
    return bool(text) and len(ODD.findall(text)) / len(text) > 0.3


def glyph(name: str) -> str | None:
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1 and name.isascii():
        return name
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    for accent, mark in ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            whole = unicodedata.normalize("NFC", name[0] + mark)
            return whole if len(whole) == 1 else None
    if "." in name[1:]:
        return glyph(name[: name.index(".", 1)])
    return None


@cache
def _base(name) -> tuple[str, ...]:
    if name == "WinAnsiEncoding":
        return tuple(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(256))
    if name == "MacRomanEncoding":
        return tuple(bytes([c]).decode("mac_roman") for c in range(256))
    return tuple(STANDARD.get(c, chr(c) if c < 0x80 else "") for c in range(256))


def base_encoding(name) -> list[str]:
    return list(_base(str(name) if name else None))


class ToUnicode:
    """bfchar and bfrange entries of a CMap, and the width of its codes."""

    def __init__(self, data: bytes):
        self.map: dict[int, str] = {}
        self.width = 0
        at, stack = 0, []
        while True:
            x, at = read(data, at, refs=False)
            if x is END:
                break
            if not isinstance(x, Keyword):
                stack.append(x)
                continue
            strings = [s for s in stack if isinstance(s, (bytes, list))]
            if x == "endcodespacerange":
                self.width = max([self.width, *(len(s) for s in strings if isinstance(s, bytes))])
            elif x == "endbfchar":
                for code, to in zip(strings[::2], strings[1::2]):
                    self.map[int.from_bytes(code, "big")] = self._text(to)
            elif x == "endbfrange":
                for low, high, to in zip(strings[::3], strings[1::3], strings[2::3]):
                    first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for k in range(min(last - first, 0xFFFF) + 1):
                        if isinstance(to, list):
                            if k < len(to):
                                self.map[first + k] = self._text(to[k])
                        elif to:
                            self.map[first + k] = self._text(to[:-1] + bytes([(to[-1] + k) & 255])) if to[-1] + k < 256 else self._text((int.from_bytes(to, "big") + k).to_bytes(len(to), "big"))
            stack = []
        self.width = self.width or 2
        if self.map and max(self.map) <= 0xFF and self.width > 1:
            self.width = 1

    @staticmethod
    def _text(raw) -> str:
        if not isinstance(raw, bytes):
            return ""
        return raw.decode("utf-16-be", "ignore") if len(raw) > 1 else raw.decode("latin-1")

    def decode(self, raw: bytes) -> str:
        return "".join(self.map.get(int.from_bytes(raw[i : i + self.width], "big"), "") for i in range(0, len(raw), self.width))


def truetype_codes(data: bytes) -> dict[int, str]:
    """Glyph number to the lowest code point that the font's Unicode cmap gives it."""
    tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", data[20 + 16 * i : 28 + 16 * i]) for i in range(struct.unpack(">H", data[4:6])[0])}
    start = tables[b"cmap"][0]
    records = [struct.unpack(">HHI", data[start + 4 + 8 * i : start + 12 + 8 * i]) for i in range(struct.unpack(">H", data[start + 2 : start + 4])[0])]
    ranked = sorted((r for r in records if r[:2] == (3, 1) or r[0] == 0 or r[:2] == (3, 10)), key=lambda r: (r[:2] != (3, 1), r[:2] != (0, 3)))
    out: dict[int, str] = {}
    for _, _, offset in ranked:
        at = start + offset
        kind = struct.unpack(">H", data[at : at + 2])[0]
        if kind == 4:
            n = struct.unpack(">H", data[at + 6 : at + 8])[0] // 2
            part = lambda skip: struct.unpack(f">{n}H", data[at + skip : at + skip + 2 * n])  # noqa: E731,B023
            ends, starts, deltas, offsets = part(14), part(16 + 2 * n), part(16 + 4 * n), part(16 + 6 * n)
            for i in range(n):
                for code in range(starts[i], ends[i] + 1):
                    if offsets[i]:
                        spot = at + 16 + 6 * n + 2 * i + offsets[i] + 2 * (code - starts[i])
                        number = struct.unpack(">H", data[spot : spot + 2])[0] if spot + 2 <= len(data) else 0
                        number = (number + deltas[i]) & 0xFFFF if number else 0
                    else:
                        number = (code + deltas[i]) & 0xFFFF
                    if number and code != 0xFFFF:
                        out.setdefault(number, chr(code))
        elif kind == 12:
            for i in range(struct.unpack(">I", data[at + 12 : at + 16])[0]):
                low, high, number = struct.unpack(">III", data[at + 16 + 12 * i : at + 28 + 12 * i])
                for k in range(min(high - low, 0x10FFFF) + 1):
                    out.setdefault(number + k, chr(low + k))
        if out:
            return out
    return out


class Font:
    """A font's decoders, tried in turn until one gives text."""

    def __init__(self, doc: Document, info: dict | None, resource: str):
        self.base = str(doc.get(info, "BaseFont", str) or resource) if info else resource
        self.steps = []
        self.composite = False
        if not info:
            return
        cmap = doc.get(info, "ToUnicode", Stream)
        if cmap:
            try:
                self.steps.append(ToUnicode(doc.body(cmap)).decode)
            except PdfError:
                pass
        encoding = doc.get(info, "Encoding")
        below = doc.get(info, "DescendantFonts", list)
        below = doc.resolve(below[0]) if below else None
        self.composite = isinstance(below, dict)
        if self.composite:
            self._composite(doc, below, encoding)
        elif isinstance(encoding, (Name, dict)):
            self._simple(doc, encoding)

    def _composite(self, doc, below, encoding):
        program = doc.get(doc.get(below, "FontDescriptor", dict), "FontFile2", Stream)
        wide = not isinstance(encoding, Name) or encoding.startswith("Identity")
        if program and wide:
            try:
                codes = truetype_codes(doc.body(program))
                self.steps.append(lambda raw: "".join(codes.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2)))
            except (PdfError, struct.error, KeyError, IndexError):
                pass
        if isinstance(encoding, Name) and not wide:
            name = encoding.rsplit("-", 1)[0]
            codec = "utf-16-be" if WIDE.match(name) else CODECS.get(name)
            if codec:
                self.steps.append(lambda raw: raw.decode(codec, "ignore"))

    def _simple(self, doc, encoding):
        if isinstance(encoding, Name):
            table = base_encoding(encoding)
        else:
            table = base_encoding(doc.get(encoding, "BaseEncoding"))
            code = 0
            for x in doc.get(encoding, "Differences", list) or []:
                x = doc.resolve(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    found = glyph(x)
                    if found is not None and 0 <= code < 256:
                        table[code] = found
                    code += 1
        self.steps.append(lambda raw: "".join([table[b] for b in raw]))

    def decode(self, raw: bytes) -> str:
        for step in self.steps:
            text = sanitize(step(raw))
            if text:
                return text
        if self.composite:
            return ""
        if raw[:2] == b"\xfe\xff":
            text = raw[2:].decode("utf-16-be", "replace")
        else:
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
        return "" if is_likely_binary(text) else text


def page_fonts(doc: Document, page: dict, memory: dict) -> dict[str, Font]:
    """The page's fonts by resource name; the page's own come before its ancestors'."""
    out, node, seen = {}, page, 0
    while isinstance(node, dict) and seen < 64:
        found = doc.get(doc.get(node, "Resources", dict), "Font", dict) or {}
        for name, ref in found.items():
            if name not in out:
                key = getattr(ref, "number", None)
                if key is None or key not in memory:
                    info = doc.resolve(ref)
                    font = Font(doc, info if isinstance(info, dict) else None, name)
                    memory[key if key is not None else (id(node), name)] = font
                    out[name] = font
                else:
                    out[name] = memory[key]
        node, seen = doc.resolve(node.get("Parent")), seen + 1
    return out
