"""Scalar text functions: quality figures, escapes, markers, dates, signatures. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bullet markers of list rows, bullets that never start a heading, Roman numerals, right-to-left ranges.
BULLET_MARKERS = ["-", "–", "—", "•", "·", "*", "○", "▪", "◦", "▸", "▹", "►", "■", "●", "※", "□", "◆", "◇", "▶", "▷", "☞", "➤", "➜"]
NO_HEADING_BULLETS = "-*·•◦▶▷◎☞※"
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
RTL = r"[\x{0590}-\x{07FF}\x{0800}-\x{083F}\x{0840}-\x{085F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
NOT_COHERENT = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{FFA0}-\x{FFDC}\x{2E80}-\x{2EFF}\x{2F00}-\x{2FDF}"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}]"
SPACELESS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{3040}-\x{30FF}\x{3000}-\x{303F}]"
LOW_QUALITY = 0.3
MIME_EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/tiff": "tiff", "image/bmp": "bmp", "image/webp": "webp", "image/jp2": "jp2", "image/jpeg2000": "jp2",
    "application/pdf": "pdf", "font/ttf": "ttf", "font/truetype": "ttf", "font/otf": "otf", "font/opentype": "otf", "font/woff": "woff", "font/woff2": "woff2",
}
SIGNATURES = [("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp")]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.greatest(whole, F.lit(1)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def replacement_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))


def is_good(chars: Column, replaced: Column) -> Column:
    return (chars > 0) & (_share(replaced, chars) < LOW_QUALITY)


def replacement_ratio(chars: Column, replaced: Column) -> Column:
    return _share(replaced, chars)


def warning(encrypted: Column, chars: Column, scan: Column, suppressed: Column, replaced: Column) -> Column:
    return (
        F.when(encrypted, "encrypted file: its text may be missing in part or in whole")
        .when((chars == 0) & scan, "scanned pages without a text layer: recognise the text first")
        .when(chars == 0, "no text found: pages of images, encryption, or fonts without a usable encoding")
        .when(suppressed > 0, F.format_string("unreadable recognised text left out on %d page(s); OCR suppression can be switched off", suppressed))
        .when(_share(replaced, chars) >= LOW_QUALITY, F.format_string("%d of %d characters could not be decoded", replaced, chars))
    )


def coherence(text: Column) -> Column:
    """struct(chars, word_like, coherent): null shares if there is too little to judge."""
    meaningful = rf"[[\p{{IsAlphabetic}}\p{{N}}]&&[^{NOT_COHERENT}]]"
    chars = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    coherent = F.length(text) - F.length(F.regexp_replace(text, meaningful, ""))
    tokens = words(text)
    like = F.size(F.filter(tokens, lambda w: (F.length(w) >= 2) & w.rlike(meaningful)))
    enough = (chars >= 40) & (F.size(tokens) > 0)
    return F.struct(chars.alias("chars"), F.when(enough, _share(like, F.size(tokens))).alias("word_like"), F.when(enough, _share(coherent, chars)).alias("coherent"))


def is_incoherent(text: Column) -> Column:
    m = coherence(text)
    return F.coalesce((m["word_like"].cast("float") < F.lit(0.40).cast("float")) & (m["coherent"].cast("float") < F.lit(0.55).cast("float")), F.lit(False))


def is_likely_binary(text: Column) -> Column:
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{9F}\x{E000}-\x{F8FF}]", ""))
    return (F.length(text) > 0) & (_share(odd, F.length(text)).cast("float") > F.lit(0.3).cast("float"))


def contains_rtl(text: Column) -> Column:
    return text.rlike(RTL)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]|])", r"\\$1")


def escape_yaml(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def frontmatter(title: Column, author: Column, keywords: Column, pages: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'{name}: "'), escape_yaml(value), F.lit('"'))

    some = F.when(F.regexp_replace(keywords, r"(?U)\s", "") != "", line("keywords", keywords))
    return F.concat_ws("\n", F.lit("---"), line("title", title), line("author", author), some, F.concat(F.lit("pages: "), pages.cast("string")), F.lit("---"), F.lit(""))


def roman(number: Column) -> Column:
    """Roman numeral of a positive whole number."""
    out, rest = F.lit(""), number.cast("long")
    for value, symbol in ROMAN:
        out = F.concat(out, F.repeat(F.lit(symbol), (rest / value).cast("int")))
        rest = rest % value
    return out


def list_number(number: Column, style: Column) -> Column:
    """Marker of an ordered list item: decimal, lower_alpha, upper_alpha, lower_roman or upper_roman."""
    text = (
        F.when(style == "lower_alpha", F.char((F.lit(96) + number).cast("long")))
        .when(style == "upper_alpha", F.char((F.lit(64) + number).cast("long")))
        .when(style == "lower_roman", F.lower(roman(number)))
        .when(style == "upper_roman", roman(number))
        .otherwise(number.cast("string"))
    )
    return F.concat(text, F.lit("."))


def pdf_date(text: Column) -> Column:
    """Timestamp of D:YYYY[MM[DD[HH[mm[SS]]]]]; the zone is ignored, what is no date is null."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{4,14})", 1)

    def part(start: int, size: int, default: int) -> Column:
        return F.when(F.length(digits) >= start + size - 1, F.substring(digits, start, size).try_cast("int")).otherwise(default)

    return F.when(digits != "", F.try_make_timestamp(part(1, 4, 0), part(5, 2, 1), part(7, 2, 1), part(9, 2, 0), part(11, 2, 0), part(13, 2, 0).cast("decimal(8,6)")))


def is_bullet_marker(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "").isin(BULLET_MARKERS)


def is_number_marker(text: Column) -> Column:
    packed = F.regexp_replace(text, r"(?U)\s", "")
    return packed.rlike(r"^[0-9]+[.)]\z") | F.coalesce(packed.rlike(r"^\+?[0-9]+\z") & (packed.try_cast("bigint") <= 4294967295), F.lit(False)) | packed.rlike(r"^\p{IsAlphabetic}[.)]\z")


def is_page_number(text: Column) -> Column:
    """Digits only, `- N -`, `Page N`, `N / M` or `N of M`."""
    inner = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    dashed = F.lit(False)
    for dash in "-–—":
        dashed = dashed | inner.rlike(rf"(?U)^{dash}\s*[0-9]*\s*{dash}\z")
    return inner.rlike(r"^[0-9]*\z") | dashed | inner.rlike(r"(?U)^[Pp]age \s*[0-9]*\s*\z") | inner.rlike(r"^[/\s]*[0-9]+[/\s]+of[/\s]+[0-9]+[/\s]*\z") | (inner.rlike(r"^[/\s]*[0-9]+[/\s]+[0-9]+[/\s]*\z") & F.contains(inner, F.lit("/")))


def is_pdf(content: Column) -> Column:
    return pdf_version(content).isNotNull()


def pdf_version(content: Column) -> Column:
    """`d.d` after %PDF-, or null; files under eight bytes are none."""
    version = F.decode(F.substring(content, 6, 3), "ISO-8859-1")
    return F.when((F.hex(F.substring(content, 1, 5)) == "255044462D") & version.rlike(r"^[0-9]\.[0-9]\z"), version)


def sniff_mime(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    out = F.when(F.octet_length(data) < 8, None)
    for signature, kind in SIGNATURES:
        out = out.when(head.startswith(signature), kind)
    return out.when(head.rlike("^52494646.{8}57454250"), "image/webp").when(head.startswith("0000000C6A502020"), "image/jp2")


def extension_of(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mime), F.when(mime.startswith("image/"), "raw").otherwise("bin"))
