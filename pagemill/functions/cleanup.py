"""Text cleanup as Column expressions.

Every stage is a chain of built-in functions, so it stays in generated code; only Unicode normalisation, which Spark
lacks, is an Arrow function, and it is left out of the plan if its switch is off.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

# Ligatures and their letters, bullet glyphs, and the line starts that keep their line.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BULLETS = "●○■□◆◇▪▫►▻"
LIST_BULLETS = "•\\-■□▪▸►◆◇➤✓✗"
CJK = r"\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
SENTENCE_ENDS = "[.。!?！？]"


@dataclass(frozen=True)
class CleanupOptions:
    """Switches of the cleanup; remove_headers_footers and detect_mojibake are accepted and change nothing."""

    normalize_unicode: bool = True
    fix_ligatures: bool = True
    standardize_bullets: bool = True
    remove_pua: bool = False
    remove_replacement_char: bool = True
    remove_page_numbers: bool = True
    remove_headers_footers: bool = True
    remove_toc: bool = True
    fix_hyphenation: bool = True
    merge_list_markers: bool = True
    merge_cjk_lines: bool = True
    merge_single_newlines: bool = True
    drop_punctuation_only_lines: bool = True
    normalize_whitespace: bool = True
    max_consecutive_newlines: int = 2
    preserve_frontmatter: bool = True
    detect_mojibake: bool = False
    keep_table_rules: bool = False  # spares Markdown separator rows, which the punctuation stage blanks otherwise
    keep_inline_hyphens: bool = False  # joins hyphenated words over line breaks only

    @classmethod
    def preset(cls, name: str) -> CleanupOptions:
        off = dict.fromkeys((f for f, v in cls.__dataclass_fields__.items() if v.type == "bool"), False)
        if name == "minimal":
            return cls(**off | {"normalize_unicode": True, "normalize_whitespace": True, "preserve_frontmatter": True, "max_consecutive_newlines": 0})
        if name == "standard":
            return cls()
        if name == "aggressive":
            return replace(cls(), remove_pua=True, detect_mojibake=True)
        raise ValueError(f"no cleanup preset {name!r}: minimal, standard or aggressive")


def _normaliser(form: str):
    @F.arrow_udf("string")
    def run(column):
        import pyarrow as pa

        return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize(form, t) for t in column.to_pylist()], pa.string())

    return run


def nfc(text: Column) -> Column:
    return _normaliser("NFC")(text)


def nfkc(text: Column) -> Column:
    return _normaliser("NFKC")(text)


def ligatures(text: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return text


def bullets(text: Column) -> Column:
    return F.translate(text, BULLETS, "•" * len(BULLETS))


def private_use(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", "")


def replacement_chars(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(""))


def page_number_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?Umd)^[\s]*[-–—]?\s*\d+\s*[-–—]?\s*$", "")


def toc_leaders(text: Column) -> Column:
    """Dot leaders, line by line; an optional group that is empty leaves `(p.)`, which marks tell from real text."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")

    def one(line: Column) -> Column:
        for pattern, after, plain in ((r"(?U)\s+\.{8,}\s*(\d+)?\s+", " ", " "), (r"(?U)\s*\.{4,}\s*(\d+)?\s*\z", "", "")):
            line = F.regexp_replace(line, pattern, f"\x01 (p.$1){after}\x01")
            line = F.replace(F.replace(line, F.lit(f"\x01 (p.){after}\x01"), F.lit(plain)), F.lit("\x01"), F.lit(""))
        return line

    return F.array_join(F.transform(lines, one), "\n")


def dehyphenate(text: Column, line_breaks_only: bool = False) -> Column:
    gap = r"[ \t]*\n\s*" if line_breaks_only else r"\s*\n?\s*"
    return F.regexp_replace(text, rf"(?U)([a-zA-Z])-{gap}([a-z])", "$1$2")


def list_markers(text: Column) -> Column:
    text = F.regexp_replace(text, rf"(?U)([{LIST_BULLETS}])\s*\n\s*", "$1 ")
    for pattern in (r"(\d{1,3}[.)]\s*)", r"(\(\d{1,3}\)\s*)", r"([가-힣][.)]\s*)"):
        text = F.regexp_replace(text, rf"(?U){pattern}\n\s*", "$1")
    return F.regexp_replace(text, r"(?U)([❶-❿])\s*\n\s*", "$1 ")


def cjk_lines(text: Column) -> Column:
    text = F.regexp_replace(text, "\n{2,}", "\x02")
    text = F.regexp_replace(text, rf"([{CJK}])([^.。!?！？\n]?)\n([{CJK}])", "$1$2$3")
    return F.replace(text, F.lit("\x02"), F.lit("\n\n"))


def single_newlines(text: Column) -> Column:
    """Line breaks become spaces but for paragraphs, sentence ends, and lines that start as heading, list or table."""
    text = F.regexp_replace(text, r"(?Umd)^(#{1,6}\s|[-*]\s|[0-9]+\.\s|\|)", "\x03$1")
    text = F.regexp_replace(text, "\n{2,}", "\x04")
    text = F.regexp_replace(text, rf"(?U)({SENTENCE_ENDS})\s*\n", "$1\x05")
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.replace(F.translate(text, "\x05\x03", "\n\n"), F.lit("\x04"), F.lit("\n\n"))


def punctuation_lines(text: Column, keep_table_rules: bool = False) -> Column:
    def one(line: Column) -> Column:
        keep = line.rlike(r"[\p{IsAlphabetic}\p{N}]") | line.rlike(r"(?U)^\s*(!\[|#|\z)")
        if keep_table_rules:
            keep = keep | line.rlike(r"^\s*\|(\s*:?-{3,}:?\s*\|)+\s*$")
        return F.when(keep, line).otherwise("")

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {3,}", "  ")


def newline_cap(text: Column, most: int) -> Column:
    return F.regexp_replace(text, f"\n{{{most + 1},}}", "\n" * most) if most > 0 else text


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clean_body(text: Column, options: CleanupOptions) -> Column:
    stages = [
        (options.normalize_unicode, nfc),
        (options.fix_ligatures, ligatures),
        (options.standardize_bullets, bullets),
        (options.remove_pua, private_use),
        (options.remove_replacement_char, replacement_chars),
        (options.remove_page_numbers, page_number_lines),
        (options.remove_toc, toc_leaders),
        (options.fix_hyphenation, lambda t: dehyphenate(t, options.keep_inline_hyphens)),
        (options.merge_list_markers, list_markers),
        (options.merge_cjk_lines, cjk_lines),
        (options.merge_single_newlines, single_newlines),
        (options.drop_punctuation_only_lines, lambda t: punctuation_lines(t, options.keep_table_rules)),
        (options.normalize_whitespace, spaces),
        (options.max_consecutive_newlines > 0, lambda t: newline_cap(t, options.max_consecutive_newlines)),
    ]
    for on, stage in stages:
        text = stage(text) if on else text
    return trim(text)


FRONTMATTER = r"(?s)\A(---\n.*?\n---\n)(.*)\z"


def clean(text: Column, options: CleanupOptions | None = None) -> Column:
    """The whole cleanup; front matter is set aside and put back before the cleaned body."""
    options = options or CleanupOptions()
    if not options.preserve_frontmatter:
        return clean_body(text, options)
    head = F.regexp_extract(text, FRONTMATTER, 1)
    body = F.when(head == "", text).otherwise(F.regexp_extract(text, FRONTMATTER, 2))
    return F.when(text.isNull(), None).otherwise(F.concat(head, F.when(head == "", "").otherwise("\n"), clean_body(body, options)))
