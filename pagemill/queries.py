"""The registered queries of the engine, each with the SQL that must give the same rows.

The text tables hold none of the artefacts that cleanup removes, so queries put some in, by the same literal
replacements on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import cleanup as cl, text as tf
from .functions.cleanup import CleanupOptions
from .operators import layout, quality
from .options import PageSelection, ParseOptions, RenderOptions
from .plans import render
from .sources import pdf, pdf_writer as writer
from .session import spread
from .streaming.ingest import page_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def put_in(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def put_in_sql(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    return text


def sub(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(new)}, 'g')"


# ---- SQL of the cleanup stages

TRIM = r"\A\s+|\s+\z"
HAN = r"\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}"


def toc_sql(t: str) -> str:
    def one(line: str) -> str:
        for pattern, after, plain in ((r"\s+\.{8,}\s*(\d+)?\s+", " ", " "), (r"\s*\.{4,}\s*(\d+)?\s*$", "", "")):
            line = f"replace(replace({sub(line, pattern, chr(1) + r' (p.\1)' + after + chr(1))}, {sql_text(chr(1) + ' (p.)' + after + chr(1))}, {sql_text(plain)}), {sql_text(chr(1))}, '')"
        return line

    return f"array_to_string(list_transform(string_split(regexp_replace({t}, '\\r?\\n\\z', ''), chr(10)), lambda l: {one('l')}), chr(10))"


def list_sql(t: str) -> str:
    t = sub(t, r"([•\-■□▪▸►◆◇➤✓✗])\s*\n\s*", r"\1 ")
    for pattern in (r"(\d{1,3}[.)]\s*)\n\s*", r"(\(\d{1,3}\)\s*)\n\s*", r"([가-힣][.)]\s*)\n\s*"):
        t = sub(t, pattern, r"\1")
    return sub(t, r"([❶-❿])\s*\n\s*", r"\1 ")


def cjk_sql(t: str) -> str:
    return f"replace({sub(sub(t, chr(10) + '{2,}', chr(2)), rf'([{HAN}])([^.。!?！？\n]?)\n([{HAN}])', r'\1\2\3')}, {sql_text(chr(2))}, {sql_text(chr(10) * 2)})"


def newlines_sql(t: str) -> str:
    t = sub(t, r"(?m)^(#{1,6}\s|[-*]\s|[0-9]+\.\s|\|)", chr(3) + r"\1")
    t = sub(sub(t, r"\n{2,}", chr(4)), r"([.。!?！？])\s*\n", r"\1" + chr(5))
    return f"replace(translate(replace({t}, chr(10), ' '), {sql_text(chr(5) + chr(3))}, {sql_text(chr(10) * 2)}), {sql_text(chr(4))}, {sql_text(chr(10) * 2)})"


def punctuation_sql(t: str) -> str:
    return rf"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '[\p{{L}}\p{{N}}]') OR regexp_matches(l, '^\s*(!\[|#|$)') THEN l ELSE '' END), chr(10))"


STAGES_SQL = {
    "ligatures": lambda t: put_in_sql(t, cl.LIGATURES.items()),
    "bullets": lambda t: f"translate({t}, '{cl.BULLETS}', '{'•' * len(cl.BULLETS)}')",
    "private_use": lambda t: sub(t, r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", ""),
    "replacement_chars": lambda t: f"replace({t}, '�', '')",
    "page_number_lines": lambda t: sub(t, r"(?m)^[\s]*[-–—]?\s*\d+\s*[-–—]?\s*$", ""),
    "toc_leaders": toc_sql,
    "dehyphenate": lambda t: sub(t, r"([a-zA-Z])-\s*\n?\s*([a-z])", r"\1\2"),
    "list_markers": list_sql,
    "cjk_lines": cjk_sql,
    "single_newlines": newlines_sql,
    "punctuation_lines": punctuation_sql,
    "spaces": lambda t: sub(t, " {3,}", "  "),
    "newline_cap": lambda t: sub(t, r"\n{3,}", "\n\n"),
    "nfc": lambda t: f"nfc_normalize({t})",
}
STAGES = {name: getattr(cl, name) for name in STAGES_SQL} | {"newline_cap": lambda t: cl.newline_cap(t, 2)}
ARTEFACTS = {
    "nfc": [("é", "é"), ("ü", "ü")],
    "ligatures": [("th", "ﬁ"), ("on", "ﬄ"), ("es", "ﬆ")],
    "bullets": [("\n", "\n● "), (", ", " ▪ ")],
    "private_use": [("en", "en"), ("er", "\U000f0000er")],
    "replacement_chars": [("an", "a�n")],
    "page_number_lines": [(". ", ".\n - 12 -\n"), (", ", "\n7\n")],
    "toc_leaders": [(", ", " ............ 12 "), ("\n", " ......\n"), (". ", " ......... "), (" in ", " ........ 5 ........ ")],
    "dehyphenate": [("e a", "e-\n a"), ("ti", "t-i"), ("on", "o- n")],
    "list_markers": [(", ", " •\n "), (". ", " 12.\n"), (" in ", " (3)\n "), (" de ", " 가.\n"), (" und ", " ❷ \n ")],
    "cjk_lines": [(", ", "지키\n십시오"), (". ", "漢。\n字"), (" in ", "か\n\nな")],
    "single_newlines": [(", ", "\n"), (". ", ".\n\n# H\n"), (" in ", "\n- x\n| a |\n")],
    "punctuation_lines": [(", ", "\n- - ,\n"), (". ", "\n![\n# \n")],
    "spaces": [(", ", "     "), (". ", "   ")],
    "newline_cap": [(". ", ".\n\n\n\n"), (", ", "\n\n\n")],
}
EVERYTHING = [(". ", ".\n\n\n\n"), (", ", " ●\n"), (" in ", " ........... 12 "), (" de ", "-\n"), (" und ", "漢\n字"), ("the", "tﬁe"), (" of ", "\n 12 \n"), (" is ", "     ")]


def _stage(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = STAGES[name](put_in(F.col("text"), ARTEFACTS[name]))
        return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))

    run.__name__ = f"cleanup_{name}"
    return run


for _name, _sql in STAGES_SQL.items():
    query(f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_sql(put_in_sql('text', ARTEFACTS[_name]))} AS t FROM documents)")(_stage(_name))


def _standard_sql(t: str) -> str:
    for name in ("nfc", "ligatures", "bullets", "replacement_chars", "page_number_lines", "toc_leaders", "dehyphenate", "list_markers", "cjk_lines", "single_newlines", "punctuation_lines", "spaces", "newline_cap"):
        t = STAGES_SQL[name](t)
    return sub(t, TRIM, "")


@query(f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_standard_sql(put_in_sql('text', EVERYTHING))} AS t FROM documents)")
def cleanup_standard(spark, sf_dir):
    text = cl.clean(put_in(F.col("text"), EVERYTHING), CleanupOptions())
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(f"""SELECT doc_id, md5(h || chr(10) || {sub(sub('b', ' {3,}', '  '), TRIM, '')}) AS digest
FROM (SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) AS h, nfc_normalize(replace(text, ', ', '     ')) AS b FROM documents)""")
def cleanup_frontmatter(spark, sf_dir):
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n"))
    text = cl.clean(F.concat(head, F.replace("text", F.lit(", "), F.lit("     "))), CleanupOptions.preset("minimal"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("digest"))


WORDS_SQL = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''))"


@query(f"""SELECT doc_id, n AS char_count, w AS word_count, r AS replacement_char_count, n > 0 AND r / greatest(n, 1) < 0.3 AS is_good
FROM (SELECT doc_id, length(t) AS n, {WORDS_SQL.format(t='t')} AS w, length(t) - length(replace(t, '�', '')) AS r FROM (SELECT doc_id, {put_in_sql('text', [('th', '�'), ('e', '��')])} AS t FROM documents))""")
def quality_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", put_in(F.col("text"), [("th", "�"), ("e", "��")]).alias("text"))
    out = quality.text_quality(rows)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("char_count", "word_count", "replacement_char_count")], "is_good")


COHERENCE_SQL = r"""SELECT {keys}, chars, CASE WHEN chars >= 40 AND tokens > 0 THEN round(likes / tokens, 6) END AS word_like, CASE WHEN chars >= 40 AND tokens > 0 THEN round(coherent / chars, 6) END AS coherent
FROM (SELECT {keys}, length(regexp_replace(t, '\s', '', 'g')) AS chars, length(t) - length(regexp_replace(t, '[\p{{L}}\p{{N}}]', '', 'g')) AS coherent,
len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS tokens, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(w) >= 2 AND regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS likes
FROM (SELECT {keys}, {text} AS t FROM {table}))"""


def _coherence(spark, sf_dir, name, keys, pairs):
    m = tf.coherence(put_in(F.col("text"), pairs))
    rows = table(spark, sf_dir, name).select(*keys, m.alias("m"))
    return rows.select(*keys, F.col("m.chars").cast("long").alias("chars"), F.round("m.word_like", 6).alias("word_like"), F.round("m.coherent", 6).alias("coherent"))


NOISE = [("th", " % "), ("e", "$"), ("a", " ~")]


@query(COHERENCE_SQL.format(keys="doc_id", text=put_in_sql("text", NOISE), table="documents"))
def ocr_coherence_documents(spark, sf_dir):
    return _coherence(spark, sf_dir, "documents", ["doc_id"], NOISE)


@query(COHERENCE_SQL.format(keys="conv_id, turn", text="text", table="conversations"))
def ocr_coherence_conversations(spark, sf_dir):
    return _coherence(spark, sf_dir, "conversations", ["conv_id", "turn"], [])


@query(r"SELECT conv_id, turn, md5(regexp_replace(replace(replace(text, 'e', '*'), 'a', '[x]|\'), '([\\`*_\[\]|])', '\\\1', 'g')) AS digest FROM conversations")
def markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tf.escape_markdown(put_in(F.col("text"), [("e", "*"), ("a", "[x]|\\")]))).alias("digest"))


@query(r"""SELECT doc_id, '---' || chr(10) || 'title: "' || replace(replace(source || '\"x', '\', '\\'), '"', '\"') || '"' || chr(10) || CASE WHEN lang IS NULL THEN '' ELSE 'author: "' || lang || '"' || chr(10) END
|| CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'keywords: "k' || doc_id || '"' || chr(10) END || 'pages: ' || n_chars || chr(10) || '---' || chr(10) AS frontmatter FROM documents""")
def frontmatter(spark, sf_dir):
    keywords = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("k"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", tf.frontmatter(F.concat("source", F.lit('\\"x')), F.col("lang"), keywords, F.col("n_chars")).alias("frontmatter"))


def _roman_sql(n: str) -> str:
    """Each numeral as often as it goes into what the larger ones leave."""
    parts = []
    for value, symbol in tf.ROMAN:
        parts.append(f"repeat('{symbol}', CAST(floor({n} / {value}) AS INT))")
        n = f"{n} % {value}"
    return f"concat({', '.join(parts)})"


@query(f"SELECT p_partkey, n, r AS roman, n || '.' AS decimal_marker, lower(r) || '.' AS roman_marker, chr(CAST(97 + n % 26 AS INT)) || '.' AS alpha_marker FROM (SELECT p_partkey, n, {_roman_sql('n')} AS r FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part))")
def list_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3999 + 1).alias("n"))
    n = F.col("n")
    return rows.select(
        "p_partkey", "n", tf.roman(n).alias("roman"), tf.list_number(n, F.lit("decimal")).alias("decimal_marker"), tf.list_number(n, F.lit("lower_roman")).alias("roman_marker"),
        tf.list_number(n % 26 + 1, F.lit("lower_alpha")).alias("alpha_marker"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) END::TIMESTAMP AS parsed FROM orders""")
def pdf_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), F.lit("+09'00'"))).when(k == 1, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd"))).when(k == 2, F.concat(F.lit("D:"), F.date_format(d, "yyyy"))).otherwise("D:20241399")
    return table(spark, sf_dir, "orders").select("o_orderkey", tf.pdf_date(shown).cast("timestamp_ntz").alias("parsed"))


@query("SELECT doc_id, page FROM (SELECT doc_id, unnest(range(1, 13)) AS page FROM documents) WHERE page IN (1, 3, 7, 8, 9, 10)")
def page_select(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("page"))
    return rows.where(PageSelection.parse("1,3, 7-10").column(F.col("page")))


SIGNED = ["FFD8FFE000104A46", "89504E470D0A1A0A00", "4749463839610000", "49492A0000000000", "4D4D002A00000000", "424D000000000000", "524946460000000057454250", "0000000C6A502020", "25504446", "0102030405060708"]
KINDS = [("image/jpeg", "jpg"), ("image/png", "png"), ("image/gif", "gif"), ("image/tiff", "tiff"), ("image/tiff", "tiff"), ("image/bmp", "bmp"), ("image/webp", "webp"), ("image/jp2", "jp2"), (None, None), (None, None)]


@query("SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(KINDS) if k[0]) + " END AS mime, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{k[1]}'" for i, k in enumerate(KINDS) if k[0]) + " END AS extension FROM documents")
def mime_sniff(spark, sf_dir):
    data = F.unhex(F.element_at(F.array(*[F.lit(s) for s in SIGNED]), (F.col("doc_id") % 10 + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", tf.sniff_mime(data).alias("mime"))
    return rows.select("doc_id", "mime", F.when(F.col("mime").isNotNull(), tf.extension_of(F.col("mime"))).alias("extension"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1.7' WHEN 1 THEN NULL ELSE NULL END AS version, doc_id % 3 = 0 AS is_pdf FROM documents")
def format_detect(spark, sf_dir):
    head = F.element_at(F.array(F.lit("%PDF-1.7\n"), F.lit("%PDF-x.7\n"), F.lit("PK")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = pdf.detect(table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(head, "text"), "UTF-8").alias("content")))
    return rows.select("doc_id", F.col("format.version").alias("version"), "is_pdf")


@query(r"""SELECT doc_id, length(t) > 0 AND (length(t) - length(regexp_replace(t, '[\x{1}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{80}-\x{9F}\x{E000}-\x{F8FF}]', '', 'g'))) / greatest(length(t), 1) > 0.3 AS is_binary
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'e', chr(1)), 'a', chr(144)) ELSE text END AS t FROM documents)""")
def binary_heuristic(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, put_in(F.col("text"), [("e", "\x01"), ("a", "\x90")])).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tf.is_likely_binary(text).alias("is_binary"))


@query(r"SELECT conv_id, turn, regexp_matches(CASE WHEN turn % 2 = 0 THEN replace(text, 'e', 'ש') ELSE text END, '[\x{590}-\x{7FF}]') AS rtl FROM conversations")
def rtl_detect(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tf.contains_rtl(F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("e"), F.lit("ש"))).otherwise(F.col("text"))).alias("rtl"))


MARKS = ["- 3 -", "Page 12", "2 / 10", "4 of 9", "17", "Chapter 3", "- a -", "10 11"]


@query("SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 < 5 AS is_page_number, (l_orderkey + l_linenumber) % 8 = 4 AS is_number_marker FROM lineitem")
def page_number_spans(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(m) for m in MARKS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), text.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", tf.is_page_number(F.col("t")).alias("is_page_number"), (tf.is_number_marker(F.col("t")) & ~F.col("t").contains(" ")).alias("is_number_marker"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY octet_length(encode(text)), left_part, right_part) AS first_doc_id
FROM (SELECT doc_id, text, array_slice(encode(text), 1, 64) AS left_part, CASE WHEN octet_length(encode(text)) > 64 THEN array_slice(encode(text), octet_length(encode(text)) - 63, octet_length(encode(text))) END AS right_part FROM documents)""")
def content_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return quality.dedup_by_content(rows, "data", ["doc_id"], [], "doc_id").select("doc_id", "first_doc_id")


@query(f"""SELECT lang, count(*) AS documents, sum(length(text)) AS chars, sum({WORDS_SQL.format(t='text')}) AS words, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS visible FROM documents GROUP BY lang""")
def stats_by_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(tf.word_count(F.col("text"))).alias("words"), F.sum(F.length(F.regexp_replace("text", r"(?U)\s", ""))).alias("visible"))


@query("""WITH c AS (SELECT l_suppkey, CAST(trunc(l_quantity * 10) AS INT) AS k, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, arg_max(k, n * 100000 + k) AS body FROM c GROUP BY l_suppkey)
SELECT b.l_suppkey AS l_suppkey, body / 10 AS body_size, count(c.k) AS larger FROM b LEFT JOIN c ON c.l_suppkey = b.l_suppkey AND c.k / 10 > body / 10 + 0.5 GROUP BY ALL""")
def font_body_size(spark, sf_dir):
    out = layout.font_statistics(table(spark, sf_dir, "lineitem"), ("l_suppkey",), "l_quantity")
    return out.select("l_suppkey", "body_size", F.size("heading_sizes").cast("long").alias("larger"))


def _synthetic_lines(spark, sf_dir):
    """Orders as pages, line items as lines; quantities make the sizes and gaps."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", order.alias("line_ord"), F.concat(F.lit("Line item "), F.col("l_partkey").cast("string")).alias("text"), "l_quantity")
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "line_ord", "text", F.when(F.col("l_quantity") > 40, 60.0).otherwise(10.0).cast("float").alias("x"),
        (F.lit(800.0) - F.col("line_ord") * 12 - F.when(F.col("l_quantity") < 10, 40.0).otherwise(0.0)).cast("float").alias("y"),
        F.when(F.col("l_quantity") > 45, 18.0).when(F.col("l_quantity") > 30, 14.0).otherwise(12.0).cast("float").alias("font_size"), F.lit(False).alias("bold"), F.lit(12.0).alias("body_size"), F.array(F.lit(18.0), F.lit(14.0)).alias("heading_sizes"))


LINES_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem), l AS (SELECT l_orderkey AS doc_id, k AS line_ord, CASE WHEN l_quantity > 40 THEN 60.0 ELSE 10.0 END AS x, 800.0 - k * 12 - CASE WHEN l_quantity < 10 THEN 40.0 ELSE 0.0 END AS y,
CASE WHEN l_quantity > 45 THEN 18.0 WHEN l_quantity > 30 THEN 14.0 ELSE 12.0 END AS s FROM n), h AS (SELECT *, CASE WHEN s >= 14.5 AND NOT (coalesce(abs(lag(s) OVER w - s) < 0.5, false) OR coalesce(abs(lead(s) OVER w - s) < 0.5, false)) THEN 1
WHEN s = 18 THEN 1 ELSE 0 END AS level FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_ord))"""


@query(f"WITH {LINES_SQL} SELECT doc_id, CAST(line_ord AS BIGINT) AS line_ord, CAST(level AS BIGINT) AS heading_level FROM h")
def heading_context(spark, sf_dir):
    return layout.mark_headings(_synthetic_lines(spark, sf_dir)).select("doc_id", F.col("line_ord").cast("long").alias("line_ord"), F.col("heading_level").cast("long").alias("heading_level"))


@query(f"""WITH {LINES_SQL}, g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(s) OVER w AS ps, lag(level) OVER w AS pl, abs(lag(y) OVER w - y) AS gap FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_ord)),
a AS (SELECT *, coalesce(avg(CASE WHEN gap > 0.1 THEN gap END) OVER (PARTITION BY doc_id), 12.0) AS av FROM g),
b AS (SELECT *, CASE WHEN py IS NULL THEN 1 WHEN level > 0 THEN CASE WHEN pl > 0 AND abs(ps - s) <= 2 AND gap <= greatest(greatest(ps, s) * 2.5, av * 2) THEN 0 ELSE 1 END
WHEN pl > 0 OR gap > av * 1.5 OR abs(ps - s) >= 2 OR abs(px - x) > 40 THEN 1 ELSE 0 END AS st FROM a)
SELECT doc_id, CAST(line_ord AS BIGINT) AS line_ord, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY line_ord) - 1 AS BIGINT) AS block_ord FROM b""")
def block_islands(spark, sf_dir):
    return layout.number_blocks(layout.mark_headings(_synthetic_lines(spark, sf_dir))).select("doc_id", F.col("line_ord").cast("long").alias("line_ord"), F.col("block_ord").cast("long").alias("block_ord"))


# ---- files written from the tables and read back

PER_PAGE = 40
LINES_OF = "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ ]')) AS ls FROM documents"
PAGES_SQL = f"lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM ({LINES_OF})), pages AS (SELECT doc_id, line, CAST(k // {PER_PAGE} AS BIGINT) + 1 AS page, k % {PER_PAGE} AS spot FROM lines)"


def _document_files(spark, sf_dir, options=None):
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return writer.pdf_of_lines(rows, options, PER_PAGE)


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, count(*) AS text_op_count, CAST(0 AS BIGINT) AS image_op_count, 'text' AS page_class FROM pages GROUP BY ALL UNION ALL SELECT doc_id, 1, 0, 0, 'blank' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pages)")
def pdf_page_stats(spark, sf_dir):
    out = quality.classify_pages(pdf.pages(pdf.parse_files(_document_files(spark, sf_dir), ParseOptions(layout=False))))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "text_op_count", "image_op_count", "page_class")


ROUND_SQL = f"WITH {PAGES_SQL} SELECT doc_id, page, CAST(spot AS BIGINT) AS span_ord, line AS text FROM pages"


def _round(spark, sf_dir, options):
    out = pdf.spans(pdf.parse_files(_document_files(spark, sf_dir, options), ParseOptions(layout=False)))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("span_ord").cast("long").alias("span_ord"), "text")


@query(ROUND_SQL)
def pdf_text_roundtrip(spark, sf_dir):
    return _round(spark, sf_dir, None)


@query(ROUND_SQL)
def pdf_compressed_roundtrip(spark, sf_dir):
    return _round(spark, sf_dir, writer.WriterOptions(compress=True, predictor=True))


@query(ROUND_SQL)
def pdf_object_stream_roundtrip(spark, sf_dir):
    return _round(spark, sf_dir, writer.WriterOptions(compress=True, xref_stream=True))


@query(ROUND_SQL)
def pdf_encrypted_roundtrip(spark, sf_dir):
    return _round(spark, sf_dir, writer.WriterOptions(encrypt=True))


JOINED_SQL = f"WITH {PAGES_SQL}, t AS (SELECT doc_id, page, string_agg(line, ' ' ORDER BY spot) AS body FROM pages GROUP BY ALL)"


@query(JOINED_SQL + r" SELECT doc_id, md5('') AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pages) UNION ALL SELECT doc_id, md5(regexp_replace(string_agg(regexp_replace(body, '([\\`*_\[\]|])', '\\\1', 'g'), chr(10) || chr(10) ORDER BY page), '\A\s+|\s+\z', '', 'g')) AS digest FROM t GROUP BY doc_id")
def pdf_markdown(spark, sf_dir):
    parsed = pdf.parse_files(_document_files(spark, sf_dir)).persist()
    out = render.markdown(parsed, layout.page_blocks(parsed), RenderOptions(cleanup=None))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("markdown").alias("digest"))


@query(JOINED_SQL + " SELECT doc_id, CAST(sum(length(body) + 1) AS BIGINT) AS char_count, CAST(sum(" + WORDS_SQL.format(t="body") + ") AS BIGINT) AS word_count, false AS is_scan_pdf, true AS is_good FROM t GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, false, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pages)")
def pdf_quality(spark, sf_dir):
    parsed = pdf.parse_files(_document_files(spark, sf_dir)).persist()
    out = quality.document_quality(parsed, layout.page_blocks(parsed))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "char_count", "word_count", "is_scan_pdf", "is_good")


@query(f"WITH {PAGES_SQL}, n AS (SELECT doc_id, greatest(1, max(page)) AS p FROM (SELECT doc_id, page FROM pages UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY doc_id) SELECT doc_id, p AS page_parsed, CAST(ceil(p / 16) AS BIGINT) AS progress FROM n")
def pdf_page_events(spark, sf_dir):
    out = page_events(pdf.parse_files(_document_files(spark, sf_dir))).groupBy("doc_id").agg(F.count_if(F.col("event") == "page_parsed").alias("page_parsed"), F.count_if(F.col("event") == "progress").alias("progress"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "page_parsed", "progress")


SPAN_KIND = "array<array<struct<x:double,y:double,size:double,font:string,text:string>>>"


def _grid(rows: DataFrame, key: Column, order: Column, columns: list[str], per_page: int = 25) -> DataFrame:
    """(doc_id, pages): rows of a table as a grid of spans, one file a key."""
    numbered = rows.select(key.alias("doc_id"), order.alias("o"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"))
    own = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("o", "cells"))).alias("rows"))
    span = lambda c, j, i: F.struct((F.lit(60.0) + j * 170).alias("x"), (F.lit(760.0) - (i % per_page) * 18).alias("y"), F.lit(10.0).alias("size"), F.lit("Helvetica").alias("font"), c.alias("text"))
    flat = F.flatten(F.transform("rows", lambda r, i: F.transform(r["cells"], lambda c, j: span(c, j, i))))
    return own.select("doc_id", F.array(flat).cast(SPAN_KIND).alias("pages"))


@query("""WITH n AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, n_nationkey, n_name FROM nation)
SELECT n_regionkey AS region, r AS row_no, 0 AS col, n_nationkey::VARCHAR AS text FROM n UNION ALL SELECT n_regionkey, r, 1, n_name FROM n UNION ALL SELECT n_regionkey, r, 2, n_regionkey::VARCHAR FROM n""")
def pdf_table_roundtrip(spark, sf_dir):
    grid = _grid(table(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"])
    cells = render.table_cells(layout.page_blocks(pdf.parse_files(writer.pdf_of_spans(grid))))
    return cells.select(F.col("doc_id").cast("int").alias("region"), F.col("row").cast("long").alias("row_no"), "col", "text")


@query("""WITH n AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation)
SELECT n_regionkey AS region, string_agg(CASE WHEN r = 1 THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY r) AS markdown FROM n GROUP BY ALL""")
def pdf_table_markdown(spark, sf_dir):
    grid = _grid(table(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"])
    parsed = pdf.parse_files(writer.pdf_of_spans(grid))
    return render.markdown(parsed, layout.page_blocks(parsed), RenderOptions(cleanup=None)).select(F.col("doc_id").cast("int").alias("region"), "markdown")


def _titled(spark, sf_dir):
    """One small file a customer: title, date, bookmarks and a form come from its row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for r in batch.to_pylist():
                o = writer.WriterOptions(
                    xref_stream=r["c_custkey"] % 2 == 0, encrypt=r["c_custkey"] % 3 == 0 and r["c_custkey"] % 2 == 1, info={"Title": r["c_name"], "Keywords": r["c_mktsegment"], "CreationDate": f"D:{2000 + r['c_custkey'] % 25:04d}0102030405"},
                    outline=[("First", 1), (r["c_name"], 2)], fields=[("name", "Tx", r["c_name"]), ("agreed", "Btn", "Yes" if r["c_custkey"] % 2 else "Off"), ("note", "Tx", "")])
                made.append(writer.write_pdf([[(72, 700, 12, "Helvetica", r["c_name"])], [(72, 700, 12, "Helvetica-Bold", r["c_mktsegment"])]], o))
            yield pa.RecordBatch.from_arrays([batch.column("c_custkey").cast(pa.string()), pa.array(made, pa.binary())], ["doc_id", "content"])

    from .session import importable

    importable(spark)
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    return pdf.parse_files(rows.mapInArrow(run, "doc_id string, content binary"))


@query("SELECT c_custkey, c_name AS title, c_mktsegment AS keywords, make_timestamp(2000 + c_custkey % 25, 1, 2, 3, 4, 5) AS created, CAST(2 AS BIGINT) AS page_count, c_custkey % 6 = 3 AS encrypted FROM customer")
def pdf_metadata(spark, sf_dir):
    return pdf.metadata(_titled(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("c_custkey"), "title", "keywords", F.col("created").cast("timestamp_ntz").alias("created"), F.col("page_count").cast("long").alias("page_count"), "encrypted")


@query("SELECT c_custkey, CAST(0 AS BIGINT) AS item_id, 'First' AS title, CAST(1 AS BIGINT) AS page FROM customer UNION ALL SELECT c_custkey, 1, c_name, 2 FROM customer")
def pdf_outline(spark, sf_dir):
    return pdf.outline(_titled(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("c_custkey"), F.col("item_id").cast("long").alias("item_id"), "title", F.col("page").cast("long").alias("page"))


@query("""SELECT c_custkey, 'name' AS name, 'text' AS type, c_name AS display FROM customer UNION ALL SELECT c_custkey, 'agreed', 'checkbox', CASE WHEN c_custkey % 2 = 1 THEN '[x]' ELSE '[ ]' END FROM customer
UNION ALL SELECT c_custkey, 'note', 'text', '' FROM customer""")
def pdf_form_fields(spark, sf_dir):
    return pdf.form_fields(_titled(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("c_custkey"), "name", "type", "display")


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS page, c_name AS text, 'Helvetica' AS font_name, false AS is_bold FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment, 'Helvetica-Bold', true FROM customer")
def pdf_spans(spark, sf_dir):
    return pdf.spans(_titled(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("c_custkey"), F.col("page").cast("long").alias("page"), "text", "font_name", "is_bold")


@query("SELECT s_suppkey, false AS is_pdf, 'NotPdf' AS error_class FROM supplier")
def pdf_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.encode("s_name", "UTF-8").alias("content"))
    return pdf.errors(pdf.parse_files(rows, ParseOptions())).select(F.col("doc_id").cast("long").alias("s_suppkey"), F.lit(False).alias("is_pdf"), "error_class")


@query("SELECT c_custkey, c_name || chr(10) || chr(10) || c_mktsegment AS text FROM customer")
def pdf_plain_text(spark, sf_dir):
    parsed = _titled(spark, sf_dir).persist()
    return render.plain_text(parsed, layout.page_blocks(parsed), RenderOptions(cleanup=None)).select(F.col("doc_id").cast("long").alias("c_custkey"), "text")


@query("SELECT c_custkey, seq, event FROM customer, (VALUES (0, 'document_start'), (1, 'page_start'), (2, 'block'), (3, 'page_end'), (4, 'page_start'), (5, 'block'), (6, 'page_end'), (7, 'document_end')) v(seq, event)")
def pdf_render_events(spark, sf_dir):
    parsed = _titled(spark, sf_dir).persist()
    return render.render_events(parsed, layout.page_blocks(parsed)).select(F.col("doc_id").cast("long").alias("c_custkey"), "seq", "event")


@query("SELECT c_custkey, CAST(2 AS BIGINT) AS page_count, CAST(2 AS BIGINT) AS paragraph_count, CAST(0 AS BIGINT) AS table_count, CAST(length(c_name) + length(regexp_replace(c_mktsegment, '\\s', '', 'g')) AS BIGINT) AS char_count FROM customer")
def pdf_extraction_stats(spark, sf_dir):
    out = quality.extraction_stats(layout.page_blocks(_titled(spark, sf_dir)))
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), "page_count", "paragraph_count", "table_count", "char_count")


@query("SELECT c_custkey, json_extract_string(j, '$.t') AS title, CAST(2 AS BIGINT) AS pages, c_name AS first_text FROM (SELECT c_custkey, c_name, json_object('t', c_name) AS j FROM customer)")
def pdf_json(spark, sf_dir):
    parsed = _titled(spark, sf_dir).persist()
    out = render.json_documents(parsed, layout.page_blocks(parsed))
    get = lambda path: F.get_json_object("json", path)
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), get("$.metadata.title").alias("title"), get("$.page_count").cast("long").alias("pages"), get("$.pages[0].elements[0].text").alias("first_text"))


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY p) AS BIGINT) - 1 AS k, t AS rendered FROM (SELECT c_custkey, 1 AS p, c_name || chr(10) || chr(10) AS t FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment || chr(10) || chr(10) FROM customer)")
def pdf_visitors(spark, sf_dir):
    blocks = layout.page_blocks(_titled(spark, sf_dir))
    out = render.visit_blocks(blocks, [render.skip_images, render.max_heading_depth(3), render.simple_table], RenderOptions(escape_special_chars=False))
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), (F.col("page") - 1).cast("long").alias("k"), "rendered")
