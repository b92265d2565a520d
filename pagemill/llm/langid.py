"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from . import textops as tx
from .session import prepare

SIZES = (3, 5)
HASHES = 2
CELL_BITS = 20
GRAMS = 30_000
CHOSEN_ROWS = 1 << 20  # so many ids and labels are broadcast at most; a longer list is joined by shuffling ids

# ASCII bytes that are no letters count as one separator.
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91], FOLD[97:123], FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def grams(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of each run of `size` folded bytes of one document that is not all separators."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    folded = FOLD[buf]
    code = np.full(n, size, np.uint64)
    blank = np.ones(n, bool)
    for j in range(size):
        code = (code << np.uint64(8)) | folded[j : j + n]
        blank &= folded[j : j + n] == 32
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    ok = (np.arange(size, n + size) <= off[row + 1]) & ~blank
    return row[ok], code[ok]


def _cells(code: np.ndarray, which: int) -> np.ndarray:
    return (tx.mix(code + np.uint64(which * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Filters:
    """For each cell a byte of every slice of eight languages; a language's bit is set in all cells of its n-grams."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = sorted(by_lang)
        self.slices = np.zeros((-(-max(1, len(self.langs)) // 8), 1 << CELL_BITS), np.uint8)
        for i, lang in enumerate(self.langs):
            for h in range(HASHES):
                self.slices[i // 8, _cells(by_lang[lang], h)] |= np.uint8(1 << (i % 8))
        fill = np.unpackbits(self.slices[:, :, None], axis=2, bitorder="little").mean(1).ravel()[: len(self.langs)]
        self.false_rate = fill**HASHES

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each document and language the n-grams that the filters give, less the expected false positives."""
        n, out, total = len(off) - 1, np.zeros((len(off) - 1, len(self.langs))), np.zeros(len(off) - 1)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
        for size in SIZES:
            row, code = grams(buf, off, size)
            total += np.bincount(row, minlength=n)
            cells = [_cells(code, h) for h in range(HASHES)]
            for s, plane in enumerate(self.slices):
                mask = plane[cells[0]]
                for c in cells[1:]:
                    mask &= plane[c]
                seen = np.bincount(row * 256 + mask, minlength=n * 256).reshape(n, 256) @ bits
                own = slice(8 * s, min(8 * s + 8, len(self.langs)))
                out[:, own] += seen[:, : own.stop - own.start]
        return np.maximum(0, (out - total[:, None] * self.false_rate) / (1 - self.false_rate))


def learn(docs: DataFrame, per_lang: int = 1500, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", n_grams: int = GRAMS) -> dict[str, np.ndarray]:
    """The n-gram codes of each value of lang, from at most `per_lang` documents of it, chosen by a hash of the id.

    A language keeps its `n_grams` most frequent n-grams of each size but those that another language uses more than
    twice as often. Both bounds are parameters; every language is learnt. Texts do not travel, only n-gram counts do.
    """
    prepare(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    known = known.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    sizes = known.groupBy("lang").count()
    n_langs = sizes.count()
    small = F.broadcast if n_langs * (per_lang + 1) <= CHOSEN_ROWS else (lambda rows: rows)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)
    chosen = known.select("id", "lang", draw.alias("h")).join(small(sizes), "lang")
    # slightly more than are wanted, evenly drawn, so that the exact cut sees few rows whatever a language's size
    chosen = chosen.where(F.col("h") * F.col("count") < per_lang + 4 * per_lang**0.5 + 8)
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("k") <= per_lang)
    sample = known.join(small(chosen.select("id", "lang").distinct()), ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        for batch in batches:
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            for k, name in enumerate(names):
                rows = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column("text").take(pa.array(np.flatnonzero(which == k))))], ["t"])
                for _, buf, off in tx.slices(rows, "t", 1 << 19):
                    for size in SIZES:
                        code, times = np.unique(grams(buf, off, size)[1], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(code), pa.string()), "size": pa.array(np.full(len(code), size, np.int32)), "code": pa.array(code.view(np.int64)), "n": pa.array(times)})

    counts = sample.mapInArrow(count, "lang string, size int, code long, n long").groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))
    kind = Window.partitionBy("lang", "size")
    often = counts.withColumn("share", F.col("n") / F.sum("n").over(kind)).withColumn("k", F.row_number().over(kind.orderBy(F.desc("n"), "code"))).where(F.col("k") <= n_grams)
    own = often.withColumn("top", F.max("share").over(Window.partitionBy("code"))).where("share >= 0.5 * top")
    found = own.groupBy("lang").agg(F.sort_array(F.collect_list("code")).alias("codes")).collect()  # bounded: n_grams of each size a language
    return {r["lang"]: np.array(r["codes"], np.int64).view(np.uint64) for r in found}


def predict(docs: DataFrame, by_lang: dict[str, np.ndarray], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs' columns plus lang_pred and score; see `identify`."""
    shared = docs.sparkSession.sparkContext.broadcast(by_lang)  # bounded: n_grams numbers of each size a language
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        filters = Filters(shared.value)
        names = np.array([*filters.langs, "und"], object)
        for batch in batches:
            for rows, _, _ in tx.slices(batch, text, 1 << 20):
                column = rows.column(text)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best, score = np.full(len(letters), len(filters.langs)), np.zeros(len(letters))
                if filters.langs:
                    counts = filters.counts(*tx.flat(pc.utf8_lower(column)))
                    best, score = counts.argmax(1), counts.max(1) / np.maximum(counts.sum(1), 1e-9)
                best[~letters], score[~letters] = len(filters.langs), 0.0
                out = pa.Table.from_batches([rows]).append_column("lang_pred", pa.array(names[best], pa.string()))
                yield from out.append_column("score", pa.array(np.clip(score, 0, 1))).to_batches()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, per_lang: int = 1500) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred and score (the language's share of all filter hits).

    Learnt from documents whose crc32(id as text) modulo `folds` is not `held_out` and whose lang is not null. Null text
    and text without a letter give `und` and 0; so does all text if nothing could be learnt. Text with letters but no
    known n-gram goes to the first language, with score 0; ties go to the first in alphabetical order. A null id is
    neither held out nor learnt from. Rows of equal id are predicted one by one. Empty tables give empty results.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out
    model = learn(docs.where(~fold), per_lang)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
