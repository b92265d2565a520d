"""From raw documents to packed token windows: five stages, each one operator over all rows its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm.langid import learn, predict
from pagemill.llm.lines import dedup_lines
from pagemill.llm.packing import pack_documents
from pagemill.llm.session import prepare
from pagemill.llm.simhash import simhash_groups
from pagemill.llm.substring import dedup_substrings

# No SQL can express n-gram filters or tokenisation; tests/llm holds every stage against a plain version of its rule.
ORACLE_SQL = None


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that no operator adds, so that none of its columns is replaced, and these names."""
    own = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def _shown(out: DataFrame, docs: DataFrame, own: dict[str, str], recount: bool = False) -> DataFrame:
    """The columns of docs again; with `recount`, n_chars follows the changed text."""
    if recount and "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(n).alias(c) for c, n in own.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learnt language; a missing lang is filled in. Null text and text without a letter go."""
    hidden, own = _hidden(docs)
    text, lang, doc_id = (own[c] for c in ("text", "lang", "doc_id"))
    fold = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
    found = predict(hidden, learn(hidden.where(~fold), text=text, lang=lang, doc_id=doc_id), text=text)
    return _shown(found.where("lang_pred <> 'und'").withColumn(lang, F.coalesce(lang, "lang_pred")), docs, own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go (see dedup_lines), and documents of which nothing is left."""
    hidden, own = _hidden(docs)
    out = dedup_lines(hidden, run=3, words=8, text=own["text"], doc_id=own["doc_id"])
    return _shown(out.where("n_lines > n_removed"), docs, own, recount=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 256-bit fingerprints of five-word shingles agree in 0.8 of their bits, and whose sets of
    shingles have an exact Jaccard index of 0.8, the one of smallest doc_id stays.

    Rows that share a doc_id are one document: they stay or go together, repeated rows included.
    """
    hidden, own = _hidden(docs)
    doc_id = own["doc_id"]
    groups = simhash_groups(hidden, shingle=5, radius=51, lanes=4, jaccard=0.8, text=own["text"], doc_id=doc_id)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return _shown(hidden.join(kept, F.col(doc_id).eqNullSafe(F.col("kept")), "left_semi"), docs, own)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows of twenty go; so do documents of which nothing is left."""
    hidden, own = _hidden(docs)
    out = dedup_substrings(hidden, window=20, text=own["text"], doc_id=own["doc_id"])
    return _shown(out.where("n_words > n_removed"), docs, own, recount=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("substring_dedup", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back as the next one's input.

    A stage's folder is removed once its successor is written; the last one holds the result.
    """
    context = prepare(spark).sparkContext
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            done = context._jvm.org.apache.hadoop.fs.Path(before)
            done.getFileSystem(context._jsc.hadoopConfiguration()).delete(done, True)
        before = path
    return docs
