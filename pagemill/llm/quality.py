"""A quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textops as tx
from .session import prepare

BITS = 20

# Byte classes of word shapes: letters by case, digits, every other ASCII character as itself, other bytes as lower case.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), sorted by both: n-grams of words (1, 2) and of word shapes (1 to 3), and repetitions.

    A word's shape is its sequence of byte classes without repetitions, so that unseen words still tell something. The
    two kinds have length one each; a feature's share is its count's square root.
    """
    rows, feats = [], []
    shape = SHAPE[buf]
    shape[tx.SPACE_BYTES[buf]] = 32
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    keep = edge[:-1].copy()
    keep[1:] |= shape[1:] != shape[:-1]
    keep_off = np.r_[0, np.cumsum(keep)][off]
    for kind, (b, o, sizes) in enumerate(((buf, off, (1, 2)), (shape[keep], keep_off, (1, 2, 3)))):
        words = tx.Words(b, o)
        h, docs = words.hashes(), words.docs()
        for size in sizes:
            at = words.windows(size)
            g = tx.gram_hash(h + np.uint64(7 * kind), size)[at] if len(at) else np.zeros(0, np.uint64)
            rows.append(docs[at])
            feats.append(((g >> np.uint64(64 - BITS + 1)) | np.uint64(kind << (BITS - 1))).astype(np.int64))
        if not kind:  # which words of each three are the same tells loops from prose, whatever the words
            at = words.windows(3)
            alike = 4 * (h[at] == h[at + 1]) + 2 * (h[at + 1] == h[at + 2]) + (h[at] == h[at + 2])
            rows.append(docs[at])
            feats.append((1 << (BITS - 1)) | alike.astype(np.int64))
    key, count = np.unique((np.concatenate(rows) << BITS) | np.concatenate(feats), return_counts=True)
    row, feat, value = key >> BITS, key & ((1 << BITS) - 1), np.sqrt(count)
    slot = row * 2 + (feat >> (BITS - 1))
    norm = np.sqrt(np.bincount(slot, value**2, 2 * len(off)))
    return row, feat, value / norm[slot]


def ftrl(examples, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2):
    """Weights and bias from (features, values, label) triples; updates are made one example after another."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            at, x, label = examples[k]
            at, x = np.r_[at, bias], np.r_[x, 1.0]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, text_bytes: int = 32 << 20, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> np.ndarray:
    """Weights (the last is the bias) learnt from a bounded sample of the labelled documents.

    In the order of a hash of the id, the first `rows` documents with a label are taken, as long as their texts together
    have no more than `text_bytes`; so the sample does not depend on how the tables are stored. Rows that repeat an id
    and its text count once. Both bounds keep the one task that fits the model small, and are all that limits it.
    """
    prepare(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("__label"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64(doc_id), doc_id).limit(rows).select(F.col(doc_id).alias("__id"), F.col("__label").cast("int").alias("__label")))
    sample = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(text).alias("__like"))
    order = [F.xxhash64("__id"), "__id", "__like"]
    sizes = sample.join(chosen, "__id").select("__id", "__like", F.octet_length("__text").alias("size")).distinct().orderBy(*order).limit(rows).collect()
    taken, total = [], 0
    for r in sizes:
        total += r["size"]
        if total <= text_bytes:
            taken.append((r["__id"], r["__like"]))
    taken = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("__id", docs.schema[doc_id].dataType), T.StructField("__like", T.LongType())]))
    sample = sample.join(F.broadcast(taken), ["__id", "__like"]).join(chosen, "__id").dropDuplicates(["__id", "__like"]).select("__id", "__text", "__label")

    def featurise(batches):
        for batch in batches:
            for rows, buf, off in tx.slices(batch, "__text", 1 << 20):
                row, feat, value = features(buf, off)
                cuts = np.searchsorted(row, np.arange(len(off)))
                for d in range(len(off) - 1):
                    own = slice(cuts[d], cuts[d + 1])
                    yield pa.RecordBatch.from_pydict({
                        "id": rows.column("__id").slice(d, 1).cast(pa.int64()), "label": rows.column("__label").slice(d, 1),
                        "feat": pa.array([feat[own].astype(np.int32).tobytes()], pa.binary()), "value": pa.array([value[own].astype(np.float32).tobytes()], pa.binary())})

    def fit(batches):
        found = sorted((r["id"], r["feat"], r["value"], r["label"]) for batch in batches for r in batch.to_pylist())
        examples = [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32).astype(float), y) for _, f, v, y in found]
        w = ftrl(examples).astype(np.float32)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array([used.astype(np.int32).tobytes()], pa.binary()), "w": pa.array([w[used].tobytes()], pa.binary())})

    out = np.zeros((1 << BITS) + 1, np.float32)
    model = sample.mapInArrow(featurise, "id long, label int, feat binary, value binary").repartition(1).mapInArrow(fit, "at binary, w binary").collect()
    for r in model:
        out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["w"], np.float32)
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) by sparse dot products over whole texts; null text counts as empty, ids pass unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded: 2**BITS + 1 numbers

    def run(batches):
        w = shared.value.astype(float)
        for batch in batches:
            for rows, buf, off in tx.slices(batch, text, 1 << 20):
                row, feat, value = features(buf, off)
                out = np.bincount(row, w[feat] * value, len(off) - 1)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(doc_id).cast(pa.int64()), "score": pa.array(1 / (1 + np.exp(-(out + w[-1]))))})

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, rows: int = 6000) -> DataFrame:
    """One row a document: doc_id, held_out, score (nearer 1: label 1 likelier) and predicted (score >= threshold).

    Labels of documents whose crc32(id as text) modulo `folds` is `held_out` are not learnt from. A null id is not held
    out. Without any labelled row all scores are 0.5. Rows of equal id are scored one by one; documents and labels of
    equal id all match, the larger label counts. Empty tables give empty results; other columns are not read.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out
    weights = train(docs, labels.where(~fold), rows)
    out = score(docs, weights)
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
