"""Packing of documents into token windows, neighbours chosen by a sharded BM25 index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as tx
from .bpe import shared_encoder
from .session import prepare

SHARD_BYTES = 2 << 20
PART_BYTES = 64 << 20
K1, B = 1.2, 0.75
DF_BITS = 18
N_DOCS, N_WORDS, N_BYTES = -1, -2, -3  # rows of the statistics beside the cells


class Corpus:
    """Statistics over all documents, of fixed size: document frequencies in 2**DF_BITS cells by word hash (words that
    share a cell count together, so none counts too low), number of documents, mean words, bytes."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        total = lambda kind: int(counts[cells == kind].sum())
        self.docs, self.bytes = total(N_DOCS), total(N_BYTES)
        self.mean = max(1e-9, total(N_WORDS) / max(1, self.docs))
        self.df = np.zeros(1 << DF_BITS, np.int64)
        self.df[cells[cells >= 0]] = counts[cells >= 0]
        self.weight = np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))

    def frequency(self, hashes: np.ndarray) -> np.ndarray:
        return self.df[_cell(hashes)]

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        return self.weight[_cell(hashes)]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def corpus_statistics(docs: DataFrame) -> Corpus:
    """Corpus of the column text; partial counts are merged by cell, and at most 2**DF_BITS + 3 rows reach the driver."""

    def count(batches):
        times, totals = np.zeros(1 << DF_BITS, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for _, buf, off in tx.slices(batch, "text", 1 << 20):
                words = tx.Words(tx.lower(buf), off)
                pair = (words.docs() << DF_BITS) | _cell(words.hashes())
                pair.sort()
                first = np.ones(len(pair), bool)
                first[1:] = pair[1:] != pair[:-1]
                times += np.bincount(pair[first] & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
                totals += [len(off) - 1, len(words.starts), len(buf)]
        cells = np.flatnonzero(times)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.r_[cells, N_DOCS, N_WORDS, N_BYTES]), "n": pa.array(np.r_[times[cells], totals])})

    found = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = found.toArrow()
    return Corpus(found.column("cell").to_numpy(), found.column("n").to_numpy())


def content_keys(corpus: Corpus, buf: np.ndarray, off: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two keys of each document's words, and into how many heaps documents of the first key go.

    A key is the least rank among the words that other documents have too; ranks are drawn by hash in proportion to the
    words' idf (weighted MinHash), so documents have equal keys the likelier the more rare words they share. A word that
    many documents have is cut into heaps, by its document frequency.
    """
    words = tx.Words(tx.lower(buf), off)
    h, docs = words.hashes(), words.docs()
    weight = np.where(corpus.frequency(h) > 1, corpus.idf(h), 0.0)
    keys, heaps = [], np.ones(len(off) - 1, np.int64)
    for seed in (11, 12):
        draw = ((tx.mix(h + np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
        with np.errstate(divide="ignore"):
            rank = -np.log(draw) / weight  # infinite where the weight is 0
        low = np.full(len(off) - 1, np.inf)
        filled = np.flatnonzero(words.counts)
        if len(filled):
            low[filled] = np.minimum.reduceat(rank, words.first[:-1][filled])
        if seed == 11:
            least = np.flatnonzero(np.isfinite(rank) & (rank == low[docs]))
            heaps[docs[least]] = 1 + corpus.frequency(h[least]) * 4 * parts // max(1, corpus.docs)
            heaps[np.isinf(low)] = 4 * parts
        keys.append(low)
    return keys[0], keys[1], heaps


class ShardIndex:
    """BM25 postings of one shard, weighted by the statistics of the whole corpus."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, corpus: Corpus, query_terms: int = 12):
        words = tx.Words(tx.lower(buf), off)
        n = len(off) - 1
        terms, _, which = tx.distinct(words.hashes())
        pair, tf = np.unique(words.docs() * max(1, len(terms)) + which, return_counts=True)
        doc, term = pair // max(1, len(terms)), pair % max(1, len(terms))
        here = np.bincount(term, minlength=len(terms))
        weight = corpus.idf(terms)[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words.counts[doc] / corpus.mean))
        # a query is a document's terms of most weight among those that any other document of the shard has
        shared = here[term] > 1
        doc_q, term_q = doc[shared], term[shared]
        # heaviest first, by the bits of numbers that are never negative; pairs come by document and term, which decides ties
        order = tx.hash_order(~weight[shared].view(np.uint64))
        order = order[tx.stable_order(doc_q[order], n)]
        self.query, self.query_at = term_q[order], np.searchsorted(doc_q[order], np.arange(n + 1))
        order = tx.stable_order(term, len(terms))
        self.doc, self.weight, self.at = doc[order], weight[order], np.r_[0, np.cumsum(here)]
        self.n, self.query_terms = n, query_terms

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first; ties go to the smaller index."""
        lo, hi = self.query_at[seed], self.query_at[seed + 1]
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[lo : min(hi, lo + self.query_terms)]]
        if not spans:
            return np.zeros(0, np.int64)
        found = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found[~unused] = 0
        hits = np.flatnonzero(found)
        return hits[np.argsort(-found[hits], kind="stable")]


def pack_shard(index: ShardIndex, tokens: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill windows without gaps.

    A seed fills windows from its start. What room its last piece leaves goes to its unused neighbours, best first, then
    to the next unused document; one that is cut there is the next seed.
    """
    out, unused, done = [], np.ones(len(tokens), bool), np.zeros(len(tokens), np.int64)
    sequence, fill, next_free, seed = 0, 0, 0, -1

    def place(d):
        nonlocal sequence, fill
        unused[d] = False
        size = min(int(tokens[d] - done[d]), window - fill)
        out.append((d, int(done[d]), size, sequence, fill))
        done[d] += size
        fill += size
        if fill == window:
            sequence, fill = sequence + 1, 0
        return done[d] < tokens[d]

    while True:
        if seed < 0:
            while next_free < len(tokens) and not unused[next_free]:
                next_free += 1
            if next_free == len(tokens):
                return out
            seed = next_free
        while place(seed):
            pass
        cut = -1
        if fill:
            for d in index.neighbours(seed, unused).tolist():
                if place(d):
                    cut = d
                if not fill:
                    break
        seed = cut


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, query_terms: int = 12, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer file, then `end_id`. Each id lies in one piece; a sequence holds pieces from
    offset 0 without gaps, `window` ids at most, and only the last one of a shard can hold fewer. A seed's neighbours
    are ranked by BM25 over its `query_terms` terms of most weight; frequencies and lengths are those of all documents.

    Documents are dealt to shards by content: two keys by weighted MinHash bring documents that share rare words
    together, at any number of documents. Documents of a frequent key are cut into heaps by a hash, so a hot source or a
    group of copies spreads evenly. Each shard has its own index; a text travels once. The tokenizer file has to be at
    that path on all executors. Sequence ids and the dealing depend on the number of shuffle partitions.

    Null text is empty: one piece with end_id alone. A null id is kept. Rows of equal id are packed one by one (sorted
    by text). An empty table gives an empty table; other columns are not read. A document longer than a shard is a
    shard of its own.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    corpus = corpus_statistics(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus.bytes // PART_BYTES), 1)
    shared = spark.sparkContext.broadcast(corpus)  # bounded: 2**DF_BITS numbers

    def route(batches):
        for batch in batches:
            for rows, buf, off in tx.slices(batch, "text", 1 << 20):
                one, two, heaps = content_keys(shared.value, buf, off, parts)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "text": rows.column("text"), "one": pa.array(one), "two": pa.array(two), "heaps": pa.array(heaps)})

    dealt = docs.mapInArrow(route, "doc_id long, text string, one double, two double, heaps long")
    # the text's length deals out rows of one id (such as null) too
    heap = F.pmod(F.xxhash64("doc_id", F.length("text")), F.col("heaps"))
    dealt = dealt.repartition(parts, F.xxhash64("one", heap)).sortWithinPartitions("one", "two", "doc_id", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, base = shared_encoder(tokenizer), TaskContext.get().partitionId() << 40
        for rows in tx.gathered(batches, "text", SHARD_BYTES):
            buf, off = tx.flat(rows.column("text"))
            parts = [encoder.encode(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in tx.chunks(off, 1 << 19)]
            tokens = np.concatenate([np.diff(o) for _, o in parts]) + 1
            end = np.cumsum(tokens)
            ids, own = np.full(end[-1], end_id, "<u4"), np.ones(end[-1], bool)
            own[end - 1] = False
            ids[own] = np.concatenate([i for i, _ in parts])
            pieces = pack_shard(ShardIndex(buf, off, shared.value, query_terms), tokens, window)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
            first = (end - tokens)[doc] + start
            blobs = [ids[a:b].tobytes() for a, b in zip(first.tolist(), (first + length).tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids": pa.array(blobs, pa.binary()),
                "doc_tokens": pa.array(tokens[doc]), "sequence_id": pa.array(base + sequence), "offset": pa.array(offset)})
            base += int(sequence.max()) + 1

    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
