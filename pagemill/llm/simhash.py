"""SimHash fingerprints and their links within a Hamming radius, by a Gray-ordered hierarchical index."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import textops as tx
from .components import components, join_hot
from .session import prepare, shared_checkpoint

LEAF, FAN, PAIRS = 16, 8, 1 << 16
BLOCK_SHINGLES, TRIES = 1 << 20, 32
HEAVY, PART_KEYS = 16, 1 << 20


def fingerprint_docs(docs: DataFrame, shingle: int = 4, lanes: int = 1, text: str = "text", doc_id: str = "doc_id", jaccard: float | None = None) -> DataFrame:
    """(doc_id, fp0, ...): 64 majority bits a lane over XXH64 (seed 42, 43, ...) of the lower-cased word shingles.

    With `jaccard` also class, a hash of the set of shingles, and keys, its prefix for that index.

    Fewer words than a shingle: the whole sequence is the one shingle. No word, or null text: zero.
    """
    heavy = None if jaccard is None else docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, shingle, text, doc_id))

    def run(batches):
        for batch in batches:
            for rows, buf, off in tx.slices(batch, text, 1 << 20):
                out = fingerprints(buf, off, shingle, lanes)
                columns = {"doc_id": rows.column(doc_id).cast(pa.int64())}
                columns |= {f"fp{i}": pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in range(lanes)}
                if heavy is not None:
                    h, at = shingle_sets(buf, off, shingle)
                    keys = prefixes(h, at, heavy.value, jaccard)
                    ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
                    columns["class"] = pa.array(set_hashes(h, at).view(np.int64))
                    columns["keys"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, " + ", ".join(f"fp{i} long" for i in range(lanes)) + ", class long, keys array<long>" * (jaccard is not None))


def fingerprints(buf: np.ndarray, off: np.ndarray, shingle: int, lanes: int = 1) -> np.ndarray:
    buf = tx.LOWER[buf]
    words = tx.Words(buf, off)
    joined, joined_off = tx.join_words(buf, words, np.ones(len(words.starts), bool))
    spans = tx.Words(joined, joined_off)
    data, hash64, out = joined.tobytes(), xxhash.xxh64_intdigest, np.zeros((len(off) - 1, lanes), np.uint64)
    starts, ends = spans.starts.tolist(), spans.ends.tolist()
    for d, (a, b) in enumerate(zip(spans.first[:-1].tolist(), spans.first[1:].tolist())):
        if a == b:
            continue
        n = max(1, b - a - shingle + 1)
        last = ends[a + shingle - 1 : b] if b - a >= shingle else [ends[b - 1]]
        pieces = [data[s:e] for s, e in zip(starts[a : a + n], last)]
        for lane in range(lanes):
            h = np.fromiter([hash64(x, 42 + lane) for x in pieces], np.uint64, n)
            set_bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[d, lane] = np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0]
    return out


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes, and their offsets; shingles as in fingerprint_docs."""
    buf = tx.LOWER[buf]
    words = tx.Words(buf, off)
    joined, joined_off = tx.join_words(buf, words, np.ones(len(words.starts), bool))
    spans = tx.Words(joined, joined_off)
    size = np.where(spans.counts >= shingle, spans.counts - shingle + 1, np.minimum(spans.counts, 1))
    doc = np.repeat(np.arange(len(size)), size)
    start = spans.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    h = tx.span_hash(joined, spans.starts[start], spans.ends[np.minimum(start + shingle, spans.first[doc + 1]) - 1])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(size)))].astype(np.int64)


def set_hashes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set of shingle_sets."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(tx.mix(h + np.uint64(7)), dtype=np.uint64, out=total[1:])
    return tx.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64))


def similar_labels(codes: np.ndarray, sets: list[np.ndarray], radius: int, jaccard: float) -> np.ndarray:
    """Smallest member of each one's component over the pairs within the radius whose sets have that Jaccard index.

    A pair is only compared while nothing else joins it, the nearest first.
    """
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    for x in range(1, len(sets)):
        d = distance(codes[:x], codes[x])
        open_ = np.flatnonzero((d <= radius) & (np.minimum(size[:x], size[x]) >= jaccard * np.maximum(size[:x], size[x]) - 1e-9))
        open_ = open_[np.argsort(d[open_], kind="stable")]
        while len(open_):
            some, open_ = open_[:TRIES], open_[TRIES:]
            both = np.array([_common(sets[x], sets[y]) for y in some.tolist()])
            for y in some[both >= jaccard * (size[x] + size[some] - both) - 1e-9]:
                low, high = sorted((label[x], label[y]))
                label[: x + 1][label[: x + 1] == high] = low
            open_ = open_[label[open_] != label[x]]
    return label


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def gray_order(codes: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """Rows of codes by bucket, then in the order of the reflected Gray sequence, where neighbours differ in few bits."""
    ranks, odd = [], np.zeros(len(codes), np.uint64)
    for x in codes.T:
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(s))
        ranks.append(x ^ (np.uint64(0) - odd))
        odd = ranks[-1] & np.uint64(1)
    return np.lexsort(ranks[::-1] + ([] if bucket is None else [bucket]))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class GrayIndex:
    """Codes sorted by bucket and Gray rank, under nodes of LEAF codes, then of FAN nodes each; one top node a bucket.

    A node holds the bit pattern that all codes below it share (`ands` where not `loose`).
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.order = gray_order(codes, bucket)
        self.codes, bucket = codes[self.order], bucket[self.order]
        n = len(bucket)
        opens = np.r_[True, bucket[1:] != bucket[:-1]][:n]
        place = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        cuts, self.children = np.flatnonzero((np.arange(n) - first[place]) % LEAF == 0), []
        self.cuts = [cuts]
        while len(self.cuts[-1]) > len(first):
            own = place[self.cuts[-1]]
            up = np.flatnonzero((np.arange(len(own)) - np.searchsorted(own, own)) % FAN == 0)
            self.children.append(np.r_[up, len(own)])
            self.cuts.append(self.cuts[-1][up])
        self.ends = [np.r_[c[1:], n] for c in self.cuts]
        self.ands = [np.bitwise_and.reduceat(self.codes, c) if n else self.codes for c in self.cuts]
        self.loose = [a ^ np.bitwise_or.reduceat(self.codes, c) if n else a for a, c in zip(self.ands, self.cuts)]

    def members(self, level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of nodes begin and end: nodes of the level below, or codes."""
        return (self.children[level - 1][x], self.children[level - 1][x + 1]) if level else (self.cuts[0][x], self.ends[0][x])


def _products(begin_a, end_a, begin_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """All (p, q) with p in begin_a..end_a and q in begin_b..end_b, for each row."""
    wide = end_b - begin_b
    count = (end_a - begin_a) * wide
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wide = np.repeat(wide, count)
    return np.repeat(begin_a, count) + at // wide, np.repeat(begin_b, count) + at % wide


def radius_links(codes: np.ndarray, radius: int, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect exactly what all pairs of codes of one bucket within the radius connect.

    Every pair of a bucket is decided by the Gray index. The shared bits in which two nodes differ are a lower bound for
    all pairs below: over the radius, the whole pair of groups goes. If even all unshared bits together stay within the
    radius, everything below links, and a spanning set of pairs does. Groups that are one component already need no
    further look. Pairs of nodes are taken depth-first, in arrays of bounded size.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = GrayIndex(codes, np.zeros(n, np.int64) if bucket is None else bucket)
    f, left, right, label, fresh = index.codes, [], [], np.arange(n), 0

    def link(p, q):
        nonlocal label, fresh
        apart = label[p] != label[q]
        left.append(p[apart])
        right.append(q[apart])
        fresh += len(left[-1])
        if fresh > max(4096, n // 4):  # labels only spare work, so they may lag behind
            label, fresh = tx.forest(n, np.concatenate(left), np.concatenate(right)), 0

    top = len(index.cuts) - 1
    own = np.arange(len(index.cuts[top]))
    todo = [(top, own[lo : lo + PAIRS], own[lo : lo + PAIRS]) for lo in range(0, len(own), PAIRS)]
    while todo:
        level, a, b = todo.pop()
        differ, free = index.ands[level][a] ^ index.ands[level][b], index.loose[level][a] | index.loose[level][b]
        near = np.bitwise_count(differ & ~free).sum(1, dtype=np.int64) <= radius
        whole = near & (np.bitwise_count(differ | free).sum(1, dtype=np.int64) <= radius)
        at, end = index.cuts[level], index.ends[level]
        for p, q in ((a[whole], b[whole]), (b[whole], a[whole])):
            link(*_products(at[p], at[p] + 1, at[q], end[q]))
        a, b = a[near & ~whole], b[near & ~whole]
        if len(a) > FAN:  # not worth the look for few
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            joined = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~joined], b[~joined]
        (from_a, to_a), (from_b, to_b) = index.members(level, a), index.members(level, b)
        total = np.cumsum((to_a - from_a) * (to_b - from_b))
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
            p, q = _products(from_a[lo:hi], to_a[lo:hi], from_b[lo:hi], to_b[lo:hi])
            lo = hi
            if level:
                todo.append((level - 1, p[p <= q], q[p <= q]))
            else:
                p, q = p[p < q], q[p < q]
                close = distance(f[p], f[q]) <= radius
                link(p[close], q[close])
    left, right = (index.order[np.concatenate(s)] if s else np.zeros(0, np.int64) for s in (left, right))
    return left, right


def exact_tables(radius: int, n: int = 0) -> list[tuple[int, ...]]:
    """Masks for 64 bits: cut into radius + m runs, two codes within the radius agree in m runs at least.

    m is 2 at first; it grows with the number n of codes, so that about 32 strangers at most share a table's bits.
    """
    m = next((m for m in (2, 3) if n >> (64 * m // (radius + m)) <= 32), 4)
    edges = np.linspace(0, 64, radius + m + 1).astype(int)
    runs = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:])]
    return [(sum(own),) for own in combinations(runs, m)]


def sampled_tables(lanes: int, n: int, apart: float, miss: float) -> list[tuple[int, ...]]:
    """Masks of bits drawn at random, as many as make codes that differ in a share `apart` of their bits miss each other
    in all tables with probability `miss`; a mask has about log2(n) - 3 bits, so that strangers rarely meet."""
    bits = max(8, math.ceil(math.log2(max(2, n))) - 3)
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - apart) ** bits)))
    draw, out = np.random.Generator(np.random.PCG64(7)), []
    for _ in range(tables):
        chosen = draw.permutation(64 * lanes)[:bits]
        out.append(tuple(sum(1 << int(b % 64) for b in chosen if b // 64 == lane) for lane in range(lanes)))
    return out


def table_keys(tables: list[tuple[int, ...]]):
    """An array column: for each table a hash of the bits that its mask shows."""
    signed = lambda m: int(np.uint64(m).view(np.int64))
    return F.array(*[F.xxhash64(F.lit(t), *[F.col(f"fp{i}").bitwiseAND(F.lit(signed(m))) for i, m in enumerate(masks)]) for t, masks in enumerate(tables)])


def radius_components(codes: DataFrame, radius: int, keys, parts: int = 1) -> DataFrame:
    """(node, component) of distinct (fp0, ..., node) rows, for those that link: codes at `radius` bits or fewer.

    Codes meet if they have a key in common. A task holds many such buckets and hands on one link a member
    (its local root), never all pairs.
    """
    prints = [c for c in codes.columns if c.startswith("fp")]
    keyed = codes.select(*prints, "node", F.explode(keys).alias("key"))
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)

    def link(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        node, key = (table.column(c).to_numpy() for c in ("node", "key"))
        fp = np.stack([table.column(c).to_numpy().view(np.uint64) for c in prints], 1)
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        order = order[np.r_[again, False] | np.r_[False, again]]  # a key that one code has meets nothing
        p, q = radius_links(fp[order], radius, key[order])
        p, q = order[p], order[q]
        members, at = np.unique(node, return_inverse=True)
        label = tx.forest(len(members), at[p], at[q])
        child = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_pydict({"a": pa.array(members[child]), "b": pa.array(members[label[child]])})

    return components(keyed.repartition(parts, "key").mapInArrow(link, "a long, b long"))


def heavy_shingles(docs: DataFrame, shingle: int, text: str, doc_id: str, rows: int = 20_000) -> np.ndarray:
    """Hashes of shingles that many documents hold, as a sample of documents shows, the rarest of them first."""
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.select(text).where(F.pmod(F.xxhash64(F.col(doc_id), F.length(text)), F.lit(1 << 40)) < share * (1 << 40))

    def run(batches):
        for batch in batches:
            for _, buf, off in tx.slices(batch, text, 1 << 20):
                h, times = np.unique(shingle_sets(buf, off, shingle)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(times)})

    often = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(f"n >= {HEAVY}")
    found = often.orderBy(F.desc("n"), "h").limit(1 << 17).toArrow()
    return found.column("h").to_numpy().view(np.uint64)[::-1].copy()


def prefixes(h: np.ndarray, off: np.ndarray, heavy: np.ndarray, jaccard: float) -> list[np.ndarray]:
    """The first n - ceil(jaccard * n) + 1 of each set of n shingles, in one order of all shingles: the heavy ones last.

    Two sets of that Jaccard index share at least ceil(jaccard * n) shingles, n being the larger set's size; hence
    whatever the order is, they share one in these prefixes. An empty set gets one key, so that empty sets meet.
    """
    by_hash = np.argsort(heavy)
    at = np.minimum(np.searchsorted(heavy, h, sorter=by_hash), max(0, len(heavy) - 1))
    weight = np.zeros(len(h), np.int64)
    if len(heavy):
        place = by_hash[at]
        weight = np.where(heavy[place] == h, place + 1, 0)
    size = np.diff(off)
    h = h[np.lexsort((h, weight, np.repeat(np.arange(len(size)), size)))]
    first = size - np.ceil(jaccard * size - 1e-9).astype(np.int64) + 1
    return [h[a : a + n] if m else np.zeros(1, np.uint64) for a, n, m in zip(off[:-1].tolist(), first.tolist(), size.tolist())]


def confirmed(docs: DataFrame, nodes: DataFrame, found: DataFrame, shingle: int, radius: int, jaccard: float, text: str, doc_id: str) -> DataFrame:
    """As radius_components, after the candidate components `found` are cut to pairs of that exact Jaccard index.

    Only the first document of a class sends its shingles, to its candidate component. Components of more than
    BLOCK_SHINGLES shingles are cut into blocks, and every two blocks meet. A task hands on one link a member.
    """
    prints = [c for c in nodes.columns if c.startswith("fp")]
    several = found.join(nodes, "node")
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(tx.NULL_ID)).alias("node"), F.col(text).alias("text")).join(several, "node")
    schema = "component long, node long, " + ", ".join(f"{p} long" for p in prints) + ", n long, shingles binary"

    def read(batches):
        for batch in batches:
            for rows, buf, off in tx.slices(batch, "text", 1 << 20):
                h, at = shingle_sets(buf, off, shingle)
                # rows of one id may differ in their texts; each goes with its own fingerprint
                same = np.flatnonzero(set_hashes(h, at).view(np.int64) == rows.column("class").to_numpy())
                kept = rows.take(pa.array(same))
                yield pa.RecordBatch.from_pydict({c: kept.column(c) for c in ("component", "node", *prints)} | {
                    "n": pa.array(np.diff(at)[same]), "shingles": pa.array([h[at[i] : at[i + 1]].tobytes() for i in same], pa.binary())})

    sets = shared_checkpoint(own.select("component", "node", *prints, "class", "text").mapInArrow(read, schema))
    before = F.sum("n").over(Window.partitionBy("component").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, -1))
    block = sets.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_SHINGLES))
    block = block.withColumn("last", F.max("block").over(Window.partitionBy("component")))
    others = F.when(F.col("last") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), "last"), lambda x: x != F.col("block")))
    pairs = block.withColumn("other", F.explode(others)).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", *prints, "shingles")
    pairs = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def compare(batches):
        last, held = None, []

        def links():
            codes = np.array([h[1] for h in held], np.int64).view(np.uint64)
            label = similar_labels(codes, [np.frombuffer(h[2], np.uint64) for h in held], radius, jaccard)
            return [(h[0], held[k][0]) for h, k in zip(held, label) if h[0] != held[k][0]]

        for batch in batches:
            out = []
            data = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for component, i, j, node, *code, shingles in zip(*data):
                if (component, i, j) != last:
                    out += links() if len(held) > 1 else []
                    last, held = (component, i, j), []
                held.append((node, code, shingles))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
        out = links() if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return components(pairs.mapInArrow(compare, "a long, b long"))


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, lanes: int = 1, miss: float = 0.02, text: str = "text", doc_id: str = "doc_id", jaccard: float | None = None) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits a lane), component_id (smallest id reachable over links).

    Fingerprints at `radius` bits or fewer link. With one lane of 64 bits and a radius up to 8 no link is lost. Beyond,
    tables sample bits: two fingerprints that differ in as many bits as the radius fail to meet with probability `miss`,
    before other members of their group are counted.

    With `jaccard`, a link also needs that exact Jaccard index of the two documents' sets of shingles, and only documents
    of equal fingerprint and equal set are one node. Fingerprints then meet by shared shingles in the sets' prefixes,
    which finds every such link at any number of documents; `miss` is not used.

    Equal fingerprints are one node; hence any number of copies costs one row in the index. Documents without words
    have fingerprint zero and link like others. A null id sorts before all ids and stands for its component as null;
    rows of equal id are one document each. An empty table gives an empty table; other columns are not read.
    """
    prepare(docs.sparkSession)
    prints = [f"fp{i}" for i in range(lanes)]
    by = prints if jaccard is None else [*prints, "class"]
    rows = shared_checkpoint(fingerprint_docs(docs, shingle, lanes, text, doc_id, jaccard))
    null = F.lit(tx.NULL_ID)
    node = F.min(F.coalesce("doc_id", null)).alias("node")
    if jaccard is None:
        nodes = shared_checkpoint(rows.groupBy(*prints).agg(node, F.count("*").alias("copies")))
        n, n_rows, most = nodes.agg(F.count("*"), F.sum("copies"), F.max("copies")).first()
        tables = exact_tables(radius, n) if lanes == 1 and radius <= 8 else sampled_tables(lanes, n, radius / (64 * lanes), miss)
        found = radius_components(nodes, radius, table_keys(tables), -(-n * len(tables) // PART_KEYS))
    else:  # equal sets have equal keys
        keyed = shared_checkpoint(rows.groupBy(*by).agg(node, F.count("*").alias("copies"), F.first("keys").alias("keys")))
        nodes = keyed.drop("keys")
        n_keys, n_rows, most = (x or 0 for x in keyed.agg(F.sum(F.size("keys")), F.sum("copies"), F.max("copies")).first())
        found = radius_components(keyed, radius, F.col("keys"), -(-n_keys // PART_KEYS))
        found = confirmed(docs, nodes, found, shingle, radius, jaccard, text, doc_id)
    # two fingerprints may share a smallest id only if that id repeats; then they are one node
    nodes = nodes.join(found, "node", "left").select(*by, "copies", F.nullif(F.coalesce("component", "node"), null).alias("component_id"))
    text_of = F.concat(*[F.lower(F.lpad(F.hex(p), 16, "0")) for p in prints])
    return join_hot(rows, nodes, by, "copies", n_rows or 0, most or 0).select("doc_id", text_of.alias("fingerprint"), "component_id")
