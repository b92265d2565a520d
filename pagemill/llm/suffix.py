"""Removal of repeated byte strings by sharded suffix arrays.

A shard holds content, not documents: every string of `length` bytes has a smallest k-gram hash, and all occurrences of
the string have the same one, so the runs of strings with one smallest k-gram (here: stretches) are dealt out by it.
Equal strings thus meet in one shard, and the work is linear in the input. Each shard has its suffix array and common
prefixes; a part too large for one array is split into several, which are merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textops as tx
from .blocks import expand, gaps, get_arrays, is_repeated, pack, put_arrays, repeated_keys, squeeze, table_of, with_blocks
from .session import prepare

PART_BYTES = 8 << 20  # of candidate strings, as blocks send them to one task
SHARE_BITS = 3  # a task takes its part in so many bits of shares
SHARD_BYTES = 1 << 19  # of one suffix array; larger shares have several, merged by binary search


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(7, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64) if len(buf) else np.zeros(0, np.uint64)


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first `depth` bytes, by Larsson-Sadakane refinement.

    The first order is by eight bytes; each round sorts the groups still tied by the rank of the position that lies as
    many bytes ahead as are sorted already, and leaves all other groups alone.
    """
    n = len(buf)
    key = _words_at(buf)
    sa = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    done = 8
    while done < depth:
        step = min(done, depth - done)
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        ahead = sa[tied] + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        order = np.argsort(head[tied] * (n + 1) + second + 1)
        group, second = head[tied][order], second[order]
        sa[tied] = sa[tied][order]
        split = np.ones(len(tied), bool)
        split[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[tied] = split
        head[tied] = np.maximum.accumulate(np.where(split, tied, 0))
        rank[sa[tied]] = head[tied]
        done += step
    return sa


def common_prefixes(buf: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to `cap` bytes, of each suffix with the one before it in the suffix array.

    As in Kasai's algorithm suffixes are taken in text order with their predecessors, which keeps reads local; instead
    of carrying the previous length along, all still equal pairs compare eight bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    alive = np.flatnonzero(before >= 0)
    key = np.concatenate([_words_at(buf), np.zeros(cap + 8, np.uint64)])
    for at in range(0, cap, 8):
        a, b = key[alive + at], key[before[alive] + at]
        differ = a ^ b
        same = differ == 0
        ended = alive[~same]
        lead = 7 - np.floor(np.log2(np.maximum(differ[~same] >> np.uint64(1), 1).astype(np.float64)) + (differ[~same] > 1)).astype(np.int64) // 8
        out[ended] = at + lead
        alive = alive[same]
    out[alive] = cap
    room = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, cap), room)[sa]


def string_classes(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the class of the `length` bytes there, and the first position of each class, in sorted order."""
    sa = suffix_array(buf, length)
    new = common_prefixes(buf, sa, length) < length
    new[:1] = True
    out = np.empty(len(buf), np.int64)
    out[sa] = np.cumsum(new) - 1
    return out, sa[new]


def stretches(buf: np.ndarray, off: np.ndarray, length: int, k: int):
    """Runs of consecutive strings of one document with the same smallest k-gram hash: key, row, start, count."""
    keys, rows, starts, counts = [], [], [], []
    for lo, hi in tx.chunks(off, 1 << 20):
        part, own = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        n = len(part)
        if n < length:
            continue
        low = tx.sliding_min(tx.byte_grams(part, k), length - k + 1)
        row = np.repeat(np.arange(hi - lo), np.diff(own))[: n - length + 1]
        at = np.flatnonzero(np.arange(n - length + 1) + length <= own[row + 1])
        low, row = low[at], row[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        keys.append(tx.mix(low[first] + np.uint64(1)))  # minima crowd near zero; mixed again they spread evenly
        rows.append(row[first] + lo)
        starts.append(at[first] + off[lo])
        counts.append(np.diff(np.r_[first, len(at)]))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return join(keys, np.uint64), join(rows, np.int64), join(starts, np.int64), join(counts, np.int64)


def _gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    begin = np.cumsum(sizes) - sizes
    return buf[np.arange(sizes.sum()) + np.repeat(starts - begin, sizes)]


def dedup_bytes(docs: DataFrame, length: int = 50, k: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without `text`, plus kept (the remaining UTF-8 bytes), n_bytes, n_removed and n_spans.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Strings are
    judged on the input, overlaps count, matches never cross documents. Kept bytes may cut a character, hence binary.

    A block sends each distinct stretch once, whatever the number of its copies there, and gets a bit back for each
    string of it: whether it also starts in a document below the block's own first one.

    Null text: no bytes. A null id sorts before all others; rows of equal id do not count against each other. Texts
    shorter than `length` stay whole. An empty table gives an empty table. Input columns with a name of the result's
    are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    packed = pack(docs, text)
    n_bytes = packed.agg(F.sum("n_bytes")).first()[0] or 0
    added = [T.StructField("kept", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + added)

    def keys_of(table):
        key, row, _, _ = stretches(*tx.flat(table.column(text)), length, k)
        return key, row

    masks, bits = repeated_keys(packed, keys_of, n_bytes * 2 // (length - k + 2))
    part_bits = max(2, int(np.ceil(np.log2(max(1, n_bytes / PART_BYTES)))))

    def candidates_of(table, mask):
        """Stretches estimated repeated, sorted by key and content, and which of them are the first of their content."""
        buf, off = tx.flat(table.column(text))
        key, row, start, count = stretches(buf, off, length, k)
        keep = is_repeated(key, row, bits, mask)
        key, row, start, count = key[keep], row[keep], start[keep], count[keep]
        owner = tx.ids(table.column(doc_id))[row]
        end = start + count + (length - 1)
        one, two = (tx.span_hash(buf, start, end, lane) for lane in (0, 1))
        order = np.lexsort((owner, two, one, key))
        key, owner, start, count, one, two = (x[order] for x in (key, owner, start, count, one, two))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new = tx.equal_groups(buf, start, count + (length - 1), new)
        return buf, off, key, owner, start, count, new

    def candidates(batches):
        for batch in batches:
            for block, payload, mask in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("masks").to_pylist()):
                buf, _, key, owner, start, count, new = candidates_of(table_of(payload.as_buffer()), mask)
                key, owner, start, count = (x[new] for x in (key, owner, start, count))
                cuts = np.searchsorted(key >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)):
                    o = slice(cuts[p], cuts[p + 1])
                    share = (key[o] >> np.uint64(64 - part_bits - SHARE_BITS)) & np.uint64((1 << SHARE_BITS) - 1)
                    sizes = np.bincount(share.astype(np.int64), minlength=1 << SHARE_BITS).astype(np.int32)
                    blob = put_arrays(gaps(owner[o]), count[o].astype(np.int32), _gather(buf, start[o], count[o] + length - 1), sizes)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([int(p)], pa.int32()), "block": pa.array([block], pa.int64()), "found": pa.array([blob], pa.binary())})

    def earlier(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [get_arrays(x) for x in pdf["found"]]
        owners, counts, texts = [np.cumsum(p[0]) for p in parts], [p[1].astype(np.int64) for p in parts], [p[2] for p in parts]
        rows = [np.r_[0, np.cumsum(p[3])] for p in parts]  # where each share begins
        bytes_at = [np.r_[0, np.cumsum(c + length - 1)] for c in counts]
        late: list[list[np.ndarray]] = [[] for _ in parts]
        for share in range(1 << SHARE_BITS):
            own = [slice(r[share], r[share + 1]) for r in rows]
            held = [t[at[o.start] : at[o.stop]] for t, at, o in zip(texts, bytes_at, own)]
            count = np.concatenate([c[o] for c, o in zip(counts, own)])
            if not len(count):
                continue
            bits = earlier_strings(np.concatenate(held), np.concatenate([x[o] for x, o in zip(owners, own)]), count, length)
            for to, x in zip(late, np.split(bits, np.cumsum([c[o].sum() for c, o in zip(counts, own)])[:-1])):
                to.append(x)
        late = [np.concatenate(x) if x else np.zeros(0, bool) for x in late]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": [len(x) for x in late], "late": [squeeze(np.packbits(x).tobytes()) for x in late]})

    found = with_blocks(packed, masks).mapInArrow(candidates, "part int, block long, found binary")
    # a given number of partitions: the parts are small as bytes, but long to sort, and must not be joined into few tasks
    said = found.repartition(1 << part_bits, "part").groupBy("part").applyInPandas(earlier, "block long, part int, n int, late binary")
    gone = said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "n", "late"))).alias("late"))

    def rewrite(batches):
        for batch in batches:
            for payload, mask, late in zip(batch.column("payload"), batch.column("masks").to_pylist(), batch.column("late").to_pylist()):
                table = table_of(payload.as_buffer())
                buf, off, _, owner, start, count, new = candidates_of(table, mask)
                late = np.concatenate([np.unpackbits(np.frombuffer(expand(x["late"]), np.uint8), count=x["n"]) for x in late or []] or [np.zeros(0, np.uint8)]).astype(bool)
                group = np.cumsum(new) - 1
                own = np.cumsum(count[new]) - count[new]  # where the bits of each distinct stretch begin
                begin = np.cumsum(count) - count
                step = np.arange(count.sum()) - np.repeat(begin, count)
                gone = late[np.repeat(own[group], count) + step] | np.repeat(owner > owner[np.flatnonzero(new)][group], count)
                drop = tx.covered((np.repeat(start, count) + step)[gone], length, len(buf))
                edge = np.zeros(len(buf) + 1, bool)
                edge[off] = True
                opens = drop & (edge[:-1] | ~np.r_[False, drop[:-1]])
                per = lambda x: np.diff(np.r_[0, np.cumsum(x)][off])
                kept_off = np.r_[0, np.cumsum(~drop)][off].astype(np.int64)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(buf[~drop]))]).cast(pa.binary())
                table = table.drop_columns([text]).append_column("kept", kept)
                for name, x in (("n_bytes", np.diff(off)), ("n_removed", per(drop)), ("n_spans", per(opens))):
                    table = table.append_column(name, pa.array(x, pa.int64()))
                yield from table.to_batches()

    return with_blocks(packed, masks).join(gone, "block", "left").mapInArrow(rewrite, schema)


def earlier_strings(data: np.ndarray, owner: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """For each string of each stretch, in order: whether it also starts in a stretch of a smaller owner.

    Copies of a stretch are taken together; every string of every distinct stretch goes through a suffix array. Shards
    of SHARD_BYTES have one array each, and their sorted strings are merged by binary search.
    """
    size = count + length - 1
    begin = np.cumsum(size) - size
    one, two = (tx.span_hash(data, begin, begin + size, lane) for lane in (0, 1))
    order = np.lexsort((owner, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    new = tx.equal_groups(data, begin[order], size[order], new)
    heads = order[new]  # the copy of least owner stands for each distinct stretch
    distinct = np.empty(len(order), np.int64)
    distinct[order] = np.cumsum(new) - 1
    shard_of = (np.cumsum(size[heads]) - size[heads]) // SHARD_BYTES
    text, least, bounds = [], [], []
    for s in np.unique(shard_of):
        own = heads[shard_of == s]
        buf = _gather(data, begin[own], size[own])
        start = np.cumsum(size[own]) - size[own]
        at = np.repeat(start, count[own]) + np.arange(count[own].sum()) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        classes, sample = string_classes(buf, length)
        low = np.full(len(sample), np.iinfo(np.int64).max)
        np.minimum.at(low, classes[at], np.repeat(owner[own], count[own]))
        used = np.flatnonzero(low < np.iinfo(np.int64).max)
        first = np.empty(len(sample), np.int64)
        first[classes[at]] = at
        text.append(classes[at])
        least.append(low)
        bounds.append((buf, used, first))
    if len(bounds) > 1:  # merge: the sorted strings of each shard are searched in those of the others
        strings = [np.lib.stride_tricks.sliding_window_view(buf, length)[first[used]].copy().view(f"S{length}").ravel() for buf, used, first in bounds]
        merged = [low.copy() for low in least]
        for i, here in enumerate(strings):
            for j, there in enumerate(strings):
                if i != j:
                    spot = np.minimum(np.searchsorted(there, here), len(there) - 1)
                    same = there[spot] == here
                    mine, theirs = bounds[i][1][same], bounds[j][1][spot[same]]
                    merged[i][mine] = np.minimum(merged[i][mine], least[j][theirs])
        least = merged
    low = np.concatenate([m[c] for m, c in zip(least, text)])  # of each string of each distinct stretch
    own = np.cumsum(count[heads]) - count[heads]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return low[np.repeat(own[distinct], count) + step] < np.repeat(owner, count)
