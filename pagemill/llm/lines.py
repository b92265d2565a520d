"""Removal of repeated runs of lines by winnowing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textops as tx
from .blocks import expand, gaps, get_arrays, pack, put_arrays, squeeze, table_of, with_blocks
from .session import prepare

PART_LINES = 1 << 19


class Lines:
    """Lines of each document by "\\n"; the inked ones count, and compare without white space around them."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        breaks = np.flatnonzero(buf == 10) + 1
        self.starts = np.sort(np.concatenate([off[:-1], breaks]))
        # a document that ends in a line break has a last, empty line; keys keep it apart from the next one's first line
        doc = np.searchsorted(off[1:], breaks, "left")
        self.doc = np.sort(np.concatenate([np.arange(len(off) - 1), doc]))
        order = np.lexsort((np.concatenate([off[:-1], breaks]), np.concatenate([np.arange(len(off) - 1), doc])))
        self.starts = np.concatenate([off[:-1], breaks])[order]
        last = np.r_[self.doc[1:] != self.doc[:-1], np.ones(min(1, len(self.doc)), bool)]
        self.ends = np.where(last, off[self.doc + 1], np.r_[self.starts[1:], 0] - 1) if len(self.doc) else self.starts
        self.last = last
        self.buf, self.off = buf, off
        words = tx.Words(buf, off)
        first = np.searchsorted(words.starts, self.starts)
        stop = np.searchsorted(words.starts, self.ends)
        self.ink = np.flatnonzero(stop > first)
        self.ink_start, self.ink_end = words.starts[first[self.ink]], words.ends[stop[self.ink] - 1]
        self.ink_doc = self.doc[self.ink]
        self.first = np.searchsorted(self.ink_doc, np.arange(len(off)))
        self.n_words = (stop - first)[self.ink]

    def hashes(self, lane: int = 0) -> np.ndarray:
        return tx.span_hash(self.buf, self.ink_start, self.ink_end, lane)


def windows(lines: Lines, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first inked line, number of lines) of each window: from a line on, the fewest lines that hold `words` words, or
    `run` lines if that is less. Lines with too little after them in their document start no window."""
    at = np.arange(len(lines.ink))
    total = np.r_[0, np.cumsum(lines.n_words)]
    size = np.minimum(np.searchsorted(total, total[:-1] + words) - at, run)
    ok = at + size <= lines.first[lines.ink_doc + 1]
    return at[ok], size[ok]


def winnow(lines: Lines, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines selected as fingerprints, and for each the sizes (0: none) of the windows that selected it, by how many
    lines before it they start.

    Every window selects the line of least hash in it, the first of several, so equal windows select equal lines at
    equal places and none is without a fingerprint.
    """
    at, size = windows(lines, run, words)
    weight = tx.mix(lines.hashes() + np.uint64(1))
    best, low = at.copy(), weight[at]
    for o in range(1, run):
        inside = np.flatnonzero(size > o)
        less = inside[weight[at[inside] + o] < low[inside]]
        best[less], low[less] = at[less] + o, weight[at[less] + o]
    chosen, which = np.unique(best, return_inverse=True)
    sizes = np.zeros((len(chosen), run), np.uint8)
    sizes[which, best - at] = size
    return chosen, sizes


def reach(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many lines before and after a fingerprint its windows reach."""
    o = np.arange(sizes.shape[1])
    return ((sizes > 0) * o).max(1, initial=0), np.where(sizes > 0, sizes.astype(np.int64) - 1 - o, 0).max(1, initial=0)


def refine(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers for the distinct (group, keys)."""
    order = np.lexsort((*keys, group))
    new = np.zeros(len(order), bool)
    for k in (group, *keys):
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def later_windows(one, two, owner, start, sizes, before, after) -> np.ndarray:
    """For each fingerprint and each of its windows whether the window also starts earlier.

    Positions of equal fingerprint are joined, and matches extended line by line, first back, then forth: `before` and
    `after` hold two hashes of each neighbouring line, the nearest first. All positions whose lines so far are alike
    stay one class, so no pairs are made.
    """
    late = np.zeros(sizes.shape, bool)
    back = refine(one, two)
    for o in range(sizes.shape[1]):
        if o:
            back = refine(back, *before[o - 1])
        forth = back
        for size in range(o + 1, sizes.shape[1] + 1):
            if size > o + 1:
                forth = refine(forth, *after[size - o - 2])
            own = np.flatnonzero(sizes[:, o] == size)
            order = own[np.lexsort((start[own], owner[own], forth[own]))]
            new = np.ones(len(order), bool)
            new[1:] = forth[order][1:] != forth[order][:-1]
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            late[order, o] = (owner[order] > owner[head]) | (start[order] > start[head])
    return late


def dedup_lines(docs: DataFrame, run: int = 3, words: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without later copies of line runs, plus n_lines and n_removed (lines that hold more than white space).

    A window is, from a line on, the fewest lines that hold `words` words, or `run` lines if that is less. A line goes
    if a window that covers it also starts earlier, in a document with a smaller id or earlier in the same one. Lines
    compare without white space around them, blank lines are passed over, windows are judged on the input. Kept lines
    keep their bytes and are joined by "\\n".

    Winnowing: each window selects its line of least hash; the selected lines' positions are joined on that hash and
    matches extended both ways, as far as the windows around them reach. Lines equal in 128 bits of hash count as equal.
    A block sends a position that it holds several times with the same surroundings once, and gets a bit a window back.

    Null text stays null, with no lines. A null id sorts before all others. Rows of equal id are documents of their own;
    windows at the same line of two such rows are not earlier than each other. Documents of less than `run` lines and
    `words` words have no window and stay whole. An empty table gives an empty table. Input columns named n_lines or
    n_removed are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    packed = pack(docs, text)
    n_bytes = packed.agg(F.sum("n_bytes")).first()[0] or 0
    part_bits = max(2, int(np.ceil(np.log2(max(1, n_bytes / 64 / PART_LINES)))))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def positions_of(table):
        """Fingerprint positions sorted by line and surroundings, and which are the first of theirs in the block."""
        lines = Lines(*tx.flat(table.column(text)))
        at, sizes = winnow(lines, run, words)
        hashes = [lines.hashes(lane) for lane in (0, 1)]
        left, right = reach(sizes)
        near = lambda step, ok: [np.where(ok, h[np.clip(at + step, 0, max(0, len(h) - 1))], np.uint64(0)) if len(h) else h for h in hashes]
        before, after = [near(-j, left >= j) for j in range(1, run)], [near(j, right >= j) for j in range(1, run)]
        owner, start = tx.ids(table.column(doc_id))[lines.ink_doc[at]], at - lines.first[lines.ink_doc[at]]
        content = np.zeros(len(at), np.int64)
        for part in [[h[at] for h in hashes], list(sizes.T), *before, *after]:
            content = refine(content, *part)
        one = tx.mix(hashes[0][at] + np.uint64(2))  # spread evenly over parts
        order = np.lexsort((start, owner, content, one))
        new = np.ones(len(at), bool)
        new[1:] = content[order][1:] != content[order][:-1]
        pick = lambda x: x[order]
        return lines, pick(at), pick(sizes), (pick(one), pick(hashes[1][at]), pick(owner), pick(start)), [list(map(pick, x)) for x in before], [list(map(pick, x)) for x in after], new

    def fingerprints(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                _, _, sizes, (one, two, owner, start), before, after, new = positions_of(table_of(payload.as_buffer()))
                one, two, owner, start, sizes = (x[new] for x in (one, two, owner, start, sizes))
                (left, right), before, after = reach(sizes), [[x[new] for x in p] for p in before], [[x[new] for x in p] for p in after]
                cuts = np.searchsorted(one >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)):
                    o = slice(cuts[p], cuts[p + 1])
                    sides = [x[o][n[o] >= j] for side, n in ((before, left), (after, right)) for j, pair in enumerate(side, 1) for x in pair]
                    blob = put_arrays(gaps(one[o]), two[o], gaps(owner[o]), start[o].astype(np.int32), np.ascontiguousarray(sizes[o]).ravel(), *sides)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([int(p)], pa.int32()), "block": pa.array([block], pa.int64()), "found": pa.array([blob], pa.binary())})

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [get_arrays(x) for x in pdf["found"]]
        one, two, owner, start = (np.concatenate([np.cumsum(p[i]) if i in (0, 2) else p[i] for p in parts]) for i in range(4))
        sizes = np.concatenate([p[4] for p in parts]).reshape(-1, run)
        left, right = reach(sizes)
        sides = []
        for k in range(4 * (run - 1)):  # what was sent for the positions that reach so far, put back in place
            j = k // 2 % (run - 1) + 1
            side = np.zeros(len(one), np.uint64)
            side[(left if k < 2 * (run - 1) else right) >= j] = np.concatenate([p[5 + k] for p in parts])
            sides.append(side)
        pairs = list(zip(sides[::2], sides[1::2]))
        late = later_windows(one, two, owner, start, sizes, pairs[: run - 1], pairs[run - 1 :])
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": [len(p[0]) * run for p in parts], "late": [squeeze(np.packbits(x).tobytes()) for x in np.split(late, cuts)]})

    said = packed.select("block", "payload").mapInArrow(fingerprints, "part int, block long, found binary").groupBy("part").applyInPandas(later, "block long, part int, n int, late binary")
    said = said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "n", "late"))).alias("late"))

    def rewrite(batches):
        for batch in batches:
            for payload, late in zip(batch.column("payload"), batch.column("late").to_pylist()):
                table = table_of(payload.as_buffer())
                lines, at, sizes, (_, _, owner, start), _, _, new = positions_of(table)
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                late = np.concatenate([np.unpackbits(np.frombuffer(expand(x["late"]), np.uint8), count=x["n"]) for x in late or []] or [np.zeros(0, np.uint8)])
                gone = late.astype(bool).reshape(-1, run)[np.cumsum(new) - 1] | ((owner > owner[head]) | (start > start[head]))[:, None]
                row, o = np.nonzero(gone & (sizes > 0))
                drop = tx.covered(at[row] - o, sizes[row, o], len(lines.ink))
                column = drop_lines(lines, drop)
                column = pa.compute.if_else(pa.compute.is_null(table.column(text)), pa.scalar(None, pa.string()), column)
                removed = np.diff(np.r_[0, np.cumsum(drop)][lines.first])
                table = table.set_column(table.column_names.index(text), text, column)
                table = table.append_column("n_lines", pa.array(np.diff(lines.first), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
                yield from table.to_batches()

    return with_blocks(packed, said).mapInArrow(rewrite, schema)


def drop_lines(lines: Lines, drop: np.ndarray) -> pa.Array:
    """Each document's text without the inked lines marked in `drop`, the others joined by line breaks."""
    n, n_docs = len(lines.buf), len(lines.off) - 1
    keep_line = np.ones(len(lines.starts), bool)
    keep_line[lines.ink[drop]] = False
    gone = np.zeros(n + 1, np.int64)
    dead = ~keep_line
    np.add.at(gone, lines.starts[dead], 1)
    np.add.at(gone, np.minimum(lines.ends[dead] + ~lines.last[dead], n), -1)
    gone = np.cumsum(gone[:n]) > 0
    if dead.any():  # the break after a document's last kept line goes if only dropped lines follow
        final = np.full(n_docs, -1)
        np.maximum.at(final, lines.doc[keep_line], np.flatnonzero(keep_line))
        final = final[final >= 0]
        final = final[~lines.last[final]]
        gone[lines.ends[final]] = True
    off = np.r_[0, np.cumsum(~gone)][lines.off].astype(np.int64)
    return pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(lines.buf[~gone]))).cast(pa.string())
