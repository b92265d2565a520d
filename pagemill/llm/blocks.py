"""Packed document blocks and the repeated-key prefilter that substring operators share.

`pack` turns rows into blocks of bounded size (compressed Arrow, all columns inside, so no name can clash) and writes
them to the shared checkpoint folder: block numbers stay fixed even if executors are lost. `repeated_keys` is a
count-min sketch in sparse form: each block contributes the sketch cells it touches, cut into cell ranges; one task per
range adds the partial sketches up and tells each block which of its cells reach a count of two. A cell's count is never
below that of any key in it, so no repeated key is lost. The sketch is as wide as the input demands and no part of it is
broadcast or sent to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textops as tx
from .session import shared_checkpoint

BLOCK_BYTES = 3 << 20
RANGE_KEYS = 1 << 21


def squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(memoryview(data).cast("B") if not isinstance(data, bytes) else data)


def expand(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data), max_output_size=1 << 31)


def put_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed byte planes, which suits sorted differences."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.copy() if len(a) else np.zeros((a.itemsize, 0), np.uint8)
        out += [np.array([len(a), a.itemsize], np.int64).tobytes(), a.dtype.str.encode().ljust(8), planes.tobytes()]
    return squeeze(b"".join(out))


def get_arrays(blob) -> list[np.ndarray]:
    data, at, out = expand(blob), 0, []
    while at < len(data):
        n, width = np.frombuffer(data, np.int64, 2, at)
        kind = np.dtype(data[at + 16 : at + 24].strip().decode())
        planes = np.frombuffer(data, np.uint8, n * width, at + 24).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 24 + int(n * width)
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def table_of(payload) -> pa.Table:
    return pa.ipc.open_stream(expand(payload)).read_all()


def payload_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return squeeze(sink.getvalue().to_pybytes())


def pack(docs: DataFrame, text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of about `limit` text bytes: block, n_bytes, n_words, payload."""

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, part, off in tx.slices(batch, text, limit):
                words = len(tx.Words(part, off).starts)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([(task << 32) | k], pa.int64()), "n_bytes": pa.array([len(part)], pa.int64()), "n_words": pa.array([words], pa.int64()),
                    "payload": pa.array([payload_of(pa.Table.from_batches([rows]))], pa.binary())})
                k += 1

    return shared_checkpoint(docs.mapInArrow(run, "block long, n_bytes long, n_words long, payload binary"))


def _cells(keys: np.ndarray, group: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a block, and whether two keys (of different groups, if given) meet in one here."""
    cells = keys >> np.uint64(64 - bits)
    if group is not None and len(cells):
        order = np.lexsort((group, cells))
        cells, g = cells[order], group[order]
        cells = cells[np.r_[True, (cells[1:] != cells[:-1]) | (g[1:] != g[:-1])]]
    cells, counts = np.unique(cells, return_counts=True)
    return cells, counts > 1


def repeated_keys(packed: DataFrame, keys_of, n_keys: int, cells_per_key: int = 64) -> tuple[DataFrame, int]:
    """(block, masks: one bit per distinct cell of the block, by range) and the width of the sketch in bits.

    keys_of(table) gives a block's 64-bit keys and, or None, a group for each: keys then count once per group.
    """
    bits = min(60, max(8, math.ceil(math.log2(max(1, n_keys) * cells_per_key))))
    range_bits = min(bits, max(2, math.ceil(math.log2(max(1, n_keys / RANGE_KEYS)))))

    def partial(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                cells, more = _cells(*keys_of(table_of(payload.as_buffer())), bits)
                cuts = np.searchsorted(cells >> np.uint64(bits - range_bits), np.arange((1 << range_bits) + 1, dtype=np.uint64))
                for r in np.flatnonzero(np.diff(cuts)):
                    lo, hi = cuts[r], cuts[r + 1]
                    blob = put_arrays(gaps(cells[lo:hi] - (np.uint64(r) << np.uint64(bits - range_bits))), np.packbits(more[lo:hi]))
                    yield pa.RecordBatch.from_pydict({"r": pa.array([int(r)], pa.int32()), "block": pa.array([block], pa.int64()), "cells": pa.array([blob], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [get_arrays(x) for x in pdf["cells"]]
        lists = [np.cumsum(p[0]) for p in parts]
        every = np.concatenate(lists + [c[np.unpackbits(p[1], count=len(c)).astype(bool)] for c, p in zip(lists, parts)])
        every.sort()
        often = np.unique(every[1:][every[1:] == every[:-1]])
        masks = []
        for cells in lists:
            at = np.searchsorted(often, cells)
            hit = at < len(often)
            hit[hit] = often[at[hit]] == cells[hit]
            masks.append(squeeze(np.packbits(hit).tobytes()))
        return pd.DataFrame({"block": pdf["block"], "r": pdf["r"], "n": [len(c) for c in lists], "mask": masks})

    sketch = packed.select("block", "payload").mapInArrow(partial, "r int, block long, cells binary")
    said = sketch.groupBy("r").applyInPandas(merge, "block long, r int, n int, mask binary")
    return said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("r", "n", "mask"))).alias("masks")), bits


def is_repeated(keys: np.ndarray, group: np.ndarray | None, bits: int, masks) -> np.ndarray:
    """For each key of a block, whether its cell is repeated, from the block's row of `repeated_keys`."""
    cells, _ = _cells(keys, None, bits)
    flags = [np.unpackbits(np.frombuffer(expand(m["mask"]), np.uint8), count=m["n"]) for m in masks or []]
    flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
    assert len(flags) == len(cells), "a block's cells changed between passes"
    return flags[np.searchsorted(cells, keys >> np.uint64(64 - bits))] if len(keys) else np.zeros(0, bool)


def with_blocks(packed: DataFrame, other: DataFrame) -> DataFrame:
    """Each block beside its row of `other` (one row a block at most)."""
    return packed.select("block", "payload").join(other, "block", "left")
