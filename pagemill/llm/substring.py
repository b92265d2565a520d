"""Exact removal of repeated word windows, behind a count-min prefilter."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textops as tx
from .blocks import expand, gaps, get_arrays, is_repeated, pack, put_arrays, repeated_keys, squeeze, table_of, with_blocks
from .session import prepare

GROUP_KEYS = 1 << 20


def dedup_substrings(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with every word removed that a repeated window covers, plus n_words and n_removed.

    A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+` of one document. A word goes if a window that covers
    it has a word sequence that also starts earlier: in a document with a smaller id, or earlier in the same one.
    Windows are judged on the input. The text becomes the kept words joined by one space.

    Pass 1 merges the blocks' sketches of window hashes, pass 2 groups the windows estimated repeated by 128 bits of
    hash, pass 3 rewrites the texts. A block sends each of its windows once, however often it occurs there, and gets one
    bit back: whether the window also starts earlier in another block.

    Null text has no words and stays null. A null id sorts before all others. Rows of equal id are documents of their
    own; windows at the same start of two such rows are not earlier than each other. Fewer words than a window: kept
    whole. An empty table gives an empty table. Input columns named n_words or n_removed are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    packed = pack(docs, text)
    n_windows = packed.agg(F.sum("n_words")).first()[0] or 0
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def windows_of(table):
        words = tx.Words(*tx.flat(table.column(text)))
        at = words.windows(window)
        return words, at

    def keys_of(table):
        words, at = windows_of(table)
        return tx.gram_hash(words.hashes(), window)[at], None

    masks, bits = repeated_keys(packed, keys_of, n_windows)
    group_bits = max(2, int(np.ceil(np.log2(max(1, n_windows / 3 / GROUP_KEYS)))))

    def candidates_of(table, mask):
        """Windows estimated repeated, sorted by hash and start: word indices, (hashes, owner, start), distinct heads."""
        words, at = windows_of(table)
        key = tx.gram_hash(words.hashes(), window)[at]
        keep = is_repeated(key, None, bits, mask)
        key, at = key[keep], at[keep]
        second = tx.gram_hash(words.hashes(1), window, 1)[at] if len(at) else key
        rows = words.docs()[at]
        owner, start = tx.ids(table.column(doc_id))[rows], at - words.first[rows]
        order = np.lexsort((start, owner, second, key))
        key, second, owner, start, at = key[order], second[order], owner[order], start[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
        return words, at, (key, second, owner, start), new

    def candidates(batches):
        for batch in batches:
            for block, payload, mask in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("masks").to_pylist()):
                _, _, found, new = candidates_of(table_of(payload.as_buffer()), mask)
                key, second, owner, start = (x[new] for x in found)
                cuts = np.searchsorted(key >> np.uint64(64 - group_bits), np.arange((1 << group_bits) + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)):
                    o = slice(cuts[p], cuts[p + 1])
                    blob = put_arrays(gaps(key[o]), second[o], gaps(owner[o]), gaps(start[o]).astype(np.int32))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([int(p)], pa.int32()), "block": pa.array([block], pa.int64()), "found": pa.array([blob], pa.binary())})

    def earliest(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [get_arrays(x) for x in pdf["found"]]
        key, second, owner, start = (np.concatenate([p[i] if i == 1 else np.cumsum(p[i]) for p in parts]) for i in range(4))
        order = np.lexsort((start, owner, second, key))
        k, s, o, b = key[order], second[order], owner[order], start[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = np.zeros(len(key), bool)
        late[order] = (o > o[head]) | (b > b[head])
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "n": [len(p[0]) for p in parts], "late": [squeeze(np.packbits(x).tobytes()) for x in np.split(late, cuts)]})

    found = with_blocks(packed, masks).mapInArrow(candidates, "part int, block long, found binary")
    said = found.groupBy("part").applyInPandas(earliest, "block long, part int, n int, late binary")
    gone = said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "n", "late"))).alias("late"))

    def rewrite(batches):
        for batch in batches:
            for payload, mask, late in zip(batch.column("payload"), batch.column("masks").to_pylist(), batch.column("late").to_pylist()):
                table = table_of(payload.as_buffer())
                buf, off = tx.flat(table.column(text))
                words, at, (_, _, owner, start), new = candidates_of(table, mask)
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                late = np.concatenate([np.unpackbits(np.frombuffer(expand(x["late"]), np.uint8), count=x["n"]) for x in late or []] or [np.zeros(0, np.uint8)])
                gone = late.astype(bool)[np.cumsum(new) - 1] | (owner > owner[head]) | (start > start[head])
                drop = tx.covered(at[gone], window, len(words.starts))
                kept, new_off = tx.join_words(buf, words, ~drop)
                column = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(new_off), pa.py_buffer(kept)).cast(pa.string())
                column = pa.compute.if_else(pa.compute.is_null(table.column(text)), pa.scalar(None, pa.string()), column)
                removed = np.diff(np.r_[0, np.cumsum(drop)][words.first]) if len(drop) else np.zeros(len(off) - 1, np.int64)
                table = table.set_column(table.column_names.index(text), text, column)
                table = table.append_column("n_words", pa.array(words.counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
                yield from table.to_batches()

    return with_blocks(packed, masks).join(gone, "block", "left").mapInArrow(rewrite, schema)
