"""Array kernels over Arrow text: words, span hashes, window minima, small label propagation.

Every kernel works on a flat byte buffer plus document offsets, so no Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NULL_ID = -(2**63)
STRETCH = 1 << 19
SHORT = 6

_U64 = np.uint64
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # one a lane
_FOLDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of a hash can be used alone."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def lower(buf: np.ndarray) -> np.ndarray:
    """LOWER[buf], by arithmetic."""
    return buf + (((buf - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def load8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of buf and its end on, as an unaligned view; zeros follow the end."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def _seeds(at: np.ndarray, lane: int) -> np.ndarray:
    return mix(at.astype(_U64) * _U64(_FOLDS[lane]) + _U64(_SEEDS[lane]))


def _long_spans(sizes: np.ndarray):
    """(span, number of an eight-byte piece in it) of all pieces of the spans, in arrays of about STRETCH pieces."""
    count = -(-sizes // 8)
    total = np.r_[0, np.cumsum(count)]
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + STRETCH, "right")) - 1)
        yield np.repeat(np.arange(lo, hi), count[lo:hi]), np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])
        lo = hi


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of buf[starts:ends] for each span; lanes are independent.

    Each eight bytes are mixed with a seed of their place and the lane before they are added up, so no rearrangement of
    a text keeps its sum, as it can under polynomial hashes modulo a power of two.
    """
    eight, size = load8(buf), ends - starts
    seeds = _seeds(np.arange(SHORT), lane)
    out = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + seeds[0])
    out[size == 0] = 0
    at, place, left = np.arange(len(starts)), starts, size
    for k in range(1, SHORT + 1):
        more = np.flatnonzero(left > 8)
        at, place, left = at[more], place[more] + 8, left[more] - 8
        if not len(at) or k == SHORT:
            break
        out[at] += mix((eight[place] & _MASKS[np.minimum(left, 8)]) + seeds[k])
    for span, k in _long_spans(size[at] - 8 * SHORT) if len(at) else ():
        own, k = at[span], k + SHORT
        value = mix((eight[starts[own] + 8 * k] & _MASKS[np.minimum(size[own] - 8 * k, 8)]) + _seeds(k, lane))
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(value, first)
    return mix(out ^ (size.astype(_U64) * _U64(_FOLDS[lane])))


def same_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[a : a + size] equals buf[b : b + size], byte by byte, for each triple."""
    eight = load8(buf)
    return same_loaded(eight, a, eight, b, size)


def same_loaded(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """same_spans of spans at `a` of one buffer and `b` of another, both as load8 gives them."""
    out = ((one[a] ^ two[b]) & _MASKS[np.minimum(size, 8)]) == 0
    rest = np.flatnonzero(out & (size > 8))
    a, b, size = a[rest] + 8, b[rest] + 8, size[rest] - 8
    for span, k in _long_spans(size) if len(rest) else ():
        differ = (one[a[span] + 8 * k] ^ two[b[span] + 8 * k]) & _MASKS[np.minimum(size[span] - 8 * k, 8)]
        out[rest[span[differ != 0]]] = False
    return out


def equal_groups(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """`new` (which of sorted spans open a group of equal hash), corrected by comparing all bytes: where a member of a
    group differs from its first one, every member opens a group of its own."""
    if not len(new):
        return new
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    rest = np.flatnonzero(~new)
    alike = size[rest] == size[head[rest]]
    alike[alike] = same_spans(buf, starts[rest[alike]], starts[head[rest[alike]]], size[rest[alike]])
    if not alike.all():
        new = new | np.isin(head, head[rest[~alike]])
    return new


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, an index of each, and for every hash its number among them."""
    order = hash_order(hashes)
    ranked = hashes[order]
    new = np.r_[np.ones(min(1, len(hashes)), bool), ranked[1:] != ranked[:-1]]
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def hash_order(keys: np.ndarray) -> np.ndarray:
    """Indices that sort unsigned 64-bit keys, ties as they were: upper bits are sorted as numbers that end in the index,
    and what equal upper bits leave unsorted, if anything, by a merge sort of nearly sorted keys."""
    low = _U64(len(keys).bit_length())
    packed = ((keys >> low) << low) | np.arange(len(keys), dtype=_U64)
    packed.sort()
    order = (packed & ((_U64(1) << low) - _U64(1))).astype(np.int64)
    ranked = keys[order]
    return order[np.argsort(ranked, kind="stable")] if (ranked[1:] < ranked[:-1]).any() else order


def stable_order(values: np.ndarray, bound: int) -> np.ndarray:
    """Indices that sort integers from 0 to bound, ties as they were: a radix sort by 16 bits."""
    digit = lambda v, shift: ((v >> shift) & 0xFFFF).astype(np.uint16)
    order = np.argsort(digit(values, 0), kind="stable")
    for shift in range(16, int(bound).bit_length(), 16):
        order = order[np.argsort(digit(values[order], shift), kind="stable")]
    return order


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k >= 8 bytes."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    eight = load8(buf)
    out = mix(eight[:n] + _U64(_SEEDS[0]))
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        out = mix(out * _U64(_FOLDS[0]) + eight[at : at + n])
    return out


def gram_hash(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` consecutive hashes (len - size + 1 of them), by doubling."""
    if len(hashes) < size:
        return np.zeros(0, _U64)
    fold, width, run, out, have = _U64(_FOLDS[lane]), 1, mix(hashes + _U64(_SEEDS[lane]) + _U64(size)), None, 0
    while True:
        if size & width:  # the smaller parts of the run come first
            out, have = (run, width) if out is None else (mix(out[: len(run) - have] * fold + run[have : have + len(out)]), have + width)
        if width * 2 > size:
            return out[: len(hashes) - size + 1]
        run, width = mix(run[:-width] * fold + run[width:]), width * 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ids(column) -> np.ndarray:
    """Ids as int64; null becomes the smallest one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of each document: starts, ends, and `first` (index of a document's first word)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        ink = (buf != 0x20) & ((buf - np.uint8(9)) > 4)  # not one of SPACE_BYTES
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        cut[1:n] |= ink[1:] != ink[:-1]
        self.starts = np.flatnonzero(ink & cut[:n])
        self.ends = np.flatnonzero(ink & cut[1:]) + 1
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.buf = buf

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hash(self.buf, self.starts, self.ends, lane)

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words that start a window of `size` words inside one document."""
        if len(self.starts) < size:
            return np.zeros(0, np.int64)
        limit = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(self.starts))
        return at[at + size <= limit]


def chunks(off: np.ndarray, limit: int = 4 << 20):
    """Ranges of documents of about `limit` bytes; a longer document stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """(rows, bytes, offsets) of about `limit` text bytes each, so that only a slice of a batch is copied at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in chunks(np.r_[0, np.cumsum(sizes, dtype=np.int64)], limit):
        rows = batch.slice(lo, hi - lo)
        yield rows, *flat(rows.column(column))


def gathered(batches, column: str, limit: int):
    """Tables of about `limit` bytes of that column, whatever the batches' size; a longer row stands alone."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, int(np.searchsorted(total, total[lo] + limit - size, "right")) - 1)
            if hi <= lo and not held:
                hi = lo + 1
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                size += int(total[hi] - total[lo])
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            lo = max(lo, hi)
    if held:
        yield pa.Table.from_batches(held)


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Positions of 0..n-1 covered by spans [start, start + size)."""
    change = np.bincount(starts, minlength=n + 1)
    change -= np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component for links a-b among 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def join_words(buf: np.ndarray, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each document's kept words joined by one space."""
    starts, ends, docs = words.starts[keep], words.ends[keep], words.docs()[keep]
    n_docs = len(words.counts)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(n_docs + 1, np.int64)
    lead = np.r_[False, docs[1:] == docs[:-1]]  # a word after another one of its document brings a space
    size = ends - starts + lead
    begin = np.r_[0, np.cumsum(size)]
    source = np.arange(begin[-1]) + np.repeat(starts - lead - begin[:-1], size)
    out = buf[np.maximum(source, 0)]
    out[begin[:-1][lead]] = 0x20
    return out, np.r_[0, np.cumsum(np.bincount(docs, size, n_docs).astype(np.int64))]
