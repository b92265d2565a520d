"""Byte-level BPE ids of whole tables: pre-tokens are cut by array operations, and each distinct one is encoded once."""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from . import textops as tx

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# Unicode White_Space, which \s means in the pre-tokeniser's pattern.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE = 400_000
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        table = np.array([LETTER if c == "L" else NUMBER if c == "N" else OTHER for c in first], np.uint8)
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def pretoken_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points `cp` of documents at `off`, under the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cp)
    kind = _class_table()[cp]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], n]
    k = kind[start]
    mark = np.zeros(n + 1, bool)
    white = k == SPACE
    last = edge[end]  # the run ends its document
    tail = cp[end - 1] == 0x20  # the run's last character can join the next pre-token
    several = end - start > 1
    mark[start[white & (last | several | ~tail)]] = True
    mark[end[white & ~last] - 1] = True
    joined = np.zeros(len(start), bool)  # a space before the run belongs to it
    joined[1:] = white[:-1] & tail[:-1] & ~last[:-1]
    mark[start[~white & ~joined & ~np.r_[False, white[:-1] & ~last[:-1] & ~tail[:-1]]]] = True
    mark[start[~white & np.r_[False, white[:-1] & ~last[:-1] & ~tail[:-1]]]] = True
    quote = np.flatnonzero((k == OTHER) & ~several & (cp[start] == 0x27) & ~joined & ~last)
    quote = quote[k[np.minimum(quote + 1, len(k) - 1)] == LETTER]
    if len(quote):
        padded = np.r_[cp, 0, 0]
        a, b = padded[end[quote]], padded[end[quote] + 1]
        two = (end[quote + 1] - start[quote + 1]) > 1
        size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            size = np.where((a == ord(x)) & (b == ord(y)) & two, 2, size)
        cut = quote[size > 0]
        size = size[size > 0]
        mark[start[cut + 1]] = False
        rest = start[cut + 1] + size
        mark[rest[rest < end[cut + 1]]] = True
    return np.flatnonzero(mark[:n])


def _byte_merger(model: dict):
    """A function from a pre-token's bytes to ids, if ids grow with the merges and every byte has one; else None."""
    try:
        import tiktoken
    except ImportError:
        return None
    vocab = model.get("vocab", {})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    order = [vocab.get(a + b, -1) for a, b in merges]
    # how byte-level vocabularies write a byte: itself if it prints, else the next free character from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or order != sorted(set(order)) or not all(c in vocab for c in back) or (order and max(vocab[c] for c in back) > order[0]):
        return None
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token)}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Column:
    """An array that grows at its end: `data` up to `n`."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray):
        n = self.n + len(values)
        if n + 8 > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(n + 8, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : n] = values
        self.n = n

    def eight(self) -> np.ndarray:
        """As textops.load8, of a column of bytes: eight more are always there."""
        return np.ndarray((self.n + 1,), "<u8", self.data, strides=(1,))


class Encoder:
    """Ids of documents in flat text, as the tokenizer file gives them without special tokens being added."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.special = [t["content"].encode() for t in found.get("added_tokens", [])]
        self.merge = _byte_merger(found["model"])
        self._reset()

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: by merges over bytes if the vocabulary allows it, else by the library."""
        if self.merge:
            return [self.merge(p) for p in pieces]
        return [e.ids for e in self.library.encode_batch([p.decode() for p in pieces], add_special_tokens=False)]

    def _reset(self):
        """An empty cache: entry e has a hash, its bytes and its ids; `slots` holds entries by the hash's low bits."""
        self.slots = np.full(2 << CACHE.bit_length(), -1, np.int32)
        self.keys, self.text, self.pool = _Column(np.uint64), _Column(np.uint8), _Column(np.uint32)
        self.text_at, self.text_size, self.begin, self.size = (_Column(np.int64) for _ in range(4))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The cache entry of each hash, -1 if there is none."""
        keys, last = self.keys.data, len(self.slots) - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        entry = self.slots[at]
        other = np.flatnonzero((entry >= 0) & (keys[entry] != hashes))
        while len(other):  # the next slots, up to an empty one
            at[other] = (at[other] + 1) & last
            entry[other] = self.slots[at[other]]
            other = other[(entry[other] >= 0) & (keys[entry[other]] != hashes[other])]
        return entry

    def _insert(self, entries: np.ndarray):
        """Slots for entries of distinct hashes that have none; half of the slots stay empty."""
        if 2 * self.size.n > len(self.slots):
            held = self.slots[self.slots >= 0]
            self.slots = np.full(4 << self.size.n.bit_length(), -1, np.int32)
            entries = np.r_[held, entries]
        last = len(self.slots) - 1
        at = (self.keys.data[entries] & np.uint64(last)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & last

    def _add(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries of pre-tokens."""
        data = buf.tobytes()
        found = self._pieces([data[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())])
        count = np.fromiter(map(len, found), np.int64, len(found))
        new, place = np.arange(self.size.n, self.size.n + len(found)), np.cumsum(sizes) - sizes
        self.keys.extend(hashes)
        self.text_at.extend(self.text.n + place)
        self.text_size.extend(sizes)
        self.text.extend(buf[np.arange(sizes.sum()) + np.repeat(starts - place, sizes)])
        self.begin.extend(self.pool.n + np.cumsum(count) - count)
        self.size.extend(count)
        self.pool.extend(np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())))
        return new

    def _entries(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cache entries of pre-tokens; an entry's bytes are compared, and those that are not there are added."""
        if self.size.n > CACHE:
            self._reset()
        entry = self._find(hashes)
        hit = np.flatnonzero(entry >= 0)
        own = entry[hit]
        same = self.text_size.data[own] == sizes[hit]
        same &= tx.same_loaded(self.text.eight(), self.text_at.data[own], tx.load8(buf), starts[hit], np.where(same, sizes[hit], 0))
        entry[hit[~same]] = -1
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            _, first, which = tx.distinct(hashes[fresh])
            lead = fresh[first]
            alike = sizes[fresh] == sizes[lead[which]]
            alike[alike] = tx.same_spans(buf, starts[fresh[alike]], starts[lead[which[alike]]], sizes[fresh[alike]])
            odd = np.flatnonzero(~alike)  # different pre-tokens with one hash: each differing one stands for itself
            which[odd] = len(first) + np.arange(len(odd))
            lead = np.r_[lead, fresh[odd]]
            new = self._add(hashes[lead], buf, starts[lead], sizes[lead])
            entry[fresh] = new[which]
            self._insert(new[: len(first)][self._find(hashes[lead[: len(first)]]) < 0])
        return entry

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) for documents of UTF-8 bytes."""
        data = buf.tobytes()
        if any(s in data for s in self.special):  # rare: those documents go whole to the library
            texts = [data[a:b].decode() for a, b in zip(off[:-1], off[1:])]
            odd = [d for d, t in enumerate(texts) if any(s.decode() in t for s in self.special)]
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            keep = np.repeat(plain, np.diff(off))
            some, some_off = self.encode_plain(buf[keep], np.r_[0, np.cumsum(np.diff(off) * plain)])
            rows = [some[a:b] for a, b in zip(some_off[:-1], some_off[1:])]
            for d, e in zip(odd, self.library.encode_batch([texts[d] for d in odd], add_special_tokens=False)):
                rows[d] = np.array(e.ids, np.uint32)
            return np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
        return self.encode_plain(buf, off)

    def encode_plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        lead = (buf & 0xC0) != 0x80
        cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero(lead)
        starts = place[pretoken_starts(cp, np.searchsorted(place, off))]
        ends = np.r_[starts[1:], len(buf)]
        entry = self._entries(tx.span_hash(buf, starts, ends), buf, starts, ends - starts)
        size = self.size.data[entry]
        total = np.cumsum(size)
        ids = self.pool.data[np.arange(total[-1]) + np.repeat(self.begin.data[entry] - (total - size), size)]
        return ids, np.r_[0, total][np.searchsorted(starts, off)]


@lru_cache(maxsize=1)
def _last_encoder(path: str, changed: int, size: int) -> Encoder:
    return Encoder(path)


def shared_encoder(path: str) -> Encoder:
    """The process's encoder of that file with its cache, which tasks of one Python worker use one after another; a new
    one if the file has changed. The cache changes no id, and only the last file's is kept."""
    found = os.stat(path)
    return _last_encoder(path, found.st_mtime_ns, found.st_size)
