"""SentencePiece encoding and decoding by a shared-prefix Viterbi over the distinct marked words."""

from __future__ import annotations

import codecs
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .session import prepare

MARK = "▁"
UNIGRAM, BPE = 1, 2
CACHE, BORDERS = 600_000, 1_000_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields; values are ints or bytes."""

    def varint(at):
        out = shift = 0
        while True:
            out |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _byte_marks(error):
    return "�" * (error.end - error.start), error.end


class PieceModel:
    """A model file's pieces; `encode_words` cuts marked words as the file's kind of model does.

    Unigram models take the cut of best total score. For BPE models the forward state of a prefix is the last piece of
    its encoding: a piece can follow another if merging both together gives just these two, and of all pieces that end a
    prefix exactly one can follow the state where it starts. So both kinds are one pass over prefixes, and words that
    share a prefix share its states.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.unk = lib.unk_id()
        self.unk_score = min(self.score.values(), default=0.0) - 10
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        # a piece with a mark after other characters would join words; then a text is one word
        joins = any(MARK in p.lstrip(MARK) for p in self.id)
        self.words = re.compile(r"(?s).+" if joins else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.follows: dict[tuple[str, str], bool] = {}
        self.last: dict[str, tuple[str, str] | None] = {}
        self.sound: set[str] = set()  # pieces known to be made by merges
        self.rank = {p: r for r, p in enumerate(sorted((p for p in self.id if len(p) > 1), key=lambda p: (-self.score[p], self.id[p])))}
        self.tails = {p[i:] for p in self.id for i in range(len(p))}
        raw = [b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw = raw
        self.dummy = bool(dict(_fields(next((v for k, v in top if k == 3), b""))).get(3, 1))
        codecs.register_error("pieces", _byte_marks)

    def _order(self, piece: str) -> int:
        """When BPE makes a piece: earlier ones have smaller numbers, single characters are there from the start."""
        return self.rank[piece] if len(piece) > 1 else -1

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that BPE merges last into a piece; None if it never makes the piece."""
        found = self.last.get(piece, "")
        if found == "":
            symbols = list(piece)
            while len(symbols) > 2:
                best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=None)
                if best[0] == -np.inf:
                    break
                i = -best[1]
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            found = self.last[piece] = tuple(symbols) if len(symbols) == 2 else None
        return found

    def _can_follow(self, left: str, right: str) -> bool:
        """Whether BPE leaves the border between two pieces alone: their merges are undone, the latest first, and each
        time the pieces then at the border must not merge before the merge just undone. Of equal merges the left one
        goes first."""
        key = (left, right)
        found = self.follows.get(key)
        if found is None:
            rank, limit, found = self.rank, 1 << 60, True
            while True:
                if rank.get(left + right, limit) < limit:
                    found = False
                    break
                a, b = self._order(left) if left in rank else -1, self._order(right) if right in rank else -1
                if a < 0 and b < 0:
                    break
                if a > b:
                    limit, left = a, self._parts(left)[1]
                else:
                    limit, right = b + 1, self._parts(right)[0]
            if len(self.follows) > BORDERS:
                self.follows.clear()
            self.follows[key] = found
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words should be sorted, for then the stack of states walks their trie depth-first."""
        extend = self._extend_bpe if self.kind == BPE else self._extend_unigram
        ids, out, before, state = self.id, [], "", [(0.0, "")]  # state[i]: score and last piece of the first i characters
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :]
            extend(word, state)
            before, at, parts = word, len(word), []
            while at:
                parts.append(state[at][1])
                at -= len(parts[-1])
            own = [ids.get(p, -1) for p in reversed(parts)]
            out.append(own if -1 not in own else [i for p in reversed(parts) for i in self._ids(p)])
        return out

    def _ends(self, word: str, end: int) -> list[int]:
        """Starts of the pieces that end there, the nearest first; a text that ends no piece has no longer one either."""
        tails, ids, out = self.tails, self.id, []
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece not in tails:
                break
            if piece in ids:
                out.append(start)
        return out

    def _extend_bpe(self, word: str, state) -> None:
        follows, can_follow, parts, sound = self.follows, self._can_follow, self._parts, self.sound
        for end in range(len(state), len(word) + 1):
            for start in reversed(self._ends(word, end)):
                piece = word[start:end]
                if start:
                    left = state[start][1]
                    fits = follows.get((left, piece))
                    if not (can_follow(left, piece) if fits is None else fits):
                        continue
                if piece in sound or end - start < 3 or parts(piece):
                    sound.add(piece)
                    state.append((0.0, piece))
                    break
            else:
                state.append((0.0, word[end - 1]))

    def _extend_unigram(self, word: str, state) -> None:
        for end in range(len(state), len(word) + 1):
            char = word[end - 1]
            best = None if char in self.id else (state[end - 1][0] + self.unk_score, char)
            for start in reversed(self._ends(word, end)):
                total = state[start][0] + self.score[word[start:end]]
                if best is None or total > best[0]:
                    best = (total, word[start:end])
            state.append(best)

    def _ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.byte_fallback and self.bytes else [self.unk]

    def encoder(self):
        """A function from text to little-endian uint32 ids, with a bounded memory of words."""
        memory: dict[str, bytes] = {}

        def prepare_words(texts: list[str]) -> list[list[str]]:
            cut = [self.words.findall(t) for t in texts]
            fresh = sorted({w for ws in cut for w in ws} - memory.keys())
            if len(memory) + len(fresh) > CACHE:
                memory.clear()
                fresh = sorted({w for ws in cut for w in ws})
            for word, ids in zip(fresh, self.encode_words(fresh)):
                memory[word] = array("I", ids).tobytes()
            return cut

        def encode(texts: list[str]) -> list[bytes]:
            cut = prepare_words([self.lib.normalize(t) if t else "" for t in texts])
            out = [b"".join([memory[w] for w in ws]) for ws in cut]
            return out if self.byte_fallback else [self._join_unknown(x) for x in out]

        return encode

    def _join_unknown(self, ids: bytes) -> bytes:
        """A run of unknown characters is one piece."""
        a = np.frombuffer(ids, "<u4")
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != self.unk) | (a[:-1] != self.unk)
        return a[keep].tobytes()

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        numbers = np.frombuffer(ids, "<u4").tolist()
        data = b"".join([raw[i] for i in numbers])
        first = next((i for i in numbers if raw[i]), None)
        marked = self.dummy and first is not None and self.pieces[first].startswith(MARK)
        return (data[1:] if marked else data).decode("utf-8", "pieces")


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs plus ids (little-endian uint32) and n_ids. The model file has to be at that path on all executors.

    Distinct marked words of a slice of rows are sorted and walked as a trie, depth first; a stack keeps the forward
    states of the current prefix. Null text gives null ids and no count; empty text no ids. Input columns named ids or
    n_ids are replaced. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("ids", "n_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType())])

    def run(batches):
        encode = PieceModel(model).encoder()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(text).to_pylist()
                ids = [None if t is None else x for t, x in zip(texts, encode(texts))]
                out = pa.Table.from_batches([part]).append_column("ids", pa.array(ids, pa.binary()))
                yield from out.append_column("n_ids", pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64())).to_batches()

    return docs.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with `text` decoded from `ids`; null ids give null. Bytes that are no UTF-8 become U+FFFD one by one."""
    prepare(rows.sparkSession)
    rows = rows.drop(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        known = PieceModel(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if x is None else known.decode(x) for x in part.column(ids).to_pylist()]
                yield from pa.Table.from_batches([part]).append_column(text, pa.array(texts, pa.string())).to_batches()

    return rows.mapInArrow(run, schema)
