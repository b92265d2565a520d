import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from pagemill.llm import pieces
from pagemill.llm.pieces import MARK, PieceModel, decode_pieces, encode_pieces

MODEL = P.path("piece_bpe_32k.model")
ALPHABET = ["the", "ing", " ", "  ", "    ", "\n", "\t", "a", "e", "é", "ß", "1", "23", "!", "中文", "▁", "🙂", "th", "tion", "er", "Xq", "\x00", "</s>", "<unk>", "<0x41>"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", " ", "x" * 3000]


def test_bpe_words_equal_library():
    model = PieceModel(MODEL)
    encode = model.encoder()
    sample = texts(3000)
    got = [np.frombuffer(x, "<u4").tolist() for x in encode(sample)]
    want = model.lib.encode(sample)
    assert [t for t, a, b in zip(sample, got, want) if a != b] == []
    assert [t for t, a in zip(sample, want) if model.decode(np.array(a, "<u4").tobytes()) != model.lib.decode(a)] == []


def test_unigram_cuts_have_the_best_score():
    model = PieceModel(MODEL)
    model.kind, r = pieces.UNIGRAM, random.Random(2)
    vocabulary = {MARK, "a", "b", "ab", "ba", "aab", MARK + "a", "bab", "abab"}
    model.id = {p: i for i, p in enumerate(sorted(vocabulary))}
    model.score = {p: -r.uniform(1, 9) for p in vocabulary}
    model.unk_score, model.tails = -40.0, {p[i:] for p in vocabulary for i in range(len(p))}

    def best(word):
        if not word:
            return 0.0
        ways = [model.score[word[:n]] + best(word[n:]) for n in range(1, 5) if word[:n] in vocabulary and len(word) >= n]
        return max(ways + ([model.unk_score + best(word[1:])] if word[0] not in vocabulary else []))

    words = sorted({MARK + "".join(r.choice("aabbx") for _ in range(r.randint(1, 8))) for _ in range(200)})
    for word in words:
        state = [(0.0, "")]
        model._extend_unigram(word, state)
        assert abs(state[-1][0] - best(word)) < 1e-9


def test_shared_prefixes_do_not_leak():
    model = PieceModel(MODEL)
    words = sorted({MARK + w for w in ("the", "there", "theret", "thereto", "then", "thing", "things", "t", "tho", "x", "xylophones")})
    assert model.encode_words(words) == [model.encode_words([w])[0] for w in words]


def test_random_bytes_decode_like_library():
    model = PieceModel(MODEL)
    r = random.Random(9)
    for _ in range(300):
        ids = [r.randint(0, 262) if r.random() < 0.7 else r.randint(0, 31999) for _ in range(12)]
        assert model.decode(np.array(ids, "<u4").tobytes()) == model.lib.decode(ids), ids


def test_tables(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts(60))] + [(None, None, None), (5, "again", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model = PieceModel(MODEL)
    coded = encode_pieces(docs, MODEL)
    got = sorted(((r.doc_id, None if r.ids is None else zlib.crc32(r.ids), r.n_ids) for r in coded.collect()), key=str)
    want = [(i, None if t is None else zlib.crc32(np.array(model.lib.encode(t), "<u4").tobytes()), None if t is None else len(model.lib.encode(t))) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    back = decode_pieces(coded.drop("text"), MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, None if t is None else model.lib.decode(model.lib.encode(t))) for i, t, _ in rows), key=str)
    assert encode_pieces(docs.limit(0), MODEL).count() == 0
