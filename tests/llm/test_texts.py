"""Every text operator against a plain version of its rule, on rows with nulls, ties, copies, empty and long texts."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from pagemill.llm import packing, suffix, textops as tx
from pagemill.llm.lines import dedup_lines
from pagemill.llm.simhash import radius_links, simhash_groups
from pagemill.llm.substring import dedup_substrings
from pagemill.llm.suffix import common_prefixes, dedup_bytes, suffix_array

SPACES = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, payload int"


def corpus(seed=1, n=60, words=90):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "中文", "🙂", "A", "a"]
    out, texts = [], []
    for i in range(n):
        own = [r.choice(vocabulary) for _ in range(r.randint(0, words))]
        if texts and r.random() < 0.5:
            old = r.choice(texts).split()
            at = r.randint(0, len(own))
            cut = r.randint(0, max(0, len(old) - 1))
            own[at:at] = old[cut : cut + r.randint(5, 60)]
        texts.append("".join(w + r.choice([" ", " ", " ", "\n", "  ", "\t\n"]) for w in own))
        out.append((i * 3 % 101, texts[-1]))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, texts[5]), (204, texts[5]), (205, "x " * 300), (206, "\n".join(["same line"] * 9)), (None, texts[7]), (203, texts[5]), (207, "long " * 20000)]
    return [(i, t, "en", "src0" if k % 3 else None, None, "clash", 7) for k, (i, t) in enumerate(out)]


def key_of(row):
    return -(2**63) if row[0] is None else row[0]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def earliest(items):
    """{content: smallest (id, start)} of (content, id, start)."""
    out = {}
    for content, i, s in items:
        out[content] = min(out.get(content, (i, s)), (i, s))
    return out


def covered_by_later(rows, units, size, later):
    first = earliest((tuple(u[s : s + size]), key_of(r), s) for r, u in zip(rows, units) for s in range(len(u) - size + 1))
    out = []
    for r, u in zip(rows, units):
        drop = [False] * len(u)
        for s in range(len(u) - size + 1):
            if later((key_of(r), s), first[tuple(u[s : s + size])]):
                drop[s : s + size] = [True] * size
        out.append(drop)
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_substrings_equal_brute_force(spark, window):
    rows = corpus()
    units = [split(r[1]) for r in rows]
    drops = covered_by_later(rows, units, window, lambda a, b: a > b)
    want = sorted(((r[0], len(u), sum(d), None if r[1] is None else " ".join(w for w, x in zip(u, d) if not x)) for r, u, d in zip(rows, units, drops)), key=str)
    out = dedup_substrings(frame(spark, rows), window)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "payload", "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str)
    assert got == want and sum(w[2] for w in want) > 100


@pytest.mark.parametrize("length,shard", [(50, 1 << 20), (30, 400)])
def test_bytes_equal_brute_force(spark, monkeypatch, length, shard):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    rows = [r for r in corpus(3, 80, 140) if r[0] != 207]
    units = [list((r[1] or "").encode()) for r in rows]
    drops = covered_by_later(rows, units, length, lambda a, b: a[0] > b[0])
    want = []
    for r, u, d in zip(rows, units, drops):
        spans = sum(x and not y for x, y in zip(d, [False, *d]))
        want.append((r[0], len(u), sum(d), spans, bytes(b for b, x in zip(u, d) if not x)))
    out = dedup_bytes(frame(spark, rows), length, k=min(24, length - 6)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 500


def line_windows(units, run, words):
    """(start, content) of each window: the fewest lines with so many words, or `run` lines."""
    for s in range(len(units)):
        size = next((m for m in range(1, run + 1) if m == run or sum(len(split(x)) for x in units[s : s + m]) >= words), run)
        if s + size <= len(units):
            yield s, tuple(units[s : s + size])


@pytest.mark.parametrize("run,words", [(3, 8), (2, 10**6), (4, 25), (1, 1)])
def test_lines_equal_brute_force(spark, run, words):
    rows = corpus(5)
    cut = [(r[1] or "").split("\n") for r in rows]
    ink = [[k for k, line in enumerate(c) if line.strip(SPACES)] for c in cut]
    units = [[c[k].strip(SPACES) for k in i] for c, i in zip(cut, ink)]
    first = earliest((w, key_of(r), s) for r, u in zip(rows, units) for s, w in line_windows(u, run, words))
    want = []
    for r, c, i, u in zip(rows, cut, ink, units):
        drop = {s + k for s, w in line_windows(u, run, words) if (key_of(r), s) > first[w] for k in range(len(w))}
        gone = {i[k] for k in drop}
        want.append((r[0], len(i), len(gone), None if r[1] is None else "\n".join(line for k, line in enumerate(c) if k not in gone)))
    got = dedup_lines(frame(spark, rows), run, words).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 20


def test_every_window_selects_a_line():
    from pagemill.llm.lines import Lines, windows, winnow

    texts = [r[1] for r in corpus(8)]
    lines = Lines(*tx.flat(pa.array(texts)))
    at, size = windows(lines, 5, 40)
    chosen, sizes = winnow(lines, 5, 40)
    held = {(int(p) - o, int(n)) for p, row in zip(chosen, sizes) for o, n in enumerate(row) if n}
    assert held == set(zip(at.tolist(), size.tolist())) and len(chosen) < 0.8 * len(at)


def plain_fingerprint(text, shingle):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rows = corpus(7, 80, 40)
    prints = [plain_fingerprint(r[1], 4) for r in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 or key_of(rows[a]) == key_of(rows[b]):
                x, y = find(key_of(rows[a])), find(key_of(rows[b]))
                parent[max(x, y)] = min(x, y)
    show = lambda x: None if x == -(2**63) else x
    want = [(r[0], f"{p:016x}", show(find(key_of(r)))) for r, p in zip(rows, prints)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("lanes,radius", [(1, 4), (2, 25), (4, 51)])
def test_radius_links_connect_what_all_pairs_connect(lanes, radius):
    r = np.random.default_rng(lanes)
    base = r.integers(0, 2**63, (6, lanes), np.uint64)
    codes = base[r.integers(0, 6, 900)].copy()
    for _ in range(radius // 2):
        codes[np.arange(900), r.integers(0, lanes, 900)] ^= np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64) * (r.random(900) < 0.8)
    codes = np.unique(np.concatenate([codes, r.integers(0, 2**63, (200, lanes), np.uint64)]), axis=0)
    n = len(codes)
    d = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2, dtype=int)
    a, b = np.nonzero(np.triu(d <= radius, 1))
    p, q = radius_links(codes, radius)
    assert (d[p, q] <= radius).all() and (tx.forest(n, p, q) == tx.forest(n, a, b)).all()


@pytest.mark.parametrize("leaf,fan,pairs", [(16, 8, 1 << 16), (2, 2, 3)])
def test_gray_index_decides_buckets_of_every_size(monkeypatch, leaf, fan, pairs):
    from pagemill.llm import simhash

    for name, value in (("LEAF", leaf), ("FAN", fan), ("PAIRS", pairs)):
        monkeypatch.setattr(simhash, name, value)
    r = np.random.default_rng(8)
    bucket = np.repeat(np.arange(60), r.integers(1, 40, 60) * r.choice([1, 1, 6], 60))
    codes = np.zeros((len(bucket), 1), np.uint64)
    for _ in range(5):
        codes[:, 0] ^= np.uint64(1) << r.integers(0, 20, len(bucket)).astype(np.uint64)
    mixed = r.permutation(len(bucket))
    bucket, codes = bucket[mixed], codes[mixed]
    near = (np.bitwise_count(codes ^ codes.T) <= 2) & (bucket[:, None] == bucket[None])
    a, b = np.nonzero(np.triu(near, 1))
    p, q = radius_links(codes, 2, bucket)
    assert near[p, q].all() and len(p) < len(bucket) and (tx.forest(len(bucket), p, q) == tx.forest(len(bucket), a, b)).all()


def test_tables_meet_all_codes_within_the_radius():
    from pagemill.llm.simhash import exact_tables

    r = np.random.default_rng(9)
    for n, tables in ((10**5, 15), (10**9, 35), (10**12, 70)):
        masks = [int(m[0]) for m in exact_tables(4, n)]
        assert len(masks) == tables
        for _ in range(500):
            differ = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
            assert any(not differ & m for m in masks)


def test_wide_simhash_finds_near_copies(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        words = [f"v{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for k in r.sample(range(300), 5):
            words[k] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash_groups(docs, shingle=5, radius=51, lanes=4, miss=0.005).collect()}
    assert all(got[2 * i] == 2 * i for i in range(60)) and sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 57


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_near_duplicates_have_the_jaccard_index(spark, monkeypatch, block):
    from pagemill.llm import simhash

    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    r = random.Random(6)
    rows = [(900, "a b c d e " * 5 + "x"), (901, "a b c d e " * 5 + "y z q w u v " * 2)]
    for i in range(60):  # chains of copies on both sides of 0.8
        words = [f"v{r.randint(0, 5000)}" for _ in range(150)]
        for k in range(4):
            rows.append((4 * i + k, " ".join(words)))
            for at in r.sample(range(150), r.randint(1, 6)):
                words[at] = f"c{r.randint(0, 999)}"
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = tx.forest(len(rows), *(np.array(x) for x in zip(*near)))
    first = {k: min(rows[x][0] for x in range(len(rows)) if label[x] == k) for k in set(label.tolist())}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in pipeline.near_duplicates(spark, docs, "").collect()}
    assert set(first.values()) <= kept and 60 < len(first) < 180
    assert len(kept - set(first.values())) <= 0.03 * len(rows)  # what the fingerprints' radius does not reach


def test_prefixes_of_similar_sets_meet():
    from pagemill.llm import simhash

    r = np.random.default_rng(3)
    heavy = r.permutation(np.arange(1, 40).astype(np.uint64))
    for _ in range(3000):
        n = r.integers(1, 60)
        a = r.choice(np.arange(1, 200), n, replace=False)
        b = np.unique(np.where(r.random(n) < 0.12, r.integers(1, 200, n), a))
        both = len(np.intersect1d(a, b))
        if 10 * both >= 8 * (len(a) + len(b) - both):
            sets = [np.sort(x).astype(np.uint64) for x in (a, b)]
            for order in (heavy, heavy[:0]):
                p, q = simhash.prefixes(np.concatenate(sets), np.cumsum([0, len(a), len(b)]), order, 0.8)
                assert len(np.intersect1d(p, q))


def test_no_near_duplicate_within_the_radius_is_missed(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from pagemill.llm import simhash

    r, texts = random.Random(12), []
    for _ in range(1200):  # pairs close to 0.8, which share no tables more often than others
        words = [f"v{r.randint(0, 5000)}" for _ in range(100)]
        texts.append(" ".join(words))
        for at in r.sample(range(4, 96), 2):
            words[at] = "changed"
        texts.append(" ".join(words))
    codes = simhash.fingerprints(*tx.flat(pa.array(texts)), 5, 4)
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (t.split() for t in texts)]
    due = {2 * i + 1 for i in range(1200) if simhash.distance(codes[2 * i], codes[2 * i + 1][None]) <= 51 and len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in pipeline.near_duplicates(spark, docs, "").collect()}
    assert set(range(2400)) - kept == due and len(due) > 800


@given(st.lists(st.integers(97, 99), max_size=300), st.integers(8, 60))
@settings(max_examples=80, deadline=None)
def test_suffix_arrays(data, depth):
    buf, raw = np.array(data, np.uint8), bytes(data)
    sa = suffix_array(buf, depth) if data else np.zeros(0, int)
    pad = lambda i: raw[i : i + depth].ljust(depth, b"\0")
    assert sorted(sa.tolist()) == list(range(len(raw))) and all(pad(a) <= pad(b) for a, b in zip(sa, sa[1:]))
    prefix = common_prefixes(buf, sa, depth) if data else []
    for x in range(1, len(sa)):
        a, b = raw[sa[x - 1] :], raw[sa[x] :]
        assert prefix[x] == min(depth, next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))))


def test_packing_keeps_every_id(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    rows = corpus(9, 50, 400) + [(300, "a <|endoftext|> b don't 's", "en", "s", 1, "x", 1)]
    out = packing.pack_documents(frame(spark, rows), path, window=128).collect()
    docs, sequences = {}, {}
    for r in out:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= 128
    got = sorted(((r.doc_id, r.start, r.length, bytes(r.ids)) for r in out), key=str)
    assert all(len(g[3]) == 4 * g[2] > 0 for g in got)
    total = sum(len(known.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert sum(r.length for r in out) == total and len(sequences) <= total / 128 + 8
    for r in rows:
        if r[0] not in (203, None):
            ids = b"".join(x[3] for x in sorted((g for g in got if g[0] == r[0]), key=lambda g: g[1]))
            assert np.frombuffer(ids, "<u4").tolist() == known.encode(r[1] or "", add_special_tokens=False).ids + [0]


def test_empty_tables(spark):
    from pagemill.llm.langid import identify
    from pagemill.llm.quality import quality_scores

    empty = spark.createDataFrame([], SCHEMA)
    assert [f(empty).count() for f in (dedup_substrings, dedup_bytes, dedup_lines, simhash_groups, identify)] == [0] * 5
    assert quality_scores(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_classifiers_on_held_out_rows(spark):
    from pagemill.llm.langid import identify
    from pagemill.llm.quality import quality_scores

    r = random.Random(2)
    stems = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ein", "ver"], "zz": ["eau", "oui", "ment", "é"]}
    rows, labels = [], []
    for i in range(400):
        lang = r.choice(list(stems))
        good = r.random() < 0.7
        words = ["".join(r.choice(stems[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), lang))
        labels.append((i, int(good)))
    rows += [(1000, None, "xx"), (1001, "12 34 !!", "yy"), (1002, "", None), (None, "ka lo mi", "xx"), (1003, "kalo mitu", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify(docs).collect()
    true = {i: lang for i, _, lang in rows if i is not None and i < 1000}
    held = [x for x in found if x.held_out and x.doc_id in true]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in found) and len(found) == len(rows)
    assert np.mean([x.lang_pred == true[x.doc_id] for x in held]) > 0.97 and all(0 <= x.score <= 1 for x in found)
    assert {x.lang_pred for x in found if x.doc_id in (1000, 1001, 1002)} == {"und"}
    scores = quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [x for x in scores if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    truth = dict(labels)
    assert len(scores) == len(rows) and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    assert all(x.predicted == (x.score >= 0.3) and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in scores)


def test_language_filters_hold_many_languages():
    from pagemill.llm.langid import Filters, grams

    r = np.random.default_rng(0)
    codes = {f"l{i:02d}": np.unique(grams(*tx.flat(pa.array([bytes(r.integers(97, 123, 400, dtype=np.uint8)).decode()])), 3)[1]) for i in range(20)}
    filters = Filters(codes)
    assert filters.slices.shape[0] == 3 and (filters.false_rate < 0.01).all()
    text = pa.array([bytes(r.integers(97, 123, 400, dtype=np.uint8)).decode()])
    own = np.unique(grams(*tx.flat(text), 3)[1])
    assert Filters(codes | {"zz": own}).counts(*tx.flat(text))[0].argmax() == 20


def test_components_of_long_chains(spark):
    from pagemill.llm.components import components

    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 7), (9, 5)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 9: 5}


def test_components_of_large_stars(spark, monkeypatch):
    from pagemill.llm import components as c

    monkeypatch.setattr(c, "HOT_ROWS", 20)
    links = [(0 if i % 3 else 900, i) for i in range(1, 300)] + [(900, 7), (1000, 1001), (1002, 1001)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(300), 900]} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_stages_of_the_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(r[0] if r[0] is not None else 900, r[1], r[2], r[3], len(r[1] or "")) for r in corpus(11, 40)]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.dtypes == docs.dtypes and after.count() <= kept.count()
        kept = after
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {200, 201, 202} and ids
    pieces = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def thue_morse(n, flip=0):
    """Letters by the parity of the one bits of their places; sums of powers cannot tell a row from its complement."""
    return "".join("ab"[(k.bit_count() + flip) & 1] for k in range(n))


def test_hashes_tell_rearranged_texts_apart(spark):
    one, two = thue_morse(2048), thue_morse(2048, 1)
    buf, off = tx.flat(pa.array([one, two, one, "", "a" * 9, "a" * 10]))
    for lane in (0, 1):
        h = tx.span_hash(buf, off[:-1], off[1:], lane).tolist()
        assert h[0] == h[2] and len(set(h)) == 5
    # a group whose members differ in their bytes is taken apart, whatever the hash says
    claimed = np.array([True, False, False, True, True, False])
    assert tx.equal_groups(buf, off[:-1], np.diff(off), claimed).tolist() == [True, True, True, True, True, True]
    assert tx.equal_groups(buf, off[[0, 2]], np.diff(off)[[0, 2]], np.array([True, False])).tolist() == [True, False]
    docs = lambda a, b: spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    lead = "".join(f"w{k} " for k in range(19))
    out = dedup_substrings(docs(lead + one, lead + two)).collect()
    assert [r.n_removed for r in out] == [0, 0]
    out = dedup_lines(docs(f"x\ny\n{one}", f"x\ny\n{two}")).collect()
    assert [r.n_removed for r in out] == [0, 0]
    long = {0: thue_morse(4096), 1: thue_morse(4096, 1)}
    want = {long[1][s : s + 200] for s in range(4096 - 199)} & {long[0][s : s + 200] for s in range(4096 - 199)}
    gone = [False] * 4096
    for s in range(4096 - 199):
        if long[1][s : s + 200] in want:
            gone[s : s + 200] = [True] * 200
    found = {r.doc_id: r.n_removed for r in dedup_bytes(docs(long[0], long[1]), 200).collect()}
    assert found == {1: 0, 2: sum(gone)}
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    for r in packing.pack_documents(docs(one, f"{one} {two}"), path, window=8192).collect():
        ids = Tokenizer.from_file(path).encode(one if r.doc_id == 1 else f"{one} {two}", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == [*ids, 0]


def test_spans_compare_and_hash_like_their_bytes():
    r = np.random.default_rng(5)
    buf = r.integers(97, 99, 700, dtype=np.uint8)
    a, b = r.integers(0, 400, 500), r.integers(0, 400, 500)
    size = r.integers(0, 12, 500) * r.choice([1, 1, 1, 25], 500)
    a[:100] = b[:100]
    raw = buf.tobytes()
    want = [raw[x : x + n] == raw[y : y + n] for x, y, n in zip(a, b, size)]
    assert tx.same_spans(buf, a, b, size).tolist() == want
    h = [tx.span_hash(buf, x, x + size) for x in (a, b)]
    assert (h[0] == h[1]).tolist() == want and 100 < sum(want) < 500


def test_stages_keep_columns_whose_names_operators_use(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    lines = "one two three four five six seven eight nine\n" * 2
    rows = [(k, t, lang, -1.5, "three", "none", 7, "mine", "c0", True) for k, t, lang in [(1, lines + "kept one", "en"), (2, "zwei wörter", None), (3, "other words " * 30, "en"), (4, "other words " * 31, "en"), (5, None, "en")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_lines string, n_removed string, n_words int, lang_pred string, column_0 string, kept boolean")
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.dtypes == docs.dtypes
        assert {tuple(r)[3:] for r in kept.collect()} == {(-1.5, "three", "none", 7, "mine", "c0", True)}
    assert {r.doc_id: r.text for r in kept.collect()}[1] == "one two three four five six seven eight nine kept one"


def test_ftrl_equals_a_plain_version():
    """The update rule of follow-the-regularised-leader, one coordinate and one example at a time."""
    from pagemill.llm.quality import BITS, ftrl

    r = np.random.default_rng(1)
    examples = [(np.sort(r.choice(40, 5, replace=False)), r.random(5), int(r.random() < 0.5)) for _ in range(60)]
    z, n, w = {}, {}, {}
    alpha, beta, l1, l2, bias = 0.6, 1.0, 0.02, 0.2, 1 << BITS

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (1 if zi > 0 else -1) * l1) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            at, x, y = examples[k]
            terms = [*zip(at.tolist(), x.tolist()), (bias, 1.0)]
            w = {i: weight(i) for i, _ in terms}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in terms)))
            for i, v in terms:
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = ftrl(examples)
    assert np.allclose([got[i] for i in [*range(40), bias]], [weight(i) for i in [*range(40), bias]])


def test_quality_scores_equal_dot_products_by_hand(spark):
    from pagemill.llm import quality as q

    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["good", "words", "BAD!!", "x1", "é"]) for _ in range(r.randint(0, 30)))) for i in range(40)] + [(41, None), (42, ""), (1, "again"), (None, "good words"), (43, "word " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", q.F.lit("own")).withColumn("label", q.F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 44)] + [(2, None), (4, 1), (4, 0)], "doc_id long, quality int").withColumn("text", q.F.lit("clash"))
    weights = q.train(docs, labels)
    assert np.array_equal(weights, q.train(docs.repartition(5), labels)) and np.count_nonzero(weights) > 3
    assert not np.array_equal(weights, q.train(docs, labels, rows=10)) and np.array_equal(q.train(docs, labels, text_bytes=0), np.zeros_like(weights))
    want = []
    for i, t in rows:
        row, feat, value = q.features(*tx.flat(pa.array([t], pa.string())))
        total = float(weights[-1]) + sum(float(weights[f]) * v for f, v in zip(feat.tolist(), value.tolist()))
        want.append((i, round(float(1 / (1 + np.exp(-total))), 9)))
    assert sorted(((x.doc_id, round(x.score, 9)) for x in q.score(docs, weights).collect()), key=str) == sorted(want, key=str)


def test_quality_features_count_words_and_shapes():
    """Square roots of counts over their length, for words and for shapes, told from the features of single words."""
    from pagemill.llm.quality import BITS, features

    one = lambda t: {f: v for _, f, v in zip(*features(*tx.flat(pa.array([t]))))}
    word = {t: next(f for f in one(t) if f < 1 << (BITS - 1)) for t in ("aa", "bb", "C1")}
    found = one("aa bb aa C1 aa")
    pairs = {("aa", "bb"): 1, ("bb", "aa"): 1, ("aa", "C1"): 1, ("C1", "aa"): 1}
    length = np.sqrt(3 + 1 + 1 + sum(pairs.values()))
    assert np.isclose(found[word["aa"]], np.sqrt(3) / length) and np.isclose(found[word["bb"]], 1 / length) and np.isclose(found[word["C1"]], 1 / length)
    assert np.isclose(sum(v * v for f, v in found.items() if f < 1 << (BITS - 1)), 1) and np.isclose(sum(v * v for f, v in found.items() if f >= 1 << (BITS - 1)), 1)


def test_language_filters_equal_exact_sets(spark):
    """Learnt n-grams against counting in dictionaries, predictions against exact sets of them."""
    from pagemill.llm import langid

    r = random.Random(3)
    stems = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "ein", "ka"], "zz": ["eau", "oui", "ment", "É"]}
    rows = []
    for i in range(150):
        lang = r.choice(list(stems))
        rows.append((i, " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 20))), lang, 0.5))
    rows += [rows[3], (3, "other text ka", "yy", 0.5), (900, None, "xx", 0.5), (901, "ka lo", None, 0.5), (None, "lo", "xx", 0.5), (902, "schung " * 30000, "yy", 0.5), (903, "", "vv", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.learn(docs, n_grams=60)
    assert {k: v.tolist() for k, v in langid.learn(docs.repartition(7), n_grams=60).items()} == {k: v.tolist() for k, v in model.items()}

    def parts(text):
        out = []
        folded = bytes(langid.FOLD[list(text.lower().encode())]) if text else b""
        for size in langid.SIZES:
            for s in range(len(folded) - size + 1):
                if folded[s : s + size].strip():
                    out.append((size, int.from_bytes(folded[s : s + size], "big") | size << (8 * size)))
        return out

    counts = {}
    for i, t, lang, _ in rows:
        if None not in (i, t, lang):
            for size, code in parts(t):
                own = counts.setdefault((lang, size), {})
                own[code] = own.get(code, 0) + 1
    shares = {}
    for (lang, size), own in counts.items():
        for code in sorted(own, key=lambda c: (-own[c], c))[:60]:
            shares[lang, code] = own[code] / sum(own.values())
    top = {}
    for (_, code), x in shares.items():
        top[code] = max(top.get(code, 0), x)
    want = {lang: {c for (own, c), x in shares.items() if own == lang and x >= 0.5 * top[c]} for lang in stems}
    assert {k: set(v.tolist()) for k, v in model.items()} == want
    names, wrong = sorted(want), 0
    for x in langid.predict(docs, model).collect():
        if not re.search(r"[^\W\d_]", x.text or ""):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        hits = [sum(code in want[name] for _, code in parts(x.text)) for name in names]
        assert hits[names.index(x.lang_pred)] == max(hits) and abs(x.score - max(hits) / max(1, sum(hits))) < 0.02
        wrong += x.lang is not None and x.lang_pred != x.lang
    assert wrong < 5


def test_neighbours_are_ranked_by_bm25(spark):
    """Statistics, weights, queries and ranks against dictionaries."""
    texts = [r[1] or "" for r in corpus(15, 40, 60) if r[0] != 207]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    found = packing.corpus_statistics(docs)
    bags = [split(t.lower()) for t in texts]
    df = {}
    for bag in bags:
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    hashed = lambda w: tx.Words(*tx.flat(pa.array([w]))).hashes()
    assert found.docs == len(texts) + 1 and np.isclose(found.mean, sum(map(len, bags)) / (len(texts) + 1)) and found.bytes == sum(len(t.encode()) for t in texts)
    assert all(found.frequency(hashed(w))[0] >= n for w, n in df.items()) and np.mean([found.frequency(hashed(w))[0] == n for w, n in df.items()]) > 0.98
    index = packing.ShardIndex(*tx.flat(pa.array(texts)), found, query_terms=5)
    unused = np.random.default_rng(1).random(len(texts)) < 0.7
    weight = {(d, w): float(found.idf(hashed(w))[0]) * bag.count(w) * 2.2 / (bag.count(w) + 1.2 * (0.25 + 0.75 * len(bag) / found.mean)) for d, bag in enumerate(bags) for w in set(bag)}
    for seed, bag in enumerate(bags):
        query = sorted((w for w in set(bag) if df[w] > 1), key=lambda w: (-weight[seed, w], int(hashed(w)[0])))[:5]
        total = {d: sum(weight.get((d, w), 0) for w in query) for d in range(len(texts)) if unused[d]}
        want = sorted((d for d, x in total.items() if x), key=lambda d: (-round(total[d], 9), d))
        got = index.neighbours(seed, unused).tolist()
        assert sorted(got) == sorted(want) and np.allclose([total[d] for d in got], [total[d] for d in want])


def test_similar_documents_meet_in_shards(spark, monkeypatch):
    """Of pairs that share half of their words, most have a key in common, wherever they lie; hot keys are cut."""
    r = random.Random(5)
    texts = []
    for i in range(300):
        own = [f"v{r.randint(0, 20000)}" for _ in range(40)]
        texts += [" ".join(own + ["the", "of"]), " ".join(own[:26] + [f"u{r.randint(0, 20000)}" for _ in range(14)] + ["the"])]
    found = packing.corpus_statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    one, two, heaps = packing.content_keys(found, *tx.flat(pa.array(texts)), 8)
    assert np.mean(one[::2] == one[1::2]) > 0.5 and np.mean((one[::2] == one[1::2]) | (two[::2] == two[1::2])) > 0.75
    assert len(np.unique(one)) > 150
    same = packing.corpus_statistics(spark.createDataFrame([("all alike",)] * 50, "text string"))
    assert (packing.content_keys(same, *tx.flat(pa.array(["all alike", "", "new"])), 8)[2] >= 32).all()


def test_gathered_tables_do_not_depend_on_batches():
    texts = ["a" * n for n in (3, 0, 9, 2, 2, 2, 30, 1, 1)] + [None]
    cuts = []
    for rows in (1, 3, 10):
        batches = pa.Table.from_pydict({"t": pa.array(texts, pa.string())}).to_batches(max_chunksize=rows)
        cuts.append([t.column("t").to_pylist() for t in tx.gathered(batches, "t", 10)])
        assert sum(cuts[-1], []) == texts
    assert cuts[0] == cuts[1] == cuts[2] and all(sum(len(x or "") for x in c) <= 10 or len(c) == 1 for c in cuts[0])


def test_radix_order_and_distinct_hashes():
    rng = np.random.default_rng(5)
    for bound in (1, 7, 65_535, 65_536, 70_000, 1 << 40):
        for n in (0, 1, 5_000):
            values = rng.integers(0, bound + 1, n)
            assert tx.stable_order(values, bound).tolist() == np.argsort(values, kind="stable").tolist()
    for n in (0, 1, 3_000):
        hashes = rng.integers(0, 200, n).astype(np.uint64)
        values, first, which = tx.distinct(hashes)
        assert values.tolist() == sorted(set(hashes.tolist()))
        assert (hashes[first] == values).all() and (values[which] == hashes).all()


def test_encoder_cache_compares_bytes_and_starts_over(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pagemill.llm import bpe

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(tokenizer)
    texts = [" ".join(f"word{k * j} Wort{k}" for j in range(30)) for k in range(40)] + ["", "it's", "été  \n naïve 日本語"]
    # hashes of four values: nearly all pre-tokens are strangers of equal hash; a small cache is emptied between the texts
    for few, cache in ((True, 400_000), (False, 50), (True, 50)):
        with monkeypatch.context() as patch:
            patch.setattr(bpe, "CACHE", cache)
            if few:
                own = tx.span_hash
                patch.setattr(tx, "span_hash", lambda *a: own(*a) & np.uint64(3))
            encoder = bpe.Encoder(tokenizer)
            for text in texts * 2:
                buf = np.frombuffer(text.encode(), np.uint8)
                ids, _ = encoder.encode(buf, np.array([0, len(buf)]))
                assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_is_kept_between_tasks(tmp_path):
    """One encoder a process and file: a second task merges nothing again; a changed file gets a new one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from pagemill.llm import bpe

    path = tmp_path / "tokenizer.json"
    path.write_bytes(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    library, text = Tokenizer.from_file(str(path)), " ".join(f"word{k} naïve'll" for k in range(300))
    buf, merged, known = np.frombuffer(text.encode(), np.uint8), [], library.encode(text, add_special_tokens=False).ids
    own = bpe.shared_encoder(str(path)).merge
    bpe.shared_encoder(str(path)).merge = lambda piece: (merged.append(piece), own(piece))[1]
    for _ in range(2):
        assert bpe.shared_encoder(str(path)).encode(buf, np.array([0, len(buf)]))[0].tolist() == known
    assert len(merged) == len(set(merged)) > 300
    path.write_bytes(path.read_bytes() + b"\n")
    assert bpe.shared_encoder(str(path)).merge(b"word") == own(b"word") and not bpe.shared_encoder(str(path)).size.n


def test_encoder_cache_grows_past_its_slots(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pagemill.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "CACHE", 3000)
    encoder = bpe.Encoder(path)
    slots = len(encoder.slots)
    for text in [" ".join(f"w{k * j}ä" for k in range(2500)) for j in range(1, 4)] + [" ".join(f"x{k}" for k in range(9000))] * 2:
        buf = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(buf, np.array([0, len(buf)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        held = encoder.slots[encoder.slots >= 0]
        assert len(np.unique(held)) == len(held) <= len(encoder.slots) // 2 + 1
    assert len(encoder.slots) > slots


def test_array_kernels_against_plain_versions():
    rng, every = np.random.default_rng(8), np.arange(256, dtype=np.uint8)
    assert (tx.lower(every) == tx.LOWER).all()
    for n in (0, 1, 2, 4_000):
        buf = rng.choice(np.array([9, 10, 13, 32, 8, 14, 31, 33, 65, 97, 200], np.uint8), n)
        off = np.r_[0, np.sort(rng.integers(0, n + 1, 40)), n]
        words = tx.Words(buf, off)
        plain = [(int(a) + m.start(), int(a) + m.end()) for a, b in zip(off, off[1:]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", buf[a:b].tobytes())]
        assert list(zip(words.starts.tolist(), words.ends.tolist())) == plain and words.counts.sum() == len(plain)
    few = rng.integers(0, 3, 3_000).astype(np.uint8)
    a, b, size = (rng.integers(0, top, 4_000) for top in (2_900, 2_900, 100))
    b[::3] = a[::3]
    size[1::3] %= 10
    raw, pair = few.tobytes(), list(zip(a.tolist(), b.tolist(), size.tolist()))
    want = [raw[x : x + z] == raw[y : y + z] for x, y, z in pair]
    assert tx.same_spans(few, a, b, size).tolist() == want
    assert tx.same_loaded(tx.load8(few), a, tx.load8(few[7:]), np.maximum(b - 7, 0), size).tolist() == [raw[x : x + z] == raw[max(y, 7) : max(y, 7) + z] for x, y, z in pair]
    by = {}
    for h, x, z in zip(tx.span_hash(few, a, a + size).tolist(), a.tolist(), size.tolist()):
        by.setdefault(raw[x : x + z], set()).add(h)
    assert all(len(h) == 1 for h in by.values()) and len(set.union(*by.values())) == len(by)
    for keys in (rng.integers(0, 5, 2_000), rng.integers(0, 1 << 63, 2_000), rng.integers(0, 50, 2_000) << 40 | rng.integers(0, 3, 2_000), np.zeros(0, int), np.array([7])):
        keys = keys.astype(np.uint64)
        assert tx.hash_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
