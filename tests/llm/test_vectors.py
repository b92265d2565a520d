import numpy as np
import pytest

from pagemill.llm import embedding_dedup, topk
from pagemill.llm.embedding_dedup import embedding_groups
from pagemill.llm.topk import top_inner

SCHEMA = "vec_id long, embedding array<float>, label int, n long, node string"


def planted():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base[:12] + rng.normal(size=(12, 24)) * 0.25, np.repeat(base[3:4], 30, 0) + rng.normal(size=(30, 24)) * 0.3, np.repeat(base[7:8], 9, 0) * 2, base[:5] * 1e-30])
    rows = [(int(i), [float(np.float32(v)) for v in r], 0, 1, "x") for i, r in zip(rng.permutation(len(x) * 3)[: len(x)], x)]
    odd = [(1001, None, 0, 1, None), (1002, [0.0] * 24, 0, 1, "x"), (1003, [float("nan")] * 24, 0, 1, "x"), (1004, [None] * 24, 0, 1, "x"), (1005, [], 0, 1, "x"), (1006, [float("inf")] * 24, None, None, "x")]
    return rows + odd


def brute_groups(rows, threshold):
    ids = sorted(r[0] for r in rows)
    vec = {r[0]: np.array(r[1], float) for r in rows if r[1] and all(v is not None for v in r[1]) and np.isfinite(np.array(r[1], float)).all() and any(r[1])}
    links = {i: set() for i in ids}
    for i in vec:
        for j in vec:
            if i != j and vec[i] / np.linalg.norm(vec[i]) @ (vec[j] / np.linalg.norm(vec[j])) >= threshold:
                links[i].add(j)
    root = {}
    for i in ids:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[i] = min(seen)
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("band,tile", [(6144, 1024), (17, 5)])
def test_embedding_groups_equal_brute_force(spark, monkeypatch, band, tile):
    monkeypatch.setattr(embedding_dedup, "BAND", band)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = planted()
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA), 0.9).collect()
    want = brute_groups(rows, 0.9)
    assert sum(w[0] for w in want.values()) > 100
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want and len(got) == len(want)


def test_embedding_groups_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_groups(empty).columns == ["vec_id", "n_links", "component_id", "kept"] and embedding_groups(empty).count() == 0
    rows = [(None, [1.0, 0.0], 0, 1, "x"), (4, [1.0, 0.0], 0, 1, "x"), (4, [1.0, 0.0], 0, 1, "x"), (5, [2.0], 0, 1, "x")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(4, 3, None, False), (4, 3, None, False), (5, 3, None, False), (None, 3, None, True)]
    rows = [(3, [1.0, 0.0], 0, 1, "x"), (3, [0.0, 1.0], 0, 1, "x"), (8, [0.0, 2.0], 0, 1, "x"), (None, None, 0, 1, "x"), (None, [-1.0, 0.0], 0, 1, "x"), (9, [-1.0, 0.0], 0, 1, "x")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(3, 0, 3, True), (3, 1, 3, True), (8, 1, 3, False), (9, 1, None, False), (None, 0, None, True), (None, 1, None, True)]


def test_exact_vectors_decide_what_the_bounds_leave_open(spark, monkeypatch):
    """Pairs a hair's breadth on both sides of the threshold, and copies that are joined by broadcast."""
    from pagemill.llm import components

    monkeypatch.setattr(embedding_dedup, "BAND", 40)
    monkeypatch.setattr(components, "HOT_ROWS", 5)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        u, v = rng.normal(size=(2, 16))
        u /= np.linalg.norm(u)
        v -= v @ u * u
        v /= np.linalg.norm(v)
        c = 0.9 + (1e-6 if i % 2 else -1e-6)
        rows += [(2 * i, u.tolist(), 0, 1, "x"), (2 * i + 1, (c * u + np.sqrt(1 - c * c) * v).tolist(), 0, 1, "x")]
    rows += [(200 + k, rows[0][1], 0, 1, "x") for k in range(20)]
    schema = SCHEMA.replace("float", "double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(spark.createDataFrame(rows, schema), 0.9).collect()}
    want = brute_groups(rows, 0.9)
    assert got == want and sum(want[2 * i + 1][1] == 2 * i for i in range(60)) >= 30


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 70))
    unit, small, scale, left = embedding_dedup.quantise(x)
    near = (small.astype(float) @ small.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(near - unit @ unit.T) <= left[:, None] + left + left[:, None] * left + 1e-12).all()


@pytest.mark.parametrize("annulus,band", [(2048, 1024), (7, 3)])
def test_top_inner_equals_brute_force(spark, monkeypatch, annulus, band):
    monkeypatch.setattr(topk, "ANNULUS", annulus)
    monkeypatch.setattr(topk, "QUERY_BAND", band)
    rows = planted()
    good = {r[0]: np.floor(256 * np.array(r[1], float)).astype(int) for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])}
    want = []
    for q in good:
        if q % 10 == 0 and len(good[q]):
            best = sorted((-int(good[q] @ v) if len(v) else 0, i) for i, v in good.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_inner(spark.createDataFrame(rows, SCHEMA), every=10).collect()]
    if any(q % 10 == 0 and not len(v) for q, v in good.items()):
        got = [g for g in got if len(good[g[0]])]
    assert sorted(got) == sorted(want)


def test_top_inner_small_tables(spark):
    assert top_inner(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0, 2.0], 0, 1, "x"), (0, [1.0, 2.0], 0, 1, "x"), (None, [1.0], 0, 1, "x"), (7, [1.0, 2.0], 0, 1, "x")]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_inner(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert sorted(got, key=str) == sorted([(0, 1, 0, 65536 * 5), (0, 2, 7, 65536 * 5), (0, 3, None, 65536)] * 2, key=str)


def test_bounds_of_annuli_hold():
    """No score in an annulus is above its bound."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12)) * 4
    x = np.floor(256 * (centres[rng.integers(0, 8, 800)] + rng.normal(size=(800, 12)) * 0.05)).astype(np.int64)
    q, pivots = x[:40], x[100:164]
    apart, own = topk.distances(x, pivots), topk.distances(q, pivots)
    cell = apart.argmin(1)
    for p in range(64):
        inside = x[cell == p]
        if len(inside):
            d = apart[cell == p, p]
            top = np.sqrt((inside.astype(float) ** 2).sum(1).max())
            limit = topk.bounds(q, own, np.array([p]), np.array([d.min()]), np.array([d.max()]), np.array([top]))[:, 0]
            assert (limit >= (q @ inside.T).max(1)).all()
