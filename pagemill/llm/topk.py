"""Exact top-k inner products over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .session import prepare, shared_checkpoint
from .textops import NULL_ID
from .vectors import get, is_whole, matrix, put, vector_rows

PIVOTS = 64
ANNULUS = 2048  # vectors, or as many as keep the number of annuli near ANNULI
ANNULI = 1 << 17
QUERY_BAND = 1024
LOW = np.iinfo(np.int64).min


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by BLAS as long as doubles hold every partial sum exactly."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def kth_best(scored: np.ndarray, k: int) -> np.ndarray:
    return np.partition(scored, scored.shape[1] - k, 1)[:, -k] if scored.shape[1] >= k else np.full(len(scored), LOW)


def bounds(q: np.ndarray, apart: np.ndarray, cell: np.ndarray, near: np.ndarray, far: np.ndarray, top: np.ndarray) -> np.ndarray:
    """An upper bound of each query's scores in each annulus: vectors of norm `top` at most, between near and far from
    their pivot. From x.q = (|x|^2 + |q|^2 - |x - q|^2) / 2 and |x - q| >= |d(x, p) - d(q, p)|."""
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
    gap = np.maximum(0, np.maximum(near - apart[:, cell], apart[:, cell] - far)) * (1 - 1e-9)
    return np.minimum(norm * top, (top**2 + norm**2 - gap**2) / 2) * (1 + 1e-9) + 1


def small_ints(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x


def top_inner(rows: DataFrame, k: int = 5, every: int = 50, factor: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each vector whose id `every` divides.

    Components become floor(factor * component); the score is the integer inner product, ties go to the smaller id.

    Each vector is keyed by its nearest pivot and its distance from it, and every cell is cut into annuli of distances.
    The triangle inequality gives an annulus an upper bound for each query (see `bounds`). A query first meets its own
    annulus, where it lies; its k-th best score there is a floor. Bands of neighbouring queries then compare the floors
    with the bounds of all annuli, and only annuli that can hold something better are sent to a band. A task takes them
    by falling bound, and stops for each query once the bound is under its k-th best score so far.

    The pivots (64 rows, the first by a hash) and one row of five numbers an annulus are broadcast; annuli grow with the
    table, so there are about ANNULI at most.

    Vectors that are null or hold null or non-finite components take no part; shorter ones are filled up with zeros.
    Rows that share an id are vectors of their own, as queries too. A null id is no query, sorts before all other ids and
    is returned as null. Empty tables, and queries without candidates, give no rows.
    """
    spark = prepare(rows.sparkSession)
    rows = vector_rows(rows, vec_id, embedding).where(is_whole("embedding"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", lambda v: F.floor(v * factor)).alias("x"))
    rows = shared_checkpoint(rows)
    dim, n = rows.agg(F.max(F.size("x")), F.count("*")).first()
    dim, size = dim or 1, max(ANNULUS, -(-n // ANNULI))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(PIVOTS).collect()
    pivots = np.zeros((len(chosen), dim), np.int64)
    for i, r in enumerate(chosen):
        pivots[i, : len(r.x)] = r.x
    pivot_rows = np.array([r.row for r in chosen], np.int64)

    def integers(column) -> np.ndarray:
        return matrix(column, dim)[0].astype(np.int64)

    def place(batches):
        for batch in batches:
            apart = distances(integers(batch.column("x")), pivots)
            cell = apart.argmin(1)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell.astype(np.int32)), "d": pa.array(apart[np.arange(len(cell)), cell]), "row": batch.column("row"), "vec_id": batch.column("vec_id"), "x": batch.column("x")})

    def annulus(parts):
        cell = int(parts[0][0][0])
        _, d, row, vec, x = (np.concatenate(p) for p in zip(*parts))
        asks = np.flatnonzero((vec != NULL_ID) & (vec % every == 0))
        floor = np.full(len(asks), LOW)
        for lo in range(0, len(asks), 256):
            own = asks[lo : lo + 256]
            for others, other_rows in ((x, row), (pivots, pivot_rows)):
                s = scores(x[own], others)
                s[other_rows[None, :] == row[own][:, None]] = LOW
                floor[lo : lo + 256] = np.maximum(floor[lo : lo + 256], kth_best(s, k))
        queries = put(x=small_ints(x[asks]), id=vec[asks], row=row[asks], floor=floor) if len(asks) else None
        return pa.RecordBatch.from_pydict({
            "cell": pa.array([cell], pa.int32()), "near": pa.array([d[0]]), "far": pa.array([d[-1]]), "norm": pa.array([float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))]),
            "blob": pa.array([put(x=small_ints(x), id=vec, row=row)], pa.binary()), "asked": pa.array([len(asks)], pa.int64()), "queries": pa.array([queries], pa.binary())})

    def annuli(batches):
        held, count = [], 0
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            columns = (cell, batch.column("d").to_numpy(), batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), integers(batch.column("x")))
            lo = 0
            while lo < len(cell):
                if held and (held[0][0][0] != cell[lo] or count >= size):
                    yield annulus(held)
                    held, count = [], 0
                hi = min(int(np.searchsorted(cell, cell[lo], "right")), lo + size - count)
                held.append(tuple(c[lo:hi] for c in columns))
                count, lo = count + hi - lo, hi
        if held:
            yield annulus(held)

    placed = rows.mapInArrow(place, "cell int, d double, row long, vec_id long, x array<bigint>")
    index = placed.repartitionByRange("cell", "d", "row").sortWithinPartitions("cell", "d", "row").mapInArrow(annuli, "cell int, near double, far double, norm double, blob binary, asked long, queries binary")
    index = shared_checkpoint(index.withColumn("annulus", F.monotonically_increasing_id()))
    known = index.select("annulus", "cell", "near", "far", "norm").toArrow()
    meta = spark.sparkContext.broadcast([known.column(c).to_numpy() for c in ("annulus", "cell", "near", "far", "norm")])  # bounded by ANNULI
    n_bands = max(1, -(-(index.agg(F.sum("asked")).first()[0] or 0) // QUERY_BAND))

    def gather(batches):
        from pyspark import TaskContext

        held, number = [], TaskContext.get().partitionId() << 32
        for batch in batches:
            for blob in batch.column("queries").to_pylist():
                held.append(get(blob))
                if sum(len(h["id"]) for h in held) >= QUERY_BAND:
                    yield band(number, held)
                    held, number = [], number + 1
        if held:
            yield band(number, held)

    def band(number, held):
        own = {c: np.concatenate([h[c].astype(np.int64) for h in held]) for c in ("x", "id", "row", "floor")}
        ids, cell, near, far, top = meta.value
        apart, needed = distances(own["x"], pivots), []
        for lo in range(0, len(ids), 4096):
            o = slice(lo, lo + 4096)
            needed.append(ids[o][(bounds(own["x"], apart, cell[o], near[o], far[o], top[o]) >= own["floor"][:, None]).any(0)])
        return pa.RecordBatch.from_pydict({"band": pa.array([number]), "queries": pa.array([put(**own | {"x": small_ints(own["x"])})], pa.binary()), "needed": pa.array([np.concatenate(needed)], pa.list_(pa.int64()))})

    bands = index.where("asked > 0").select("cell", "near", "queries").repartitionByRange(n_bands, "cell", "near").sortWithinPartitions("cell", "near")
    bands = shared_checkpoint(bands.select("queries").mapInArrow(gather, "band long, queries binary, needed array<bigint>"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = max(1, parts // n_bands)  # so many tasks share a band's annuli
    wanted = bands.select("band", F.explode("needed").alias("annulus")).join(index.select("annulus", "cell", "near", "far", "norm", "blob"), "annulus")
    pieces = wanted.withColumn("share", F.pmod(F.xxhash64("annulus"), F.lit(spread)).cast("int")).drop("annulus").unionByName(
        bands.select("band", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share"), F.lit(-1).alias("cell"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"), F.lit(0.0).alias("norm"), F.col("queries").alias("blob")))
    pieces = pieces.repartition(parts, "band", "share").sortWithinPartitions("band", "share", "cell", "near")

    def search(batches):
        for _, group in _groups(batches):
            yield best(get(group[0]["blob"]), group[1:])

    def best(asked, blocks):
        q, own, floor = asked["x"].astype(np.int64), asked["row"], asked["floor"].copy()
        near, far, top = (np.array([b[c] for b in blocks], float) for c in ("near", "far", "norm"))
        bound = bounds(q, distances(q, pivots), np.array([b["cell"] for b in blocks], int), near, far, top)
        ids, vals = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
        for b in np.argsort(-(bound - asked["floor"][:, None].astype(float)).max(0), kind="stable") if blocks else []:
            live = np.flatnonzero(bound[:, b] >= floor)
            if not len(live):
                continue
            block = get(blocks[b]["blob"])
            s = scores(q[live], block["x"].astype(np.int64))
            s[block["row"][None, :] == own[live][:, None]] = LOW
            fresh_ids, fresh = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), LOW)
            for at, line in zip(live, s):
                cut = np.flatnonzero((line > LOW) & (line >= max(floor[at], np.partition(line, -k)[-k] if len(line) > k else LOW)))
                o = cut[np.lexsort((block["id"][cut], -line[cut]))[:k]]
                fresh_ids[at, : len(o)], fresh[at, : len(o)] = block["id"][o], line[o]
            ids, vals = np.concatenate([ids, fresh_ids], 1), np.concatenate([vals, fresh], 1)
            order = np.lexsort((ids, ~vals), axis=1)[:, :k]  # ~v falls as v grows, without overflow
            ids, vals = np.take_along_axis(ids, order, 1), np.take_along_axis(vals, order, 1)
            if vals.shape[1] == k:
                floor = np.maximum(floor, vals[:, -1])
        real = vals > LOW
        times = real.sum(1)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(asked["id"], times)), "row": pa.array(np.repeat(own, times)), "vec_id": pa.array(ids[real]), "score": pa.array(vals[real])})

    found = pieces.mapInArrow(search, "query_id long, row long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NULL_ID)).alias("vec_id"), "score")


def _groups(batches):
    """Rows of equal (band, share), one group at a time, from sorted batches; a band's queries (cell -1) come first."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["band"], row["share"]) != key:
                if rows:
                    yield key, rows
                key, rows = (row["band"], row["share"]), []
            rows.append(row)
    if rows:
        yield key, rows
