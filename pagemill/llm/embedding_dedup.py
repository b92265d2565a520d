"""All pairs of embeddings over a cosine threshold, by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as tx
from .components import components, join_hot
from .session import prepare, shared_checkpoint
from .vectors import get, is_whole, matrix, put, vector_rows

BAND = 6144
TILE = 1024
HOT_VECTORS = 500  # vectors of so many copies that they are broadcast, at most
EXACT_DIMS = 1024  # products of so many int8 pairs are exact in float32


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, their int8 form, its scale, and the length of what the int8 form leaves out of each row."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    return unit, small, scale, np.linalg.norm(unit - small * scale[:, None], axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :EXACT_DIMS].astype(np.float32) @ b[:, :EXACT_DIMS].astype(np.float32).T
    for d in range(EXACT_DIMS, a.shape[1], EXACT_DIMS):
        out = out.astype(np.float64) + a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def tile_pairs(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, sure) of all pairs whose cosine may be >= threshold; a and b are (codes, scales, errors).

    With u = s*q + e and |u| = 1, the product of two unit rows differs from s*s'*(q.q') by |e| + |e'| + |e||e'| at most.
    Sure pairs lie above the threshold by more than this bound, the others within it; all further pairs lie below.
    """
    (q, s, e), (r, t, f) = a, b
    near = _products(q, r)
    near *= t[None, :].astype(near.dtype)
    slack = 1e-5  # above float32 rounding of near and of the bound
    low = (threshold - slack - e * (1 + f.max()) - f.max()) / s
    i, j = np.nonzero(near >= low[:, None].astype(near.dtype))
    value, bound = near[i, j] * s[i], e[i] + f[j] + e[i] * f[j] + slack
    sure = value - bound >= threshold
    keep = sure | (np.abs(value - threshold) <= bound)
    return i[keep], j[keep], sure[keep]


def exact_cosines(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the unit rows u[x] and v[y] in double precision."""
    rows, cols = np.unique(x), np.unique(y)
    if len(rows) * len(cols) <= 16 * len(x):
        return (u[rows] @ v[cols].T)[np.searchsorted(rows, x), np.searchsorted(cols, y)]
    return np.concatenate([np.einsum("ij,ij->i", u[x[c : c + 50_000]], v[y[c : c + 50_000]]) for c in range(0, len(x), 50_000)] or [np.zeros(0)])


class Tally:
    """Link counts and local components of the points of one pair of bands."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.label, self.count = weight, np.arange(len(weight)), np.zeros(len(weight), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            n = len(self.weight)
            self.count += np.bincount(i, self.weight[j], n).astype(np.int64) + np.bincount(j, self.weight[i], n).astype(np.int64)
            apart = self.label[i] != self.label[j]
            if apart.any():
                self.label = tx.forest(n, self.label[i[apart]], self.label[j[apart]])[self.label]

    def rows(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, smallest point of its local component, links) of the points with links."""
        at = np.flatnonzero(self.count)
        least = np.full(len(point), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, point)
        return point[at], least[self.label[at]], self.count[at]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm


def _tiles(one: tuple, two: tuple | None, base: int, threshold: float):
    """tile_pairs of two bands, or of one with itself, with rows counted through both."""
    other, shift = (one, 0) if two is None else (two, base)
    for a in range(0, len(one[0]), TILE):
        for b in range(a if two is None else 0, len(other[0]), TILE):
            i, j, sure = tile_pairs(tuple(p[a : a + TILE] for p in one), tuple(p[b : b + TILE] for p in other), threshold)
            i, j = i + a, j + b + shift
            up = i < j
            yield i[up], j[up], sure[up]


def embedding_groups(rows: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept (it is the smallest id of its component).

    Every pair of rows is compared, whatever other columns say. Equal vectors are one point with a weight, so groups of
    copies cost nothing. Points are dealt into bands by hash, and only their int8 codes, scales and error bounds travel:
    each pair of bands is one task's block of tile products, and sends on a count and one link for each point that has
    links, never pairs. Points with pairs that the bounds leave open send their exact vectors to a second pass over
    those pairs. The work is quadratic in the number of distinct vectors, in blocks of bounded memory; it is spread evenly
    whatever the data.

    Null vectors, zero vectors and those with null or non-finite components link with nothing. Shorter vectors are
    filled up with zeros. Rows that share an id are vectors of their own; a null id is one id, below all others. Other
    columns are not read. An empty table gives an empty table.
    """
    prepare(rows.sparkSession)
    rows = vector_rows(rows, vec_id, embedding)
    usable = is_whole("embedding") & F.exists("embedding", lambda v: v != 0)
    points = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = shared_checkpoint(points.withColumn("point", F.monotonically_increasing_id()))
    n, dim, n_rows, most = points.agg(F.count("*"), F.max(F.size("embedding")), F.sum("weight"), F.max("weight")).first()
    bands = max(1, -(-n // BAND))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        _, q, s, e = quantise(unit_rows(matrix(pa.array(pdf["embedding"], pa.list_(pa.float64())), dim)[0]))
        return pd.DataFrame({"band": pdf["band"].iloc[:1], "blob": [put(q=q, s=s, e=e, point=pdf["point"].to_numpy(), weight=pdf["weight"].to_numpy())]})

    packed = points.withColumn("band", F.pmod(F.xxhash64("point"), F.lit(bands)).cast("int")).groupBy("band").applyInPandas(pack, "band int, blob binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    pairs = packed.select("band", "blob", other.alias("with")).select(F.least("band", "with").alias("lo"), F.greatest("band", "with").alias("hi"), "band", "blob")
    pairs = pairs.groupBy("lo", "hi").agg(F.sort_array(F.collect_list(F.struct("band", "blob"))).alias("sides"))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lo, hi = batch.column("lo")[k].as_py(), batch.column("hi")[k].as_py()
                sides = [get(s["blob"]) for s in batch.column("sides")[k].as_py()]
                if len(sides) == 1 and lo != hi:
                    continue  # the other band is empty
                point, weight = (np.concatenate([s[c] for s in sides]) for c in ("point", "weight"))
                codes = [(s["q"], s["s"], s["e"]) for s in sides]
                base, tally, need = len(sides[0]["point"]), Tally(weight), np.zeros(len(point), bool)
                for i, j, sure in _tiles(codes[0], codes[1] if lo != hi else None, base, threshold):
                    tally.add(i[sure], j[sure])
                    need[i[~sure]] = need[j[~sure]] = True
                child, root, count = tally.rows(point)
                left = np.flatnonzero(need)
                yield pa.RecordBatch.from_pydict({
                    "open": pa.array(np.r_[np.zeros(len(child), bool), np.ones(len(left), bool)]), "point": pa.array(np.r_[child, point[left]]), "root": pa.array(np.r_[root, np.full(len(left), (lo << 32) | hi)]),
                    "n": pa.array(np.r_[count, (left >= base).astype(np.int64)])})

    found = shared_checkpoint(pairs.mapInArrow(compare, "open boolean, point long, root long, n long"))
    asked = found.where("open").select("point", F.col("root").alias("pair"), F.col("n").alias("side")).join(points.select("point", "embedding", "weight"), "point")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "point"])
        unit, q, s, e = quantise(unit_rows(matrix(pa.array(pdf["embedding"], pa.list_(pa.float64())), dim)[0]))
        base, tally = int((pdf["side"] == 0).sum()), Tally(pdf["weight"].to_numpy())
        own = pdf["pair"].iloc[0] >> 32 == pdf["pair"].iloc[0] & 0xFFFFFFFF
        sides = [(q, s, e)] if own else [(q[:base], s[:base], e[:base]), (q[base:], s[base:], e[base:])]
        for i, j, sure in _tiles(sides[0], None if own else sides[1], base, threshold):
            i, j = i[~sure], j[~sure]
            near = exact_cosines(unit, unit, i, j) >= threshold if len(i) else np.zeros(0, bool)
            tally.add(i[near], j[near])
        return pd.DataFrame(dict(zip(("point", "root", "n"), tally.rows(pdf["point"].to_numpy()))))

    linked = shared_checkpoint(found.where("not open").drop("open").unionByName(asked.groupBy("pair").applyInPandas(decide, "point long, root long, n long")))
    counts = linked.groupBy("point").agg(F.sum("n").alias("n"))
    groups = components(linked.select(F.col("point").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "point")
    points = points.join(counts, "point", "left").join(groups, "point", "left").withColumn("component", F.coalesce("component", "point"))
    smallest = points.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    points = join_hot(points, smallest, ["component"], "times", n, n).select("embedding", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linkable = join_hot(rows.where(usable), points, ["embedding"], "weight", n_rows or 0, most or 0, HOT_VECTORS).select("vec_id", "n_links", "component_id")
    out = linkable.unionByName(rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    null = F.lit(tx.NULL_ID)
    return out.select(F.nullif("vec_id", null).alias("vec_id"), "n_links", F.nullif("component_id", null).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
