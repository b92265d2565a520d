"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .session import shared_checkpoint


HOT_ROWS, HOT_KEYS = 1024, 10_000


def join_hot(rows: DataFrame, once: DataFrame, by: list[str], times: str, n_rows: int, most_times: int, most: int = HOT_KEYS) -> DataFrame:
    """rows joined with `once` on `by`, where `once` has each key once and says in `times` how many rows have it.

    Rows of a key with n_rows / most rows or more stay where they are and get their match by broadcast: there are `most`
    such keys at most, whatever the input. Only the others are dealt out by key, so none of them fills a task. Without
    such a key (most_times is the largest of `times`) all are.
    """
    limit = max(HOT_ROWS, n_rows // most)
    if most_times < limit:
        return rows.join(once.drop(times), by)
    hot = F.broadcast(once.where(F.col(times) >= limit).drop(times))
    cold = rows.join(hot.select(by), by, "left_anti").join(once.where(F.col(times) < limit).drop(times), by)
    return rows.join(hot, by).unionByName(cold)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links (a, b); the component is its smallest member.

    Every round points nodes at smaller neighbours with aggregations and joins on the node; nodes with many neighbours
    do not travel to one task (see join_hot), so no component is ever gathered in one place. Rounds end once all links
    lead straight to a root. Loops and repeated links are harmless.
    """
    edges = shared_checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        n_edges, most_times, settled = _state(edges)
        if settled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        ends = edges.select("u", "v", F.lit(0).alias("as_v")).union(edges.select("v", "u", F.lit(1)))
        low = ends.groupBy("u").agg(F.min("v").alias("m"), F.sum("as_v").alias("times"))
        low = low.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "times").where("times > 0")
        large = join_hot(edges, low, ["v"], "times", n_edges, most_times).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x"))
        edges = shared_checkpoint(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct())
    raise RuntimeError(f"components not settled in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """How many edges there are, how many one node has as their smaller end at most, and whether each node has one parent
    and no parent has one."""
    seen = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = seen.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    unsettled = F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    n_edges, most_times, more = per.agg(F.sum("up"), F.max("down"), unsettled).first()
    return n_edges or 0, most_times or 0, not more
