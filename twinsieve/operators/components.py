"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import drop_materialised, materialise, ship_package

#: A node with more than this part of all edges is a hub: there are at most 2 * HUBS of them.
HUBS = 400


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``u, v, m``: each edge with the least ``v`` of its ``u``. The rows of hubs, which are
    few by their definition, meet a broadcast and are not shuffled to one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    limit = total / HUBS
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return others.unionByName(edges.join(hubs, "u"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both, 2 * total).where("v > u")
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the least of them."""
    met = _with_least(edges, total)
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(met.select("u", F.col("m").alias("v"))).distinct()


def _merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges, which one task has."""
    top: dict = {}

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def seen(x):
        top.setdefault(x, x)
        return root(x)

    kind = None
    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            low, high = sorted((seen(u), seen(v)))
            top[high] = low
    if top:
        nodes = list(top)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "comp"])


def connected_components(edges: DataFrame, left: str, right: str, *, max_rounds: int = 100, one_task: int = 0) -> DataFrame:
    """``node, comp`` for each node that has an edge; ``comp`` is the least node reachable.

    If there are no more than ``one_task`` edges (they are counted), one task merges them all;
    the result is the same.

    Ids may be of any orderable type. Edges with a null end and loops are ignored. Each
    round is a few keyed shuffles of the edges, written to the shared folder; the rounds
    grow with the logarithm of the longest path. No task holds a whole component, and none
    all edges of a hub.
    """
    now = materialise(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left), F.col(right))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct(),
        "components",
    )
    total, mark = now.count(), None
    if total <= one_task:
        ship_package(now.sparkSession)
        kind = dict(now.dtypes)["u"]
        return now.coalesce(1).mapInArrow(_merge_all, f"node {kind}, comp {kind}")
    for _ in range(max_rounds):
        pulled = materialise(_large_star(now, total), "components")
        stars = materialise(_small_star(pulled, total), "components")
        drop_materialised(now)
        drop_materialised(pulled)
        now = stars
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        mark, total = seen, seen[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merged_components(labels: DataFrame, links: DataFrame, left: str, right: str) -> DataFrame:
    """``labels`` (``node, comp``) after further links: only the links between different
    components are contracted. Nodes without a label are components of their own."""
    known = lambda end, name: labels.select(F.col("node").alias(end), F.col("comp").alias(name))
    ends = links.select(left, right).join(known(left, "c1"), left, "left").join(known(right, "c2"), right, "left")
    ends = ends.select(F.coalesce("c1", left).alias("c1"), F.coalesce("c2", right).alias("c2")).where("c1 <> c2")
    tops = connected_components(ends, "c1", "c2").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    fresh = tops.select(F.col("comp").alias("node")).join(labels.select("node"), "node", "left_anti")
    every = labels.select("node", "comp").unionByName(fresh.select("node", F.col("node").alias("comp")))
    return every.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
