"""Graph operators on edge tables (u, v, weight): iterative ones check in at the shared folder.

A component, a chain and a route are small next to the graph, so kernels that need a whole one run
per group (`applyInPandas`); what spans the graph (components, pruning, matching) is a bounded loop
of joins whose rounds are written tables.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.operators.components import components
from roadweft.session import Rounds, materialize

__all__ = ["chains", "clean_subgraphs", "components", "greedy_match", "largest_component", "longest_paths", "merge_points", "prune_spurs", "shortest_paths", "simplify", "with_component"]


def with_component(edges: DataFrame) -> DataFrame:
    """``edges`` with component: the smallest node of the component of u; loops alone are their own."""
    parts = components(edges.select("u", "v"))
    joined = edges.join(parts, edges["u"] == F.col("node"), "left")
    return joined.withColumn("component", F.coalesce("component", "u")).drop("node")


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component of most nodes; ties fall to the smallest node."""
    marked = materialize(with_component(edges), "marked")
    nodes = marked.select("component", F.explode(F.array("u", "v")).alias("node")).distinct()
    best = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return marked.join(F.broadcast(best.select(F.col("component").alias("_c"))), F.col("component") == F.col("_c"), "left_semi")


def _around(rows: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    around: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for u, v, w in rows[["u", "v", "weight"]].itertuples(index=False):
        around[u].append((v, w))
        around[v].append((u, w))
    return around


def _dijkstra(around: dict[int, list[tuple[int, float]]], source: int) -> dict[int, tuple[float, int | None]]:
    """(distance, node before) of every node that ``source`` reaches; of equal ways the one whose last
    run of edges of weight 0 is the shortest, then the one by the smaller node before."""
    settled: dict[int, tuple[float, int | None]] = {}
    queue: list[tuple[float, int, int, int | None]] = [(0.0, 0, source, None)]
    while queue:
        d, zeros, node, before = heapq.heappop(queue)
        if node in settled:
            continue
        settled[node] = (d, before)
        for other, w in around.get(node, ()):
            if other not in settled:
                heapq.heappush(queue, (d + w, 0 if w else zeros + 1, other, node))
    return settled


def _lightest(edges: DataFrame, *by: str) -> DataFrame:
    """Of parallel edges, in either direction, the lightest."""
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    return edges.select(*by, low, high, "weight").groupBy(*by, "u", "v").agg(F.min("weight").alias("weight"))


def _relaxed(edges: DataFrame, source: int) -> DataFrame:
    """(node, distance, before) by rounds in which the nodes that came nearer make offers to their
    neighbours; no task holds more of the graph than a join does. A way is known by its distance and
    the length of its last run of edges of weight 0. Along a way one of the two grows, so it doesn't
    close."""
    back = edges.select(F.col("v").alias("a"), F.col("u").alias("b"), "weight")
    both = materialize(edges.toDF("a", "b", "weight").unionByName(back), "arcs")
    known = fresh = edges.sparkSession.createDataFrame([(source, 0.0, 0, None)], "node bigint, distance double, zeros bigint, before bigint")
    rounds = Rounds("known")
    while True:
        way = F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.when(F.col("weight") > 0, 0).otherwise(F.col("zeros") + 1).cast("bigint").alias("zeros"), F.col("a").alias("before"))
        offers = fresh.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), way.alias("offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        old = known.select(F.col("node").alias("_n"), F.struct("distance", "zeros", "before").alias("_way"))
        nearer = F.col("_n").isNull() | (F.col("offer") < F.col("_way"))
        fresh = materialize(best.join(old, F.col("node") == F.col("_n"), "left").filter(nearer & (F.col("node") != source)).select("node", "offer.*"), "nearer")
        if fresh.isEmpty():
            return known.select("node", "distance", "before")
        known = rounds.write(known.join(fresh.select("node"), "node", "left_anti").unionByName(fresh))


def shortest_paths(edges: DataFrame, source: int, kernel_edges: int = 2_000_000) -> DataFrame:
    """(node, distance, before) from ``source`` along undirected edges of weight 0 or more; of equal
    ways the one by the smaller node before, over an edge of positive weight if there is one. A
    component of at most ``kernel_edges`` pairs is walked in one task, a larger one by rounds of
    joins, to the same result. Without edges at ``source`` nothing is found."""
    marked = materialize(with_component(edges), "marked")
    home = marked.filter((F.col("u") == source) | (F.col("v") == source)).select(F.col("component").alias("_c")).distinct()
    own = materialize(_lightest(marked.join(home, F.col("component") == F.col("_c"), "left_semi"), "component"), "own")
    if own.count() > kernel_edges:
        return _relaxed(own.drop("component"), source)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        found = _dijkstra(_around(rows), source)
        return pd.DataFrame({"node": list(found), "distance": [d for d, _ in found.values()], "before": pd.Series([b for _, b in found.values()], dtype="Int64")})

    return own.groupBy("component").applyInPandas(walk, "node bigint, distance double, before bigint")


def longest_paths(edges: DataFrame, max_nodes: int = 20) -> DataFrame:
    """(component, nodes, longest): of components of at most ``max_nodes`` nodes the longest of all
    shortest paths."""
    marked = materialize(with_component(edges), "marked")
    nodes = marked.select("component", F.explode(F.array("u", "v")).alias("node")).distinct()
    small = nodes.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("nodes")).filter(F.col("nodes") <= max_nodes)

    def longest(rows: pd.DataFrame) -> pd.DataFrame:
        around = _around(rows)
        far = max((d for s in around for d, _ in _dijkstra(around, s).values()), default=0.0)
        return pd.DataFrame({"component": [rows.component.iloc[0]], "nodes": [rows.nodes.iloc[0]], "longest": [far]})

    return _lightest(marked.join(small, F.col("component") == F.col("_c")), "component", "nodes").groupBy("component").applyInPandas(longest, "component bigint, nodes bigint, longest double")


def clean_subgraphs(edges: DataFrame, min_length: float = 300.0, max_nodes: int = 20) -> DataFrame:
    """Drop components of at most ``max_nodes`` nodes whose longest shortest path is under
    ``min_length``."""
    bad = longest_paths(edges, max_nodes).filter(F.col("longest") < min_length).select(F.col("component").alias("_c"))
    return with_component(edges).join(bad, F.col("component") == F.col("_c"), "left_anti").drop("component")


def prune_spurs(edges: DataFrame, least: float = 30.0, rounds: int = 8, rim: DataFrame | None = None) -> DataFrame:
    """Drop terminal nodes (degree 1) whose edge is shorter than ``least``, until none is left or
    after ``rounds`` rounds; then loops. Edges with an end in ``rim`` (node), the nodes near an
    image's border, stay: a road that leaves the image is no spur."""
    written = Rounds("edges")
    now = written.write(edges)
    left = now.count()
    for _ in range(rounds):
        ends = now.select(F.explode(F.array("u", "v")).alias("node"), "u", "v", "weight")
        bad = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("weight").alias("w"), F.min(F.struct("u", "v")).alias("e")).filter((F.col("degree") == 1) & (F.col("w") < least))
        if rim is not None:
            for end in ("u", "v"):
                bad = bad.join(rim.select(F.col("node").alias("_rim")).distinct(), F.col(f"e.{end}") == F.col("_rim"), "left_anti")
        bad = bad.select("node")
        kept = now.join(bad, F.col("u") == F.col("node"), "left_anti").join(bad, F.col("v") == F.col("node"), "left_anti")
        now = written.write(kept)
        n = now.count()
        if n == left:
            break
        left = n
    return now.filter("u <> v")


def _endpoints(edges: DataFrame) -> DataFrame:
    """(node, inner): inner nodes of undirected chains have two neighbours and degree two."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(((F.count(F.lit(1)) == 2) & (F.countDistinct("other") == 2) & (F.max((F.col("node") == F.col("other")).cast("int")) == 0)).alias("inner"))


def _chained(edges: DataFrame) -> DataFrame:
    """``edges`` with chain: the smallest inner node of the chain an edge belongs to, or null."""
    inner = materialize(_endpoints(edges).filter("inner").select("node"), "inner")
    a, b = inner.withColumnRenamed("node", "_a"), inner.withColumnRenamed("node", "_b")
    both = edges.join(a, F.col("u") == F.col("_a"), "left").join(b, F.col("v") == F.col("_b"), "left")
    both = materialize(both, "inner-edges")
    parts = components(both.filter("_a IS NOT NULL AND _b IS NOT NULL").select("u", "v"))
    some = F.coalesce("_a", "_b")
    return both.join(parts, some == F.col("node"), "left").withColumn("chain", F.coalesce("component", some)).drop("node", "component")


def chains(edges: DataFrame) -> DataFrame:
    """(chain, edges, inner_nodes) of every maximal run of inner nodes."""
    marked = _chained(edges).filter("chain IS NOT NULL")
    return marked.groupBy("chain").agg(F.count(F.lit(1)).alias("edges"), F.size(F.collect_set(F.coalesce("_a", "_b"))).cast("bigint").alias("inner_nodes"))


def simplify(edges: DataFrame) -> DataFrame:
    """Contract every chain to one edge between its ends, summing lengths: (u, v, length, pieces).
    A chain that closes on itself becomes a loop at its smallest node."""
    marked = _chained(edges)
    alone = marked.filter("chain IS NULL").select("u", "v", F.col("weight").alias("length"), F.lit(1).cast("bigint").alias("pieces"))
    inside = marked.filter("chain IS NOT NULL")
    outer = inside.select("chain", "weight", F.filter(F.array(F.when(F.col("_a").isNull(), F.col("u")), F.when(F.col("_b").isNull(), F.col("v"))), lambda x: x.isNotNull()).alias("ends"))
    ends = outer.groupBy("chain").agg(F.flatten(F.collect_list("ends")).alias("ends"), F.sum("weight").alias("length"), F.count(F.lit(1)).alias("pieces"))
    low = F.coalesce(F.array_min("ends"), F.col("chain"))
    return alone.unionByName(ends.select(low.alias("u"), F.coalesce(F.array_max("ends"), F.col("chain")).alias("v"), "length", "pieces"))


def greedy_match(pairs: DataFrame, kernel_pairs: int = 1_000_000) -> DataFrame:
    """One-to-one matching in ascending (d, s, e), each node used once: pairs that are the first of
    both their nodes are taken, their nodes leave, and so on; equal to taking pairs in order. Rounds
    go on while more than ``kernel_pairs`` pairs are left, and then one task takes the rest in order,
    so a long falling chain costs no round per pair. Every round takes the first pair at least."""
    written, taken = Rounds("pairs"), Rounds("matched")
    left = written.write(pairs.select("s", "e", "d"))
    matched = left.limit(0)
    while left.count() > kernel_pairs:
        rank = F.struct("d", "s", "e")
        ends = left.select(F.explode(F.array("s", "e")).alias("node"), rank.alias("r"))
        first = ends.groupBy("node").agg(F.min("r").alias("r"))
        a, b = first.select(F.col("node").alias("_a"), F.col("r").alias("_ra")), first.select(F.col("node").alias("_b"), F.col("r").alias("_rb"))
        now = left.join(a, F.col("s") == F.col("_a")).join(b, F.col("e") == F.col("_b"))
        now = materialize(now.filter((rank == F.col("_ra")) & (rank == F.col("_rb"))).select("s", "e", "d"), "taken")
        matched = taken.write(matched.unionByName(now))
        used = now.select(F.explode(F.array("s", "e")).alias("node"))
        left = written.write(left.join(used, F.col("s") == F.col("node"), "left_anti").join(used, F.col("e") == F.col("node"), "left_anti"))

    def rest(batches):
        rows = pd.concat([*batches, pd.DataFrame({"s": [], "e": [], "d": []})]).sort_values(["d", "s", "e"])
        seen: set[int] = set()
        keep = []
        for s, e in zip(rows.s, rows.e):
            keep.append(s not in seen and e not in seen)
            if keep[-1]:
                seen |= {s, e}
        yield rows[np.array(keep, bool)]

    return matched.unionByName(left.coalesce(1).mapInPandas(rest, left.schema))


def merge_points(points: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster, x, y, n): the centre of every group of linked points; lone points stay."""
    parts = components(links)
    joined = points.join(parts, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "id"))
    return joined.groupBy("cluster").agg((F.rint(F.avg("x") * 1000) / 1000).alias("x"), (F.rint(F.avg("y") * 1000) / 1000).alias("y"), F.count(F.lit(1)).alias("n"))
