"""Connected components of any size: a forest per partition, then alternating stars.

Every partition first replaces its edges by a spanning forest of them. What is left is joined in
one task where it is at most LOCAL_EDGES edges, a checked size; else stars are formed until it is,
or until they settle. Large stars hang a node's larger neighbours on its smallest one, small stars the smaller ones;
both keep connectivity, and after a few rounds every node hangs on its component's smallest node.
Each star is a partial minimum and an equi-join, so a hub's edges are pre-aggregated map-side and
split by adaptive execution. Every round is a written table in the shared folder, which takes the
place of the one before. The driver sees a count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.session import Rounds, materialize

MAX_ROUNDS = 60
#: Edges that one task joins, two numbers each.
LOCAL_EDGES = 1_000_000


def labelled(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct nodes of the edges, smallest node of each one's component). Roots are hung on
    smaller roots and paths cut short until no edge joins two components."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smaller root) with the same components as the edges."""
    nodes, root = labelled(left, right)
    hung = root != nodes
    return nodes[hung], root[hung]


def _ends(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    if not batches:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("u", "v"))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of runs of about LOCAL_EDGES edges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LOCAL_EDGES:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*_ends(held))], ["u", "v"])
            held = []
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*_ends(held))], ["u", "v"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in labelled(*_ends(list(batches)))], ["node", "component"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("_m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    hung = edges.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return hung.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node u to the smaller v, without loops."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: bigint) that has an edge to another,
    component being the smallest node reachable. Loops and repeats do no harm; nulls are ignored; no
    edges give no rows."""
    rounds = Rounds("components")
    plain = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).filter("u <> v")
    now = rounds.write(plain.mapInArrow(_forests, "u bigint, v bigint"))
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= local_edges or mark == before:
            break
        before = mark
        now = rounds.write(_down(_small(_down(_large(now)))))
    else:
        raise RuntimeError("components did not settle")
    if mark[0] <= local_edges:
        found = now.coalesce(1).mapInArrow(_joined, "node bigint, component bigint")
    else:
        leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        found = leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return materialize(found, "parts")


class Union:
    """Union-find over positions, for links within one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
