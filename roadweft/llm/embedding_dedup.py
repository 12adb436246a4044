"""Embedding near-dedup: a navigable small-world graph per shard, every vector asked of every shard.

Equal vectors are one class and are asked once. A search task holds one shard's graph and a block
of queries. Its beam starts narrow and is doubled until an audit, in which some queries are also
answered by a full scan, finds enough: the mean recall of the audited queries that have any link,
so that queries of large groups weigh no more than others. A query whose beam is full of links is
answered by a full scan, so that no vector has a cap on its partners. What is found is verified in
double precision. Links are counted and joined a few queries at a time; a task returns a count per
query and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.llm.columns import named
from roadweft.llm.hnsw import Index, Layer
from roadweft.operators.components import components
from roadweft.session import materialize

THRESHOLD = 0.95
MIN_SHARDS = 8
SHARD_ROWS = 1 << 16
BLOCK_ROWS = 1 << 15
BEAM = 16
AUDIT = 256
#: Mean recall that an audit asks for, and below which the audits of all tasks together are an error.
RECALL, LEAST_RECALL = 0.98, 0.9
#: Queries searched, and queries scanned in full, at a time.
SEARCHED, SCANNED = 1024, 64
#: Float32 similarities this far below the threshold are verified too.
SLACK = 1e-4

_NODE = "dim int, shard int, layer int, pos int, uid bigint, n bigint, vector array<double>, links array<int>"
_FOUND = "kind int, u bigint, v bigint, n bigint"
LINKS, EDGE, AUDITED = 0, 1, 2
MILLIONTH = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, all components finite, not all 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that squares neither vanish nor overflow."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    index = Index.build(_matrix(rows.column("vector"), dim).astype(np.float32), seed=shard + 1)
    parts = []
    for number, layer in enumerate(reversed(index.layers)):  # 0 holds all nodes
        nodes = layer.nodes if number else np.arange(len(index.vectors))
        at = pa.array(nodes, pa.int64())
        links = layer.links[nodes]
        parts.append(
            pa.table(
                {
                    "dim": pa.array(np.full(len(nodes), dim), pa.int32()),
                    "shard": pa.array(np.full(len(nodes), shard), pa.int32()),
                    "layer": pa.array(np.full(len(nodes), number), pa.int32()),
                    "pos": pa.array(nodes, pa.int32()),
                    "uid": rows.column("uid").take(at),
                    "n": rows.column("n").take(at),
                    "vector": rows.column("vector").take(at) if not number else pa.nulls(len(nodes), pa.list_(pa.float64())),
                    "links": pa.FixedSizeListArray.from_arrays(pa.array(links.ravel(), pa.int32()), links.shape[1]).cast(pa.list_(pa.int32())),
                }
            )
        )
    return pa.concat_tables([p.cast(parts[0].schema) for p in parts])


def _restore(rows: pa.Table, dim: int) -> tuple[Index, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, unit vectors, uids, counts) of a shard from its rows."""
    number = rows.column("layer").to_numpy()
    layers = []
    for k in range(int(number.max()), -1, -1):
        part = rows.filter(pa.array(number == k))
        pos = part.column("pos").to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in part.column("links").chunks]).to_numpy().reshape(len(pos), -1)
        if not k:
            order = np.argsort(pos)
            vectors = _matrix(part.column("vector"), dim)[order]
            uids, counts = part.column("uid").to_numpy()[order], part.column("n").to_numpy()[order]
        layers.append((pos, flat))
    full = []
    for pos, flat in layers:
        links = np.full((len(vectors), flat.shape[1]), -1, np.int32)
        links[pos] = flat
        full.append(Layer(pos, links))
    return Index(vectors.astype(np.float32), full), vectors, uids, counts


class Linked:
    """What a task knows of its links: how many each query has, and which queries and nodes they
    join, as labels of places: nodes first, then queries that are no node."""

    def __init__(self, index: Index, vectors: np.ndarray, counts: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float) -> None:
        self.index, self.vectors, self.counts, self.queries, self.own, self.threshold = index, vectors, counts, queries, own, threshold
        self.q32, self.floor = queries.astype(np.float32), threshold - SLACK
        self.total = np.zeros(len(queries), np.int64)
        self.place = np.where(own >= 0, own, len(vectors) + np.arange(len(queries)))
        self.label = np.arange(len(vectors) + len(queries))

    def add(self, left: np.ndarray, right: np.ndarray, sims: np.ndarray) -> None:
        """Count and join pairs (query, node) that may be links; those near the threshold are
        computed again in double precision."""
        apart = right != self.own[left]
        left, right, sims = left[apart], right[apart], sims[apart]
        close = np.flatnonzero(sims < self.threshold + SLACK)
        good = np.ones(len(left), bool)
        for a in range(0, len(close), 65536):
            some = close[a : a + 65536]
            good[some] = np.einsum("id,id->i", self.queries[left[some]], self.vectors[right[some]]) >= self.threshold
        left, right = left[good], right[good]
        self.total += np.bincount(left, self.counts[right], len(self.total)).astype(np.int64)
        a, b, label = self.place[left], right, self.label
        while True:
            x, y = label[a], label[b]
            new = x != y
            if not new.any():
                break
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        self.label = label

    def scan(self, rows: np.ndarray) -> None:
        """Add all links of some queries."""
        for a in range(0, len(rows), SCANNED):
            some = rows[a : a + SCANNED]
            sims = self.q32[some] @ self.index.vectors.T
            at = np.nonzero(sims >= self.floor)
            self.add(some[at[0]], at[1], sims[at])

    def audit(self, beam: int, sample: np.ndarray) -> tuple[int, float]:
        """(sampled queries that have a link, mean share of their links that the beam finds)."""
        ids, near = self.index.search(self.q32[sample], min(beam, len(self.vectors)))
        shares = []
        for k in range(0, len(sample), SCANNED):
            part = sample[k : k + SCANNED]
            truth = self.q32[part] @ self.index.vectors.T >= self.floor
            mine = self.own[part]
            truth[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
            found = (near[k : k + SCANNED] >= self.floor) & (ids[k : k + SCANNED] != mine[:, None])
            wide = near[k : k + SCANNED, -1] >= self.floor  # scanned in full
            every = truth.sum(1)
            shares.append(np.where(wide, 1.0, found.sum(1) / np.maximum(every, 1))[every > 0])
        shares = np.concatenate(shares) if shares else np.empty(0)
        return len(shares), float(np.minimum(shares, 1.0).mean()) if len(shares) else 1.0

    def search(self, beam: int = BEAM) -> tuple[int, float, int]:
        """Add the links of all queries; (audited queries with a link, their mean recall, beam)."""
        n = len(self.vectors)
        sample = np.linspace(0, len(self.queries) - 1, min(AUDIT, len(self.queries))).astype(int)
        linked, recall = self.audit(beam, sample)
        while recall < RECALL and beam < n:
            beam *= 2
            linked, recall = self.audit(beam, sample)
        if beam >= n:
            self.scan(np.arange(len(self.queries)))
            return linked, 1.0, n
        for a in range(0, len(self.queries), SEARCHED):
            ids, sims = self.index.search(self.q32[a : a + SEARCHED], beam)
            full = sims[:, -1] >= self.floor  # may have missed more
            at = np.nonzero((sims >= self.floor) & ~full[:, None])
            self.add(a + at[0], ids[at].astype(np.int64), sims[at])
            self.scan(a + np.flatnonzero(full))
        return linked, recall, beam


def _search(threshold: float):
    def step(key: tuple, asked: pa.Table, graph: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        empty = pa.table({"kind": pa.array([], pa.int32()), "u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not asked.num_rows or not graph.num_rows:
            return empty
        index, vectors, uids, counts = _restore(graph, dim)
        queries, names = _matrix(asked.column("vector"), dim), asked.column("uid").to_numpy()
        order = np.argsort(uids)
        at = np.minimum(np.searchsorted(uids[order], names), len(uids) - 1)
        own = np.where(uids[order][at] == names, order[at], -1)
        linked = Linked(index, vectors, counts, queries, own, threshold)
        audited, recall, beam = linked.search()
        some = np.flatnonzero(linked.total)
        every = np.concatenate([uids, np.where(own >= 0, -1, names)])
        moved = np.flatnonzero(linked.label != np.arange(len(every)))
        u, v = every[moved], every[linked.label[moved]]
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.full(len(some), LINKS), np.full(len(u), EDGE), [AUDITED]]), pa.int32()),
                "u": pa.array(np.concatenate([names[some], u, [audited]]).astype(np.int64)),
                "v": pa.array(np.concatenate([names[some], v, [round(audited * recall / MILLIONTH)]]).astype(np.int64)),
                "n": pa.array(np.concatenate([linked.total[some], np.zeros(len(u)), [beam]]).astype(np.int64)),
            }
        )

    return step


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    min_shards: int = MIN_SHARDS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row.

    Defined cases: a vector that is null, empty, zero or holds a null or non-finite component
    links with nothing and is its own component; vectors of different lengths never link; equal
    vectors link; repeated rows are vectors of their own, each counted; a row without an id is
    kept only if its component has no id at all; an empty table gives an empty result; other
    columns are not read. A task's memory is bounded by ``shard_rows`` and BLOCK_ROWS.
    """
    rows = vectors.select(named(vec_id).cast("bigint").alias("vec_id"), named(vector).cast("array<double>").alias("vector"))
    good = rows.filter(usable(F.col("vector")))
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")
    total = classes.count()
    shards, blocks = max(min_shards, -(-total // shard_rows)), max(1, -(-total // BLOCK_ROWS))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    graph = materialize(placed.groupBy("dim", "shard").applyInArrow(_build, _NODE), "graphs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = classes.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    held = graph.withColumn("block", every(blocks))
    keys = ("dim", "shard", "block")
    found = asked.select(*keys, "uid", "vector").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_search(threshold), _FOUND)
    found = materialize(found, "vector-links")
    audits = found.filter(F.col("kind") == AUDITED).agg(F.sum("u").alias("n"), F.sum("v").alias("found")).first()
    if audits["n"] and audits["found"] * MILLIONTH < LEAST_RECALL * audits["n"]:
        raise RuntimeError(f"mean recall of the audited vectors is {audits['found'] * MILLIONTH / audits['n']:.3f}")
    linked = found.filter(F.col("kind") == LINKS).groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("_links"))
    parts = components(found.filter(F.col("kind") == EDGE).select("u", "v"))
    grouped = classes.join(parts, F.col("uid") == F.col("node"), "left").withColumn("part", F.coalesce("component", "uid"))
    grouped = materialize(grouped.select("uid", "vector", "first", "n", "part"), "vector-parts")
    least = grouped.groupBy(F.col("part").alias("_part")).agg(F.min("first").alias("least"))
    known = grouped.join(linked, F.col("uid") == F.col("_u"), "left").join(least, F.col("part") == F.col("_part"))
    known = known.select(F.col("vector").alias("_vector"), (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_n"), "least")
    out = rows.join(known, F.col("vector") == F.col("_vector"), "left")
    component = F.when(F.col("_n").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
