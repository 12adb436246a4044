"""Graph queries see every row of their tables."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from roadweft.operators import graph as operators
from roadweft.plans import registry
from test_operators import brute_parts


@pytest.fixture(scope="module")
def edges(sf_dir):
    orders = duckdb.connect().execute(f"SELECT o_orderkey, o_totalprice FROM '{sf_dir}/orders.parquet'").fetchall()
    return [(k, (7 * k + 3) % len(orders), w) for k, w in orders]


@pytest.fixture(scope="module")
def parts(edges):
    return brute_parts(edges)


def found(spark, sf_dir, name):
    return [tuple(r) for r in registry.queries()[name](spark, sf_dir).collect()]


def test_components_of_all_orders(spark, sf_dir, edges, parts):
    assert dict(found(spark, sf_dir, "gr_cc")) == {n: c for n, c in parts.items()}
    best = min(Counter(parts.values()).items(), key=lambda c: (-c[1], c[0]))[0]
    assert sorted(found(spark, sf_dir, "gr_largest_cc")) == sorted((u, v) for u, v, _ in edges if parts[u] == best)


def test_small_components_of_all_orders(spark, sf_dir, edges, parts):
    sizes, far = Counter(parts.values()), Counter()
    around = {}
    for u, v, w in edges:
        around.setdefault(u, []).append((v, w))
        around.setdefault(v, []).append((u, w))
    small = {c for c, n in sizes.items() if n <= 20}
    for n, c in parts.items():
        if c in small:
            far[c] = max(far[c], *(d for d, _ in operators._dijkstra(around, n).values()))
    assert {c: (n, d) for c, n, d in found(spark, sf_dir, "gr_apsp")} == {c: (sizes[c], pytest.approx(far[c], abs=1e-3)) for c in small}
    assert sorted(found(spark, sf_dir, "gr_clean_sub")) == sorted((u, v) for u, v, _ in edges if not (parts[u] in small and far[parts[u]] < 400_000))


def test_chains_of_all_orders(spark, sf_dir, edges):
    simple = found(spark, sf_dir, "gr_simplify")
    assert sum(r[3] for r in simple) == len(edges)
    assert sum(r[2] for r in simple) == pytest.approx(sum(e[2] for e in edges), abs=1)
    # the table is a permutation of the keys, so all of it is rings: no spur, and no edge outside a chain but in rings of two
    assert sorted(found(spark, sf_dir, "gr_prune_spur")) == sorted(edges)
    back = {(v, u) for u, v, _ in edges}
    assert sum(r[1] for r in found(spark, sf_dir, "gr_paths")) == sum((u, v) not in back for u, v, _ in edges)


def test_points_of_all_orders(spark, sf_dir, edges):
    at = {k: (1301 * (k // 1500) + 37 * k % 1301, 91 * k % 1297) for k, *_ in edges}
    near = {(a, b): math.dist(at[a], at[b]) for a in at for b in at if a < b}
    near = {p: d for p, d in near.items() if 0 < d < 80 and d != 24}
    assert {(s, e) for s, e, *_ in found(spark, sf_dir, "join_proximity")} == set(near)
    used, truth = set(), set()
    for _, s, e in sorted((round(d, 6), *p) for p, d in near.items()):
        if not {s, e} & used:
            used |= {s, e}
            truth.add((s, e))
    assert set(found(spark, sf_dir, "topk_greedy_match")) == truth
    clusters = found(spark, sf_dir, "gr_clean_intersect")
    linked = brute_parts([p for p, d in near.items() if d < 30])
    assert {c: n for c, _, _, n in clusters} == Counter(linked.get(k, k) for k in at)


def images(sf_dir, side):
    """Images by (image_x, image_y), NaN where there is no pixel."""
    out = {}
    for x, y, v in duckdb.connect().execute(f"SELECT l_partkey, l_suppkey, max(l_quantity) FROM '{sf_dir}/lineitem.parquet' GROUP BY ALL").fetchall():
        out.setdefault((x // side, y // side), np.full((side, side), np.nan))[x % side, y % side] = v
    return out


def pixels(made, start=0):
    return {(*at, int(x) + start, int(y) + start, v[x, y]) for at, v in made.items() for x, y in zip(*np.nonzero(~np.isnan(v)), strict=True)}


def test_pad_of_all_images(spark, sf_dir):
    truth = pixels({at: np.pad(v, 8, mode="symmetric") for at, v in images(sf_dir, 64).items()}, -8)
    rows = registry.queries()["tf_pad"](spark, sf_dir).select("image_x", "image_y", "x", "y", "v").collect()
    assert len(rows) == len(truth) and set(map(tuple, rows)) == truth


def test_cut_border_of_all_images(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has no pixel inside the border
    truth = pixels({at: v[22:-22, 22:-22] for at, v in images(sf_dir, 1000).items()})
    rows = registry.queries()["tf_cut_border"](spark, sf_dir).select("image_x", "image_y", "x", "y", "v").collect()
    assert {r.image_x for r in rows} == {0, 1} and set(map(tuple, rows)) == truth


def test_route_along_all_nodes(spark, sf_dir, edges):
    nodes = sorted(e[0] for e in edges)
    rows = registry.queries()["gr_route_coords"](spark, sf_dir).select("node", "x0", "x1").collect()
    at = {k: -115 + 0.001 * (k % 777) for k in nodes}
    assert {(r.node, round(r.x0, 6), round(r.x1, 6)) for r in rows} == {(a, round(at[a], 6), round(at[b], 6)) for a, b in zip(nodes, nodes[1:])}
