"""Operators of the engine against the oracle, brute force and hand-made goldens."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweft.operators import graph, kernels
from roadweft.plans import dual, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, sf_dir, name):
    assert rows(registry.queries()[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_macros():
    assert dual.render("SELECT @rint(f(a, ','))", dual.DUCK) == "SELECT round_even(f(a, ','), 0)"


def brute_parts(edges):
    nodes = {n for e in edges for n in e[:2]}
    part = {n: n for n in nodes}
    while True:
        new = dict(part)
        for u, v, *_ in edges:
            low = min(new[u], new[v])
            new[u] = new[v] = low
        if new == part:
            return part
        part = new


@pytest.fixture(scope="module")
def some_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 50))) for _ in range(45)]
    return edges, spark.createDataFrame(edges, "u bigint, v bigint, weight double")


def test_components(some_edges):
    edges, df = some_edges
    found = {r.node: r.component for r in graph.components(df.select("u", "v")).collect()}
    truth = brute_parts(edges)
    assert found == {n: c for n, c in truth.items() if n in found}
    assert {n for e in edges if e[0] != e[1] for n in e[:2]} == set(found)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_shortest_paths(some_edges):
    edges, df = some_edges
    source = edges[0][0]
    dist = {source: 0.0}
    for _ in range(100):
        for u, v, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in dist and dist[a] + w < dist.get(b, 1e18):
                    dist[b] = dist[a] + w
    assert {r.node: r.distance for r in graph.shortest_paths(df, source).collect()} == dist


def test_shortest_paths_by_rounds(spark):
    edges = [(1, 2, 4.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 2.0), (2, 4, 1.0), (3, 4, 2.0), (4, 4, 1.0), (8, 9, 1.0)]
    df = spark.createDataFrame(edges, "u bigint, v bigint, weight double")
    want = {(1, 0.0, None), (3, 1.0, 1), (2, 2.0, 3), (4, 3.0, 2)}
    for kernel_edges in (0, 100):
        assert {tuple(r) for r in graph.shortest_paths(df, 1, kernel_edges).select("node", "distance", "before").collect()} == want
    assert graph.shortest_paths(df, 77).count() == 0


def test_prune_spurs(some_edges):
    edges, df = some_edges
    now = [e for e in edges if e[0] != e[1]]
    for _ in range(8):
        degree = {}
        for u, v, _w in now:
            degree[u] = degree.get(u, 0) + 1
            degree[v] = degree.get(v, 0) + 1
        bad = {n for u, v, w in now for n in (u, v) if degree[n] == 1 and w < 30}
        now = [e for e in now if not bad & set(e[:2])]
    assert sorted(map(tuple, graph.prune_spurs(df, 30.0).collect())) == sorted(now)


def test_simplify_keeps_length(some_edges):
    edges, df = some_edges
    simple = graph.simplify(df).collect()
    assert sum(r.length for r in simple) == pytest.approx(sum(e[2] for e in edges))
    assert sum(r.pieces for r in simple) == len(edges)


def test_chain_contracts(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "u bigint, v bigint, weight double")
    assert [tuple(r) for r in graph.simplify(path).collect()] == [(0, 6, 6.0, 6)]


def test_clean_subgraphs(spark):
    small = [(i, i + 1, 1.0) for i in range(19)]
    large = [(100 + i, 101 + i, 1.0) for i in range(20)]
    df = spark.createDataFrame(small + large, "u bigint, v bigint, weight double")
    assert graph.clean_subgraphs(df, 300.0, 20).agg(F.min("u")).first()[0] == 100


def test_greedy_match(spark):
    rng = random.Random(1)
    pairs = [(a, b, float(rng.randrange(20))) for a in range(15) for b in range(a + 1, 15) if rng.random() < 0.4]
    used, truth = set(), set()
    for s, e, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if not {s, e} & used:
            used |= {s, e}
            truth.add((s, e))
    assert {(r.s, r.e) for r in graph.greedy_match(spark.createDataFrame(pairs, "s bigint, e bigint, d double")).collect()} == truth


def test_plus_has_four_edges():
    image = np.zeros((9, 9), np.uint8)
    image[4, 1:8] = image[1:8, 4] = 1
    nodes, edges = kernels.skeleton_graph(image)
    assert (len(nodes), len(edges)) == (5, 4)


def test_ring_has_no_nodes():
    image = np.zeros((9, 9), np.uint8)
    image[2, 3:6] = image[6, 3:6] = image[3:6, 2] = image[3:6, 6] = 1
    assert kernels.skeleton_graph(image) == ([], [])


def test_thinning_keeps_a_line():
    image = np.zeros((11, 30), np.uint8)
    image[3:8, 3:27] = 1
    thin = kernels.thin(image)
    assert 0 < thin.sum() <= 24 and thin.sum(0).max() == 1


def test_split_point_at_epsilon_stays():
    assert len(kernels.simplify_line(np.array([[0.0, 0], [1, 1], [2, 0]]), 1.0)) == 3
    assert len(kernels.simplify_line(np.array([[0.0, 0], [1, 0.9], [2, 0]]), 1.0)) == 2


def test_areas_and_holes():
    image = np.zeros((20, 20), np.uint8)
    image[1:3, 1:3] = 1
    image[5:18, 5:18] = 1
    image[8:10, 8:10] = 0
    opened = kernels.open_areas(image, 10)
    assert opened[1, 1] == 0 and opened[8, 8] == 1 and opened.sum() == 13 * 13


def test_blur_keeps_a_constant():
    assert np.allclose(kernels.blur(np.full((12, 12), 7.0)), 7.0)


def test_areas_are_numbered_by_their_first_pixel():
    mask = np.array([[0, 1, 0, 1], [1, 0, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]])
    assert kernels.areas(mask).tolist() == [[0, 1, 0, 2], [3, 0, 0, 2], [0, 0, 0, 0], [4, 4, 0, 5]]
    assert kernels.areas(mask, corners=True).tolist() == [[0, 1, 0, 2], [1, 0, 0, 2], [0, 0, 0, 0], [3, 3, 0, 4]]
    assert not kernels.areas(np.zeros((2, 3))).any()


def test_medial_axis():
    mask = np.zeros((7, 7), int)
    mask[1:6, 2:5] = 1
    ridge = np.array([[0, 0, 0, 0, 0, 0, 0], [0, 0, 1, 0, 1, 0, 0], [0, 0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0], [0, 0, 1, 0, 1, 0, 0], [0, 0, 0, 0, 0, 0, 0]])
    assert (kernels.medial_axis(mask) == ridge).all()
    rng = np.random.default_rng(0)
    for _ in range(10):  # areas and holes stay
        mask = kernels.dilate((rng.random((40, 40)) > 0.96).astype(int), 5)
        axis = kernels.medial_axis(mask)
        assert kernels.areas(mask, True).max() == kernels.areas(axis, True).max() and (axis <= mask).all()
        assert kernels.areas(1 - np.pad(mask, 1)).max() == kernels.areas(1 - np.pad(axis, 1)).max()


def test_distances():
    rng = np.random.default_rng(1)
    mask = (rng.random((12, 17)) > 0.3).astype(int)
    off = np.argwhere(mask == 0)
    assert np.allclose(kernels.distances(mask), [[np.sqrt(((off - [y, x]) ** 2).sum(1).min()) for x in range(17)] for y in range(12)])


def test_paths_by_rounds_are_those_of_one_task_also_for_zero_weights(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(25), rng.randrange(25), float(rng.choice([0, 0, 1, 2, 5]))) for _ in range(40)] + [(0, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0)]
    df = spark.createDataFrame(edges, "u bigint, v bigint, weight double")
    one, rounds = ({r.node: (r.distance, r.before) for r in graph.shortest_paths(df, 0, kernel_edges=k).collect()} for k in (10**6, 0))
    assert one == rounds
    for node in one:  # ways end at the source
        for _ in range(30):
            node = one[node][1] if node else 0
        assert node == 0


def test_greedy_match_by_rounds_and_in_one_task(spark):
    rng = random.Random(5)
    pairs = [(s, e, float(rng.randrange(30))) for s in range(40) for e in range(s + 1, 40) if rng.random() < 0.2] + [(100 + k, 101 + k, float(200 - k)) for k in range(60)]
    df = spark.createDataFrame(pairs, "s bigint, e bigint, d double")
    used, want = set(), set()
    for s, e, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if not used & {s, e}:
            used |= {s, e}
            want.add((s, e, d))
    for k in (10**6, 100, 20):
        assert {tuple(r) for r in graph.greedy_match(df, kernel_pairs=k).collect()} == want


def test_spurs_at_the_rim_stay(spark):
    edges = [(1, 2, 100.0), (2, 3, 100.0), (2, 4, 5.0), (3, 5, 5.0), (7, 7, 1.0)]
    df = spark.createDataFrame(edges, "u bigint, v bigint, weight double")
    rim = spark.createDataFrame([(5,)], "node bigint")
    kept = lambda **o: {(r.u, r.v) for r in graph.prune_spurs(df, 30.0, **o).collect()}
    assert kept() == {(1, 2), (2, 3)} and kept(rim=rim) == {(1, 2), (2, 3), (3, 5)}


def test_components_by_stars_and_in_one_task(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(50)] + [(9, 9), (777, 777)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    want = {n: p for n, p in brute_parts([e for e in edges if e[0] != e[1]]).items()}
    for limit in (10**6, 0, 40):
        assert {r.node: r.component for r in graph.components(df, limit).collect()} == want
    assert graph.components(df.limit(0)).count() == 0
