"""Graph tables: degrees, components, pruning, contraction, routes, submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.functions import roadgraph, rounded
from roadweft.operators import graph
from roadweft.plans.dual import duck_query as _duck
from roadweft.plans.dual import oracles, spark_query
from roadweft.plans.geometry import _HAV, NODE
from roadweft.plans.labels import _ROUND
from roadweft.session import table

SPARSE = "nn AS (SELECT count(*) AS n FROM {orders}), sparse AS (SELECT o_orderkey AS u, CAST((7 * o_orderkey + 3) % n AS BIGINT) AS v, o_totalprice AS weight FROM {orders} CROSS JOIN nn)"
DENSE = "dense AS (SELECT l_partkey AS u, 100000 + l_suppkey AS v, l_quantity AS weight, l_orderkey AS ord, l_linenumber AS line FROM {lineitem})"
DEGREE = "ends AS (SELECT u AS node, v AS other FROM sparse UNION ALL SELECT v, u FROM sparse), degree AS (SELECT node, CAST(count(*) AS BIGINT) AS degree, CAST(count(DISTINCT other) AS BIGINT) AS neighbours, max(CASE WHEN node = other THEN 1 ELSE 0 END) AS loops FROM ends GROUP BY node)"
INOUT = "io AS (SELECT node, sum(o) AS outs, sum(i) AS ins FROM (SELECT u AS node, 1 AS o, 0 AS i FROM sparse UNION ALL SELECT v, 0, 1 FROM sparse) t GROUP BY node)"
ENDPOINT = f"{SPARSE}, {DEGREE}, {INOUT}, endpoint AS (SELECT d.node, d.loops = 1 OR outs = 0 OR ins = 0 OR NOT (neighbours = 2 AND degree IN (2, 4)) AS is_endpoint FROM degree d JOIN io ON d.node = io.node)"
#: Terminals: all nodes; every 1500 keys fill another strip of 1301 x 1297 pixels, so that density is the same at any size.
TERMINAL = "terminal AS (SELECT o_orderkey AS id, CAST(1301 * @div(o_orderkey, 1500) + o_orderkey * 37 % 1301 AS DOUBLE) AS x, CAST(o_orderkey * 91 % 1297 AS DOUBLE) AS y FROM {orders})"
NEAR = f"""{TERMINAL}, cell AS (SELECT *, CAST(floor(x / 80e0) AS BIGINT) AS cx, CAST(floor(y / 80e0) AS BIGINT) AS cy FROM terminal),
    around AS (SELECT id, x, y, cx + i AS cx, cy + j AS cy FROM (SELECT *, @series(-1, 1) AS j FROM (SELECT *, @series(-1, 1) AS i FROM cell) a) b),
    near AS (SELECT a.id AS s, b.id AS e, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM around a JOIN cell b ON a.cx = b.cx AND a.cy = b.cy WHERE a.id < b.id),
    pair AS (SELECT * FROM near WHERE d > 0 AND d < 80 AND d <> 24)"""
WAY = "way AS (SELECT l_orderkey AS way_id, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE l_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' ELSE 'roundabout' END AS oneway FROM {lineitem}), leg AS (SELECT way_id, oneway, pos, node AS u, lead(node) OVER (PARTITION BY way_id ORDER BY pos) AS v FROM way)"
FIRST = f"{WAY}, loc AS (SELECT node, min(way_id * 100 + pos) AS ord FROM way GROUP BY node), ids AS (SELECT node, ord, 10000 + row_number() OVER (ORDER BY ord) - 1 AS id FROM loc)"
#: Components by recursion, for the oracle: the smallest node that is reachable.
REACH = f"{SPARSE}, sym AS (SELECT u, v FROM sparse UNION SELECT v, u FROM sparse), reach(node, root) AS (SELECT u, u FROM sym UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node WHERE r.root < s.v), parts AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"

TEMPLATES = {
    "agg_degree": f"WITH {DENSE}, ends AS (SELECT u AS node FROM dense UNION ALL SELECT v FROM dense) SELECT node, CAST(count(*) AS BIGINT) AS degree, count(*) = 1 AS terminal FROM ends GROUP BY node",
    "agg_graph_stats": f"WITH {SPARSE} SELECT (SELECT CAST(count(DISTINCT node) AS BIGINT) FROM (SELECT u AS node FROM sparse UNION ALL SELECT v FROM sparse) n) AS n_nodes, CAST(count(*) AS BIGINT) AS n_edges, {_ROUND('sum(weight) / 1000e0', 3)} AS tot_edge_km FROM sparse",
    "set_dedup_undirected": f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY ord, line, weight) AS rank FROM dense) SELECT u, v, weight, ord FROM r WHERE rank = 1",
    "gr_build": f"WITH {DENSE} SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY ord, line, weight) - 1 AS BIGINT) AS key, weight FROM dense",
    "gr_selfloop": f"WITH {SPARSE} SELECT u, v, weight FROM sparse WHERE u <> v",
    "win_first_seen_id": f"WITH {FIRST} SELECT node, CAST(id AS BIGINT) AS id FROM ids",
    "gr_wkt2edges": f"WITH {FIRST} SELECT l.way_id, l.pos, CAST(a.id AS BIGINT) AS u, CAST(b.id AS BIGINT) AS v, CAST(abs(l.v - l.u) AS DOUBLE) AS length_pix FROM leg l JOIN ids a ON l.u = a.node JOIN ids b ON l.v = b.node WHERE l.v IS NOT NULL",
    "gr_add_paths": f"WITH {WAY} SELECT way_id, pos, CASE WHEN oneway = '-1' THEN v ELSE u END AS u, CASE WHEN oneway = '-1' THEN u ELSE v END AS v FROM leg WHERE v IS NOT NULL UNION ALL SELECT way_id, pos, v, u FROM leg WHERE v IS NOT NULL AND oneway = 'no'",
    "gr_endpoint": f"WITH {ENDPOINT} SELECT node, is_endpoint FROM endpoint",
    "gr_short_edges": f"WITH {SPARSE}, {DEGREE}, bad AS (SELECT d.node FROM degree d JOIN ends e ON e.node = d.node JOIN sparse s ON (s.u = d.node OR s.v = d.node) WHERE d.degree = 1 AND s.weight < 50000) SELECT u, v, weight FROM sparse WHERE u NOT IN (SELECT node FROM bad) AND v NOT IN (SELECT node FROM bad)",
    "join_edge_nodes": f"WITH {SPARSE}, {NODE} SELECT s.u, s.v, a.lat AS lat_u, b.lat AS lat_v, {_ROUND('abs(a.lon - b.lon)', 6)} AS dlon FROM sparse s JOIN node a ON s.u = a.node JOIN node b ON s.v = b.node",
    "join_fill_geom": f"WITH {SPARSE}, {NODE}, g AS (SELECT l_orderkey AS u, min(l_quantity) AS mid FROM {{lineitem}} WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey) SELECT s.u, s.v, coalesce(g.mid, a.lat) AS x0, coalesce(g.mid, b.lat) AS x1, g.mid IS NULL AS filled FROM sparse s JOIN node a ON s.u = a.node JOIN node b ON s.v = b.node LEFT JOIN g ON s.u = g.u",
    "join_edge_key": f"WITH {DENSE}, k AS (SELECT u, v, ord, line, weight, row_number() OVER (PARTITION BY u, v ORDER BY ord, line, weight) - 1 AS key FROM dense), p AS (SELECT u, v, key, weight * 2e0 AS projected FROM k WHERE key < 2) SELECT k.u, k.v, CAST(k.key AS BIGINT) AS key, p.projected FROM k LEFT JOIN p ON k.u = p.u AND k.v = p.v AND k.key = p.key",
    "join_semi_subgraph": f"WITH {SPARSE} SELECT u, v FROM sparse WHERE u IN (SELECT o_orderkey FROM {{orders}} WHERE o_orderstatus = 'F') AND v IN (SELECT o_orderkey FROM {{orders}} WHERE o_orderstatus = 'F')",
    "join_anti_remove": f"WITH {SPARSE} SELECT u, v FROM sparse WHERE NOT EXISTS (SELECT 1 FROM {{orders}} o WHERE o_orderstatus = 'P' AND o.o_orderkey = sparse.u) AND NOT EXISTS (SELECT 1 FROM {{orders}} o WHERE o_orderstatus = 'P' AND o.o_orderkey = sparse.v)",
    "join_proximity": f"WITH {NEAR} SELECT s, e, {_ROUND('d', 6)} AS d, d < 24 AS close FROM pair",
    "join_anti_edge": f"WITH {SPARSE}, {NEAR} SELECT s, e FROM pair p WHERE NOT EXISTS (SELECT 1 FROM sparse x WHERE least(x.u, x.v) = p.s AND greatest(x.u, x.v) = p.e)",
    "sort_pair_dist": f"WITH {NEAR} SELECT s, e, CAST(row_number() OVER (ORDER BY d, s, e) AS BIGINT) AS place FROM pair",
    "join_path_edge": f"WITH {DENSE}, best AS (SELECT u, v, ord, weight, row_number() OVER (PARTITION BY u, v ORDER BY weight, ord, line) AS rank FROM dense) SELECT u, v, ord, weight AS length FROM best WHERE rank = 1",
    "gr_route_coords": f"WITH {NODE}, r AS (SELECT node, lat, lon, lead(lat) OVER (ORDER BY node) AS lat2, lead(lon) OVER (ORDER BY node) AS lon2 FROM node) SELECT node, lon AS x0, lat AS y0, lon2 AS x1, lat2 AS y1, {_ROUND(_HAV, 3)} AS length FROM r WHERE lat2 IS NOT NULL",
}

ORACLE_SQL = oracles(TEMPLATES)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table with many components: u, v, weight."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()
    return orders.select(F.col("o_orderkey").alias("u"), F.expr(f"CAST((7 * o_orderkey + 3) % {n} AS BIGINT)").alias("v"), F.col("o_totalprice").alias("weight"))


def gr_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(sparse(spark, sf_dir).select("u", "v"))


def gr_largest_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(sparse(spark, sf_dir)).select("u", "v")


def gr_clean_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clean_subgraphs(sparse(spark, sf_dir), min_length=400_000.0, max_nodes=20).select("u", "v")


def gr_apsp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_paths(sparse(spark, sf_dir), max_nodes=20).select("component", "nodes", (F.rint(F.col("longest") * 1000) / 1000).alias("longest"))


def gr_sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(sparse(spark, sf_dir), source=0).select("node", (F.rint(F.col("distance") * 1000) / 1000).alias("distance"))


def gr_prune_spur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune_spurs(sparse(spark, sf_dir), least=50_000.0, rounds=8)


def gr_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(sparse(spark, sf_dir))


def gr_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simplify(sparse(spark, sf_dir)).select("u", "v", (F.rint(F.col("length") * 1000) / 1000).alias("length"), "pieces")


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: every 1500 keys fill another strip, so density is the same at any size."""
    key = F.col("o_orderkey")
    x = 1301 * F.floor(key / 1500) + key * 37 % 1301
    return table(spark, sf_dir, "orders").select(key.alias("id"), x.cast("double").alias("x"), (key * 91 % 1297).cast("double").alias("y"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roadgraph.near_pairs(terminals(spark, sf_dir), 80.0, 24.0)
    return found.select("s", "e", rounded(F.col("d"), 6).alias("d"))


def topk_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.greedy_match(_near(spark, sf_dir)).select("s", "e")


def gr_clean_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, points = _near(spark, sf_dir).filter("d < 30"), terminals(spark, sf_dir)
    return graph.merge_points(points, pairs.select(F.col("s").alias("u"), F.col("e").alias("v")))


QUERIES = {
    "gr_cc": gr_cc,
    "gr_largest_cc": gr_largest_cc,
    "gr_clean_sub": gr_clean_sub,
    "gr_apsp": gr_apsp,
    "gr_sssp": gr_sssp,
    "gr_prune_spur": gr_prune_spur,
    "gr_paths": gr_paths,
    "gr_simplify": gr_simplify,
    "topk_greedy_match": topk_greedy_match,
    "gr_clean_intersect": gr_clean_intersect,
}

ORACLE_SQL |= {
    "gr_cc": _duck(f"WITH RECURSIVE {REACH} SELECT node, component FROM parts WHERE node IN (SELECT u FROM sparse WHERE u <> v UNION SELECT v FROM sparse WHERE u <> v)"),
    "gr_largest_cc": _duck(f"WITH RECURSIVE {REACH}, big AS (SELECT component FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT u, v FROM sparse JOIN parts p ON p.node = u WHERE p.component IN (SELECT component FROM big)"),
    "gr_sssp": _duck(f"""WITH RECURSIVE {SPARSE}, sym AS (SELECT u, v, weight FROM sparse UNION ALL SELECT v, u, weight FROM sparse),
        d(node, dist) USING KEY (node) AS (SELECT CAST(0 AS BIGINT), 0e0 UNION SELECT s.v, min(d.dist + s.weight) FROM d JOIN sym s ON s.u = d.node LEFT JOIN recurring.d r ON r.node = s.v WHERE r.dist IS NULL OR d.dist + s.weight < r.dist GROUP BY s.v)
        SELECT node, round_even(dist * 1000, 0) / 1000 AS distance FROM d"""),
}

# chains: maximal runs of inner nodes, named by their smallest
_CHAIN = f"""{SPARSE}, {DEGREE}, inner_ AS (SELECT node FROM degree WHERE degree = 2 AND neighbours = 2 AND loops = 0),
    isym AS (SELECT u, v FROM sparse WHERE u IN (SELECT node FROM inner_) AND v IN (SELECT node FROM inner_) UNION SELECT v, u FROM sparse WHERE u IN (SELECT node FROM inner_) AND v IN (SELECT node FROM inner_)),
    reach(node, root) AS (SELECT node, node FROM inner_ UNION SELECT s.v, r.root FROM reach r JOIN isym s ON s.u = r.node WHERE r.root < s.v),
    parts AS (SELECT node, min(root) AS chain FROM reach GROUP BY node),
    marked AS (SELECT s.u, s.v, s.weight, coalesce(a.chain, b.chain) AS chain, a.node AS a, b.node AS b FROM sparse s LEFT JOIN parts a ON s.u = a.node LEFT JOIN parts b ON s.v = b.node)"""
# all shortest paths within components of at most 20 nodes
_FAR = f"""{REACH}, small AS (SELECT component, CAST(count(*) AS BIGINT) AS nodes FROM parts GROUP BY component HAVING count(*) <= 20),
    own AS (SELECT p.node, p.component, s.nodes FROM parts p JOIN small s ON s.component = p.component),
    arc AS (SELECT u, v, weight FROM sparse WHERE u IN (SELECT node FROM own) UNION ALL SELECT v, u, weight FROM sparse WHERE u IN (SELECT node FROM own)),
    d(s, node, dist) USING KEY (s, node) AS (SELECT node, node, 0e0 FROM own UNION SELECT d.s, a.v, min(d.dist + a.weight) FROM d JOIN arc a ON a.u = d.node LEFT JOIN recurring.d r ON r.s = d.s AND r.node = a.v WHERE r.dist IS NULL OR d.dist + a.weight < r.dist GROUP BY d.s, a.v),
    far AS (SELECT o.component, o.nodes, max(d.dist) AS longest FROM d JOIN own o ON o.node = d.s GROUP BY o.component, o.nodes)"""


def _pruned(rounds: int, least: int) -> str:
    """Rounds written out one after the other."""
    text = f"{SPARSE}, e0 AS (SELECT u, v, weight FROM sparse)"
    for k in range(rounds):
        text += f""", n{k} AS (SELECT u AS node, weight FROM e{k} UNION ALL SELECT v, weight FROM e{k}), b{k} AS (SELECT node FROM n{k} GROUP BY node HAVING count(*) = 1 AND max(weight) < {least}),
            e{k + 1} AS (SELECT * FROM e{k} WHERE u NOT IN (SELECT node FROM b{k}) AND v NOT IN (SELECT node FROM b{k}))"""
    return f"WITH {text} SELECT u, v, weight FROM e{rounds} WHERE u <> v"


ORACLE_SQL |= {
    "gr_paths": _duck(f"WITH RECURSIVE {_CHAIN} SELECT chain, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT coalesce(a, b)) AS BIGINT) AS inner_nodes FROM marked WHERE chain IS NOT NULL GROUP BY chain"),
    "gr_simplify": _duck(f"""WITH RECURSIVE {_CHAIN}, tips AS (SELECT chain, min(CASE WHEN a IS NULL THEN u WHEN b IS NULL THEN v END) AS low, max(CASE WHEN a IS NULL THEN u WHEN b IS NULL THEN v END) AS high, sum(weight) AS length, CAST(count(*) AS BIGINT) AS pieces FROM marked WHERE chain IS NOT NULL GROUP BY chain)
        SELECT u, v, round_even(weight * 1000, 0) / 1000 AS length, CAST(1 AS BIGINT) AS pieces FROM marked WHERE chain IS NULL UNION ALL SELECT coalesce(low, chain), coalesce(high, chain), round_even(length * 1000, 0) / 1000, pieces FROM tips"""),
    "gr_apsp": _duck(f"WITH RECURSIVE {_FAR} SELECT component, nodes, round_even(longest * 1000, 0) / 1000 AS longest FROM far"),
    "gr_clean_sub": _duck(f"WITH RECURSIVE {_FAR} SELECT s.u, s.v FROM sparse s JOIN parts p ON p.node = s.u WHERE p.component NOT IN (SELECT component FROM far WHERE longest < 400000)"),
    "gr_prune_spur": _duck(_pruned(8, 50_000)),
    "gr_clean_intersect": _duck(f"""WITH RECURSIVE {NEAR}, sym AS (SELECT s AS u, e AS v FROM pair WHERE d < 30 UNION SELECT e, s FROM pair WHERE d < 30),
        reach(node, root) AS (SELECT u, u FROM sym UNION SELECT s.v, r.root FROM reach r JOIN sym s ON s.u = r.node WHERE r.root < s.v), parts AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
        SELECT coalesce(p.component, t.id) AS cluster, round_even(avg(t.x) * 1000, 0) / 1000 AS x, round_even(avg(t.y) * 1000, 0) / 1000 AS y, CAST(count(*) AS BIGINT) AS n FROM terminal t LEFT JOIN parts p ON p.node = t.id GROUP BY 1"""),
}
