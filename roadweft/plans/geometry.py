"""Geometry and speed inference: line strings, distances, projections, patches, travel time."""

from __future__ import annotations

from roadweft.plans.dual import oracles
from roadweft.plans.labels import _CHANNEL, _ROUND

POLYLINE = "polyline AS (SELECT vec_id, label, CAST(i AS INT) AS i, CAST(@at(embedding, 2 * i) AS DOUBLE) AS x, CAST(@at(embedding, 2 * i + 1) AS DOUBLE) AS y FROM (SELECT vec_id, label, embedding, @series(0, 31) AS i FROM {embeddings}) e)"
SEGMENT = f"""{POLYLINE}, ends AS (SELECT vec_id, label, i, x, y, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS x2, lead(y) OVER (PARTITION BY vec_id ORDER BY i) AS y2 FROM polyline),
    segment AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS length FROM ends WHERE x2 IS NOT NULL)"""
PATCH = "patch AS (SELECT vec_id, label, CAST(@div(p, 8) AS INT) AS band, greatest(least(floor((CAST(@at(embedding, p) AS DOUBLE) + 0.6e0) * 200e0), 255e0), 0e0) AS v FROM (SELECT vec_id, label, embedding, @series(0, 55) AS p FROM {embeddings}) e)"
#: Per segment and band the truncated 85th percentile.
LEVEL = f"{PATCH}, level AS (SELECT vec_id, label, band AS channel, floor(@pct(v, 0.85e0)) AS z FROM patch GROUP BY vec_id, label, band)"
MILES = "0.000621371e0"
#: Edge speed of the constant-speed path and its length in metres.
EDGE = f"""{LEVEL}, total AS (SELECT label, channel, sum(z) AS z FROM level GROUP BY label, channel),
    best AS (SELECT label, channel, row_number() OVER (PARTITION BY label ORDER BY z DESC, channel) AS rank FROM total),
    mph AS (SELECT label, channel, {_CHANNEL} AS mph FROM best WHERE rank = 1),
    {SEGMENT}, line AS (SELECT label, sum(length) * 100e0 AS length FROM segment GROUP BY label),
    edge AS (SELECT m.label AS edge_id, m.channel, m.mph, l.length, l.length * {MILES} AS miles FROM mph m JOIN line l ON m.label = l.label)"""
NODE = "node AS (SELECT o_orderkey AS node, 36e0 + 0.001e0 * (o_orderkey % 1000) AS lat, -115e0 + 0.001e0 * (o_orderkey % 777) AS lon FROM {orders})"
_HAV = "2e0 * 6371009e0 * asin(sqrt(least(1e0, pow(sin((radians(lat2) - radians(lat)) / 2e0), 2e0) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2e0), 2e0))))"
PAIR = f"{NODE}, pair AS (SELECT a.node AS u, b.node AS v, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM node a JOIN node b ON b.node = a.node + 1)"
# Transverse Mercator on WGS84 by Snyder's series (published formula)
_E2 = "0.0066943799901413165e0"
_EP2 = f"({_E2} / (1e0 - {_E2}))"
_M = f"6378137e0 * ((1e0 - {_E2} / 4e0 - 3e0 * pow({_E2}, 2e0) / 64e0 - 5e0 * pow({_E2}, 3e0) / 256e0) * phi - (3e0 * {_E2} / 8e0 + 3e0 * pow({_E2}, 2e0) / 32e0 + 45e0 * pow({_E2}, 3e0) / 1024e0) * sin(2e0 * phi) + (15e0 * pow({_E2}, 2e0) / 256e0 + 45e0 * pow({_E2}, 3e0) / 1024e0) * sin(4e0 * phi) - (35e0 * pow({_E2}, 3e0) / 3072e0) * sin(6e0 * phi))"
UTM = f"""{NODE}, z AS (SELECT node, lat, lon, CAST(floor((lon + 180e0) / 6e0) + 1 AS INT) AS zone, radians(lat) AS phi FROM node),
    t AS (SELECT *, 6378137e0 / sqrt(1e0 - {_E2} * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t, {_EP2} * cos(phi) * cos(phi) AS c,
          cos(phi) * (radians(lon) - radians(zone * 6e0 - 183e0)) AS a, {_M} AS m FROM z),
    utm AS (SELECT node, zone,
        500000e0 + 0.9996e0 * n * (a + (1e0 - t + c) * pow(a, 3e0) / 6e0 + (5e0 - 18e0 * t + t * t + 72e0 * c - 58e0 * {_EP2}) * pow(a, 5e0) / 120e0) AS east,
        0.9996e0 * (m + n * tan(phi) * (a * a / 2e0 + (5e0 - t + 9e0 * c + 4e0 * c * c) * pow(a, 4e0) / 24e0 + (61e0 - 58e0 * t + t * t + 600e0 * c - 330e0 * {_EP2}) * pow(a, 6e0) / 720e0)) AS north
        FROM t)"""
SEQ = "step AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM {events})"
DEDUP = f"{SEQ}, seen AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM step), dedup AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS pos FROM seen WHERE before IS NULL OR before <> event_type)"

TEMPLATES = {
    "agg_travel": f"""WITH {EDGE}
        SELECT edge_id, channel, mph AS inferred_speed_mph, {_ROUND('length', 3)} AS length_m, {_ROUND('miles', 6)} AS length_miles,
               {_ROUND('0.44704e0 * mph', 2)} AS inferred_speed_mps, {_ROUND('3600e0 * miles / mph', 3)} AS travel_time_s FROM edge""",
    "agg_argmax_ch": f"WITH {EDGE} SELECT edge_id, channel, mph FROM edge",
    "agg_edge_time": f"""WITH {LEVEL}, seg AS (SELECT vec_id, label, sum(CASE WHEN z > 128 THEN z * {_CHANNEL} END) / sum(CASE WHEN z > 128 THEN z END) AS mph FROM level GROUP BY vec_id, label),
        {SEGMENT}, line AS (SELECT vec_id, sum(length) * 100e0 * {MILES} AS miles FROM segment GROUP BY vec_id)
        SELECT s.label AS edge_id, {_ROUND('sum(miles / coalesce(mph, -1e0))', 9)} AS hours, {_ROUND('sum(miles)', 6)} AS miles FROM seg s JOIN line l ON s.vec_id = l.vec_id GROUP BY s.label""",
    "agg_patch_multi": f"""WITH {LEVEL}, m AS (SELECT vec_id, max(z) AS top, sum(CASE WHEN z > 128 THEN z * {_CHANNEL} END) / sum(CASE WHEN z > 128 THEN z END) AS weighted FROM level GROUP BY vec_id),
        b AS (SELECT vec_id, channel, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, channel) AS rank FROM level)
        SELECT m.vec_id, {_ROUND('coalesce(weighted, -1e0)', 6)} AS weighted_mph, CASE WHEN z >= 128 THEN {_CHANNEL} ELSE -1e0 END AS argmax_mph FROM m JOIN b ON m.vec_id = b.vec_id WHERE rank = 1""",
    "agg_wmean_std": f"WITH m AS (SELECT l_suppkey, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean FROM {{lineitem}} GROUP BY l_suppkey) SELECT l.l_suppkey, {_ROUND('max(mean)', 3)} AS mean, {_ROUND('sqrt(sum(l_quantity * (l_extendedprice - mean) * (l_extendedprice - mean)) / sum(l_quantity))', 3)} AS std FROM {{lineitem}} l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY l.l_suppkey",
    # the box [x - 4, x + 4] x [y - 4, y + 4] as an equi-join on exploded offsets
    "join_patch": """WITH pixel AS (SELECT l_partkey AS x, l_suppkey AS y, max(l_quantity) AS z FROM {lineitem} GROUP BY l_partkey, l_suppkey),
        mid AS (SELECT vec_id, CAST(vec_id * 3 % 1900 AS BIGINT) AS mx, CAST(vec_id % 90 AS BIGINT) AS my FROM {embeddings}),
        box AS (SELECT vec_id, x, my + j AS y FROM (SELECT vec_id, mx + i AS x, my, @series(-4, 4) AS j FROM (SELECT vec_id, mx, my, @series(-4, 4) AS i FROM mid) a) b WHERE x >= 0 AND my + j >= 0)
        SELECT b.vec_id, CAST(count(*) AS BIGINT) AS pixels, @rint(@pct(p.z, 0.85e0) * 1e6) / 1e6 AS z FROM box b JOIN pixel p ON b.x = p.x AND b.y = p.y GROUP BY b.vec_id""",
    "win_seg_metrics": f"WITH {SEGMENT} SELECT vec_id, i, @rint((x + x2) * 50e0) AS mid_x, @rint((y + y2) * 50e0) AS mid_y, {_ROUND('length', 9)} AS length FROM segment",
    "win_pairwise": f"WITH {SEQ} SELECT user_id, pos, event_type AS s, e FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS e FROM step) t WHERE e IS NOT NULL",
    "win_dedup_seq": f"WITH {DEDUP} SELECT user_id, event_id, event_type FROM dedup",
    # pieces of a sequence that splits where an undirected segment repeats; the piece before the last cut of several is lost
    "win_split_dupseg": f"""WITH {DEDUP}, pair AS (SELECT user_id, pos, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS e FROM dedup),
        cut AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id, least(s, e), greatest(s, e) ORDER BY pos) AS times FROM pair WHERE e IS NOT NULL),
        slit AS (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY user_id) AS cuts FROM cut WHERE times > 1),
        piece AS (SELECT d.user_id, d.pos, d.event_type, CAST(count(a.pos) AS BIGINT) AS piece, max(t.cuts) AS cuts FROM dedup d LEFT JOIN slit a ON a.user_id = d.user_id AND a.pos < d.pos LEFT JOIN (SELECT DISTINCT user_id, cuts FROM slit) t ON t.user_id = d.user_id GROUP BY d.user_id, d.pos, d.event_type)
        SELECT user_id, piece, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos FROM piece WHERE cuts IS NULL OR cuts = 1 OR piece <> cuts - 1 GROUP BY user_id, piece, cuts HAVING cuts IS NULL OR piece = 0 OR piece = max(cuts) OR count(*) > 1""",
    "win_chain_runs": f"WITH {SEQ}, e AS (SELECT user_id, pos, event_id AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY pos) AS e, event_type FROM step), r AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END AS starts FROM e), g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r) SELECT user_id, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, min(s) AS first_node FROM g GROUP BY user_id, run",
    "fn_angle": f"""WITH {POLYLINE}, n AS (SELECT vec_id, i, x, y, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS x0, lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS y0,
            lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS x2, lead(y) OVER (PARTITION BY vec_id ORDER BY i) AS y2 FROM polyline),
        c AS (SELECT vec_id, i, x0 - x AS ax, y0 - y AS ay, x2 - x AS bx, y2 - y AS b_y FROM n WHERE x0 IS NOT NULL AND x2 IS NOT NULL)
        SELECT vec_id, i, {_ROUND('degrees(atan2(ax * b_y - ay * bx, ax * bx + ay * b_y))', 6)} AS angle FROM c""",
    "fn_line_pt_dist": f"WITH {SEGMENT} SELECT vec_id, i, {_ROUND('((x2 - x) * (0e0 - y) - (y2 - y) * (0e0 - x)) / length', 6)} AS distance FROM segment WHERE length > 0",
    "fn_seg_dist": f"WITH {SEGMENT} SELECT vec_id, i, {_ROUND('CASE WHEN length = 0 THEN sqrt(x * x + y * y) ELSE abs((x2 - x) * (y - 0e0) - (x - 0e0) * (y2 - y)) / length END', 6)} AS distance FROM segment",
    "fn_haversine": f"WITH {PAIR} SELECT u, v, {_ROUND(_HAV, 3)} AS length FROM pair",
    "gr_edge_len": f"WITH {PAIR} SELECT u, v, {_ROUND(f'coalesce({_HAV}, 0e0)', 3)} AS length FROM pair",
    "fn_utm_zone": f"WITH {NODE} SELECT CAST(floor((avg(lon) + 180e0) / 6e0) + 1 AS INT) AS zone FROM node",
    "gr_node_geo": f"WITH {UTM} SELECT u.node, n.lat, n.lon, u.zone, {_ROUND('u.east', 2)} AS utm_east, {_ROUND('u.north', 2)} AS utm_north FROM utm u JOIN node n ON u.node = n.node",
    "fn_affine": "SELECT l_partkey AS col_, l_suppkey AS row_, l_partkey * 0.3e0 + 1000e0 AS x, l_suppkey * -0.3e0 + 2000e0 AS y FROM {lineitem}",
    "join_raster_meta": "WITH meta AS (SELECT n_nationkey AS image_id, 1000e0 * n_nationkey AS x0, 500e0 * n_nationkey AS y0, 0.3e0 AS pw, -0.3e0 AS ph FROM {nation}) SELECT c_custkey, c_custkey * pw + x0 AS x, c_custkey * ph + y0 AS y FROM {customer} JOIN meta ON c_nationkey = image_id",
    "fn_webmerc": f"WITH {NODE} SELECT node, {_ROUND('6378137e0 * radians(lon)', 3)} AS x, {_ROUND('6378137e0 * ln(tan(pi() / 4e0 + radians(lat) / 2e0))', 3)} AS y FROM node",
    "fn_wkt_format": "SELECT l_partkey, l_suppkey, l_linenumber, concat('LINESTRING (', CAST(l_suppkey AS STRING), '.0 ', CAST(l_partkey AS STRING), '.0, ', CAST(l_linenumber AS STRING), '.0 ', CAST(l_partkey AS STRING), '.0)') AS wkt FROM {lineitem}",
    "fn_line_length": f"WITH {SEGMENT} SELECT vec_id, {_ROUND('sum(length)', 6)} AS length FROM segment GROUP BY vec_id",
    "fn_line_project": f"WITH {SEGMENT} SELECT vec_id, i, {_ROUND('sum(length) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length', 6)} AS position FROM segment",
    "fn_flatten": f"WITH {POLYLINE} SELECT label, CAST(count(*) AS BIGINT) AS points FROM polyline GROUP BY label",
    "agg_extent": f"WITH {POLYLINE} SELECT label, min(x) AS min_x, max(x) AS max_x, max(y) - min(y) AS range_y FROM polyline GROUP BY label",
    "filt_edge_len": f"WITH {PAIR}, e AS (SELECT u, v, {_HAV} AS length FROM pair) SELECT u, v, {_ROUND('length', 3)} AS length FROM e WHERE length <= 5000",
    "filt_lat": f"WITH {NODE} SELECT CAST(count(*) AS BIGINT) AS bad FROM node WHERE abs(lat) > 90",
}

QUERIES: dict = {}
ORACLE_SQL = oracles(TEMPLATES)
