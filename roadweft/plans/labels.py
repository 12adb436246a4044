"""Label rules: road classes, speeds, burn values, conversion tables, histograms, properties."""

from __future__ import annotations

from roadweft.functions.speeds import CHANNEL_MPH, COLOR_FROM, COLORS, HIGHWAY, MPH, SKIP, VALID
from roadweft.plans.dual import oracles

_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_LOOKUP = "(SELECT * FROM (VALUES " + ", ".join(f"({t}, {n}, {MPH[t][n > 2]})" for t in MPH for n in range(1, 13)) + ") AS v(type_, lanes_, mph0))"
_CLASS = "CASE " + " ".join(f"WHEN lower(highway) IN ({_quoted(names)}) THEN {k}" for k, names in HIGHWAY.items()) + " END"
_COLOR = "CASE " + " ".join(f"WHEN speed < {b} THEN '{c}'" for b, c in zip(COLOR_FROM, COLORS)) + f" ELSE '{COLORS[-1]}' END"
_CHANNEL = "CASE channel " + " ".join(f"WHEN {c} THEN {mph}e0" for c, mph in enumerate(CHANNEL_MPH)) + " END"

#: lineitem as labelled road features, part as highway strings with tags.
FEATURE = """feature AS (
    SELECT l_orderkey AS image_id, l_linenumber AS road_type, 1 + CAST(l_quantity AS INT) % 12 AS lanes,
           CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS surface, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS bridge
    FROM {lineitem})"""
SPEED = f"""{FEATURE}, speed AS (
    SELECT f.*, mph0 * CASE surface WHEN 1 THEN 1e0 ELSE 0.75e0 END * CASE bridge WHEN 1 THEN 1e0 ELSE 1e0 END AS speed_mph
    FROM feature f JOIN {_LOOKUP} s ON f.road_type = s.type_ AND f.lanes = s.lanes_)"""
OSM = """osm AS (
    SELECT p_partkey AS way_id, p_size, CASE p_type WHEN 'ECONOMY' THEN 'motorway' WHEN 'STANDARD' THEN 'Primary' WHEN 'SMALL' THEN 'secondary_link'
           WHEN 'MEDIUM' THEN 'residential' WHEN 'LARGE' THEN 'footway' ELSE 'track' END AS highway,
           CASE WHEN p_size % 10 = 0 THEN 'yes' ELSE 'no' END AS tunnel, CASE WHEN p_size % 7 = 0 THEN 'railway' ELSE 'highway' END AS class
    FROM {part})"""
#: The binned and the continuous conversion table, built by their rules.
BINNED = "binned AS (SELECT CAST(speed AS INT) AS speed, CAST(ceil(speed / 10e0) * 36 AS INT) AS burn_val, CAST(ceil(speed / 10e0) AS INT) - 1 AS channel FROM (SELECT @series(1, 65) AS speed) t)"
CONTIN = "contin AS (SELECT CAST(speed AS INT) AS speed, greatest(least(255e0 * speed / 65e0, 255e0), 0e0) AS burn_val FROM (SELECT @series(0, 65) AS speed) t)"
_ROUND = lambda x, d: f"(@rint(({x}) * 1e{d}) / 1e{d})"

TEMPLATES = {
    "join_speed_lookup": f"WITH {SPEED} SELECT road_type, lanes, surface, min(speed_mph) AS speed_mph, CAST(count(*) AS BIGINT) AS n FROM speed GROUP BY road_type, lanes, surface",
    "fn_highway_class": f"WITH {OSM} SELECT highway, coalesce({_CLASS}, 0) AS road_type, CAST(count(*) AS BIGINT) AS n FROM osm GROUP BY highway",
    "filt_roadtypes": f"WITH {OSM} SELECT way_id, lower(highway) AS highway FROM osm WHERE lower(highway) IN ({_quoted(VALID)})",
    "filt_bad_speed": f"WITH {OSM}, s AS (SELECT way_id, CASE WHEN highway IN ({_quoted(SKIP)}) THEN -1 ELSE p_size END AS speed_mph FROM osm) SELECT way_id, speed_mph FROM s WHERE speed_mph >= 0",
    "proj_rename": "WITH raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS bridge_typ, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS bridge_type FROM {orders}) SELECT id, coalesce(bridge_type, bridge_typ) AS bridge_type FROM raw",
    "proj_withcol_speed": f"WITH {SPEED} SELECT image_id, road_type, lanes, speed_mph AS inferred_speed_mph, {_ROUND('0.44704e0 * speed_mph', 3)} AS inferred_speed_mps FROM speed",
    "fn_unit": f"WITH {SPEED} SELECT DISTINCT speed_mph, 0.44704e0 * speed_mph AS mps, {_ROUND('speed_mph / 0.000621371e0 / 3600e0', 3)} AS meters_per_s FROM speed",
    "agg_value_counts": f"WITH {SPEED} SELECT speed_mph, CAST(count(*) AS BIGINT) AS n FROM speed GROUP BY speed_mph",
    "agg_distinct_sort": "SELECT DISTINCT l_shipdate AS value FROM {lineitem} ORDER BY value",
    "set_union_distinct": f"WITH {SPEED} SELECT speed_mph FROM speed WHERE road_type <= 3 UNION SELECT speed_mph FROM speed WHERE road_type >= 3",
    "set_union_all": "SELECT l_orderkey AS image_id, l_linenumber AS line FROM {lineitem} WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_linestatus = 'F'",
    "fn_burn_contin": "SELECT p_partkey AS id, greatest(least(255e0 * p_size / 65e0, 255e0), 0e0) AS burn_val FROM {part}",
    "fn_burn_bin": "SELECT p_partkey AS id, CAST(ceil(p_size / 10e0) * 36 AS INT) AS burn_val FROM {part}",
    "fn_channel_of_burn": "SELECT p_partkey AS id, CAST(@div(CAST(ceil(p_size / 10e0) * 36 AS INT), 36) - 1 AS BIGINT) AS channel FROM {part}",
    "agg_bin_mean": f"WITH {BINNED} SELECT channel, CAST(floor(avg(speed)) AS DOUBLE) + 2.5e0 AS mean_mph, {_CHANNEL} AS mph, CAST(count(*) AS BIGINT) AS n FROM binned GROUP BY channel",
    "agg_contin_map": f"WITH {CONTIN} SELECT burn_val, max(speed) AS speed FROM contin GROUP BY burn_val",
    "join_nearest_key": f"""WITH {CONTIN}, v AS (SELECT DISTINCT p_size AS value FROM {{part}}), d AS (
        SELECT value, speed, row_number() OVER (PARTITION BY value ORDER BY abs(burn_val - value), speed) AS rank FROM v CROSS JOIN contin)
        SELECT value, speed FROM d WHERE rank = 1""",
    "fn_color_bin": f"SELECT CAST(speed AS INT) AS speed, {_COLOR} AS color FROM (SELECT @series(0, 79) AS speed) t",
    "fn_json_props": "SELECT event_id, CAST(@json(props, k) AS INT) AS k, coalesce(@json(props, highway), @json(props, class), 'none') AS highway FROM {events}",
    "ds_names_idx": "WITH n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS idx FROM {pages}) SELECT CAST(idx AS BIGINT) AS idx, page_id FROM n WHERE page_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)",
    "join_img_mask": "SELECT p.page_id, concat(split_part(concat('im', CAST(p.page_id AS STRING), '.png'), '.', 1), '.tif') AS mask FROM {pages} p JOIN {labels} l ON p.page_id = l.doc_id",
    "join_dir_zip": "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos FROM {part}), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS pos FROM {supplier}) SELECT p_partkey, s_suppkey FROM a JOIN b ON a.pos = b.pos",
    "geo_stamp": "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS pos FROM {customer}), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS pos FROM {part}) SELECT c_custkey, p_partkey FROM a JOIN b ON a.pos = b.pos",
    "fn_make_str": "SELECT l_orderkey AS id, CAST(l_linenumber AS STRING) AS text, concat(l_returnflag, '-', l_linestatus) AS name FROM {lineitem}",
    "cfg_dir_select": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'stitched' WHEN o_orderkey % 4 > 1 THEN 'merged' ELSE substring(concat('fold0_', CAST(o_orderkey AS STRING)), 7) END AS input FROM {orders}",
    "filt_by_key": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_orderkey = 7",
    "filt_mask_exists": "SELECT o_orderkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45)",
    "limit_nmax": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 5",
    "sort_names": "SELECT c_name, c_custkey FROM {customer} ORDER BY c_name",
    "proj_solution_cols": "SELECT l_orderkey AS image_id, l_quantity AS length_m, l_extendedprice AS travel_time_s FROM {lineitem}",
    "agg_epoch_meter": f"SELECT CAST(day(ts) AS INT) AS epoch, event_type AS phase, {_ROUND('avg(value)', 6)} AS loss, CAST(count(*) AS BIGINT) AS n FROM {{events}} GROUP BY 1, 2",
    "agg_best_epoch": f"""WITH e AS (SELECT CAST(day(ts) AS INT) AS epoch, {_ROUND('avg(value)', 6)} AS loss FROM {{events}} GROUP BY 1),
        b AS (SELECT epoch, loss, min(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM e),
        s AS (SELECT *, max(CASE WHEN loss = best THEN epoch END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_epoch FROM b)
        SELECT epoch, loss, best, best_epoch, epoch - best_epoch >= 5 AS stopped FROM s""",
    "win_detect_lrdrop": "WITH e AS (SELECT DISTINCT CAST(day(ts) AS INT) AS epoch FROM {events}), s AS (SELECT * FROM (VALUES (10), (20)) AS v(step)) SELECT epoch, 0.1e0 * pow(0.5e0, CAST(count(step) AS DOUBLE)) AS lr FROM e LEFT JOIN s ON step <= epoch GROUP BY epoch",
    "win_rownum_mod": "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name) - 1) % 4 AS INT) AS fold FROM {customer}",
    "filt_fold": "WITH f AS (SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name) - 1) % 4 AS INT) AS fold FROM {customer}) SELECT c_custkey FROM f WHERE fold IN (2)",
    "set_except_fold": "WITH f AS (SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name) - 1) % 4 AS INT) AS fold FROM {customer}) SELECT k.fold, f.c_custkey FROM f CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(fold)) k WHERE k.fold <> f.fold",
    "sample_split": "SELECT c_custkey, CASE WHEN substring(md5(concat(c_name, '42')), 1, 2) < 'cc' THEN 'train' ELSE 'test' END AS split FROM {customer}",
    "sample_shuffle": "SELECT c_custkey, CAST(row_number() OVER (ORDER BY md5(concat(c_name, '42'))) - 1 AS BIGINT) AS place FROM {customer}",
    "sample_choice": "SELECT page_id FROM {pages} ORDER BY md5(concat(url, '7')), page_id LIMIT 10",
}

QUERIES: dict = {}
ORACLE_SQL = oracles(TEMPLATES)
