"""Raster operators on pixel tables: tiles, merges, stitching, rescaling, masks, losses."""

from __future__ import annotations

from roadweft.plans.dual import oracles

_ROUND = lambda x, d: f"(@rint(({x}) * 1e{d}) / 1e{d})"
PIXEL = "pixel AS (SELECT l_partkey AS x, l_suppkey AS y, l_quantity AS v, l_orderkey AS src, CAST(l_orderkey % 4 AS INT) AS fold, CAST(l_linenumber AS INT) AS band FROM {lineitem})"
IMAGE = "image AS (SELECT p_partkey AS image_id, p_name AS name, CAST(1400 + 60 * p_size AS INT) AS w, CAST(1300 + 200 * (p_partkey % 7) AS INT) AS h FROM {part})"
TILE = f"""{IMAGE}, xs AS (SELECT image_id, name, w, h, least(1280 * i, w - 1300) AS xmin FROM (SELECT *, @series(0, @div(w - 2, 1280)) AS i FROM image) t),
    xy AS (SELECT image_id, name, w, h, xmin, least(1280 * j, h - 1300) AS ymin FROM (SELECT *, @series(0, @div(h - 2, 1280)) AS j FROM xs) t),
    tile AS (SELECT DISTINCT image_id, name, w, h, CAST(xmin AS BIGINT) AS xmin, CAST(ymin AS BIGINT) AS ymin FROM xy)"""
_P = "greatest(least(v / 50e0, 1e0), 0e0)"
_T = "(CASE WHEN band > 3 THEN 1e0 ELSE 0e0 END)"

TEMPLATES = {
    "tf_tile": f"WITH {TILE} SELECT image_id, xmin, ymin, w, h FROM tile",
    "set_dedup_coords": f"WITH {TILE} SELECT image_id, CAST(count(*) AS BIGINT) AS tiles FROM tile GROUP BY image_id",
    "fn_tile_starts": "SELECT DISTINCT dim, CAST(least(1280 * i, dim - 1300) AS BIGINT) AS start FROM (SELECT dim, @series(0, @div(dim - 2, 1280)) AS i FROM (SELECT DISTINCT 1400 + 60 * p_size AS dim FROM {part}) d) t",
    "fn_tile_name": f"WITH {TILE} SELECT image_id, concat(CAST(row_number() OVER (PARTITION BY image_id ORDER BY xmin, ymin) - 1 AS STRING), '__', name, '__', CAST(xmin AS STRING), '__', CAST(ymin AS STRING), '__1300__1300__', CAST(w AS STRING), '__', CAST(h AS STRING), '.tif') AS tile FROM tile",
    "agg_fold_mean": f"WITH {PIXEL} SELECT x, fold, CAST(floor(avg(v)) AS BIGINT) AS v FROM pixel GROUP BY x, fold",
    "join_prefix_fold": "WITH f AS (SELECT concat('fold', CAST(l_orderkey % 4 AS STRING), '_', CAST(l_partkey AS STRING)) AS name, l_quantity AS v FROM {lineitem}) SELECT substring(name, 7) AS image, CAST(count(DISTINCT substring(name, 1, 5)) AS BIGINT) AS folds, CAST(floor(avg(v)) AS BIGINT) AS v FROM f GROUP BY substring(name, 7)",
    "agg_stitch": f"WITH {PIXEL} SELECT x, y, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v, CAST(count(*) AS BIGINT) AS overlap FROM pixel GROUP BY x, y",
    "agg_crop_mean": f"WITH {PIXEL} SELECT x, y, {_ROUND('sum(v) / count(*)', 6)} AS v FROM pixel WHERE x >= 10 AND y >= 10 GROUP BY x, y",
    "agg_tta_mean": f"""WITH {PIXEL}, p AS (SELECT x % 64 AS x, y % 64 AS y, v FROM pixel), f AS (
        SELECT x, y, v FROM p UNION ALL SELECT 63 - x, y, v FROM p UNION ALL SELECT x, 63 - y, v FROM p UNION ALL SELECT 63 - x, 63 - y, v FROM p)
        SELECT x, y, {_ROUND('avg(v)', 6)} AS v FROM f GROUP BY x, y""",
    "fn_flip_index": f"WITH {PIXEL} SELECT x, y, 63 - x % 64 AS flipped_x, 63 - y % 64 AS flipped_y, v FROM pixel",
    "agg_pct": f"WITH {PIXEL} SELECT band, {_ROUND('@pct(v, 0.02e0)', 6)} AS low, {_ROUND('@pct(v, 0.5e0)', 6)} AS median, {_ROUND('@pct(v, 0.98e0)', 6)} AS high FROM pixel GROUP BY band",
    "fn_rescale_8bit": f"""WITH {PIXEL}, b AS (SELECT band, greatest(1e0, @pct(v, 0.02e0)) AS lo, @pct(v, 0.98e0) AS hi FROM pixel GROUP BY band)
        SELECT p.src, p.x, p.y, p.band, CAST(floor(greatest(least(255e0 * (v - lo) / (hi - lo), 255e0), 0e0)) AS BIGINT) AS v FROM pixel p JOIN b ON p.band = b.band""",
    "fn_gamma_lut": "SELECT CAST(i AS INT) AS i, CAST(floor(pow(i / 255e0, 1e0 / 1.66e0) * 255e0) AS BIGINT) AS v FROM (SELECT @series(0, 255) AS i) t",
    "fn_onehot_bands": f"WITH {PIXEL}, m AS (SELECT x, y, max(band) AS value FROM pixel GROUP BY x, y) SELECT x, y, CAST(b AS INT) AS band, CASE WHEN value = b + 1 OR b = 7 THEN 255 ELSE 0 END AS v FROM (SELECT *, @series(0, 7) AS b FROM m) t",
    "filt_black_tile": f"WITH {PIXEL}, t AS (SELECT x, @div(y, 16) AS tile, max(v - 25) AS m FROM pixel GROUP BY x, @div(y, 16)) SELECT x, tile, m FROM t WHERE m >= 1",
    "filt_zero_frac": f"WITH {PIXEL} SELECT x AS image_id, {_ROUND('avg(CASE WHEN v <= 10 THEN 1e0 ELSE 0e0 END)', 6)} AS zero_frac FROM pixel GROUP BY x HAVING avg(CASE WHEN v <= 10 THEN 1e0 ELSE 0e0 END) < 0.3e0",
    "filt_null_mask": f"WITH {PIXEL}, f AS (SELECT x, avg(CASE WHEN v <= 5 THEN 1e0 ELSE 0e0 END) AS zero FROM pixel GROUP BY x) SELECT p.src, p.x, p.y, p.band, CASE WHEN f.zero >= 0.05e0 AND p.v <= 5 THEN 0 ELSE p.band END AS mask FROM pixel p JOIN f ON p.x = f.x",
    "filt_alpha_tile": f"WITH {PIXEL} SELECT x, @div(y, 16) AS tile, {_ROUND('avg(v)', 6)} AS alpha FROM pixel GROUP BY x, @div(y, 16) HAVING avg(v) > 5",
    "tf_thresh": f"WITH {PIXEL} SELECT x, y, max(v) AS v FROM pixel GROUP BY x, y HAVING max(v) > 50 * 0.3e0",
    # images of 1000 x 1000 pixels
    "tf_cut_border": f"WITH {PIXEL}, p AS (SELECT @div(x, 1000) AS image_x, @div(y, 1000) AS image_y, x % 1000 AS x, y % 1000 AS y, v FROM pixel) SELECT image_x, image_y, x - 22 AS x, y - 22 AS y, max(v) AS v FROM p WHERE x >= 22 AND y >= 22 AND x < 1000 - 22 AND y < 1000 - 22 GROUP BY image_x, image_y, x, y",
    # images of 64 x 64 pixels, a border of 8 reflected on each side
    "tf_pad": f"""WITH {PIXEL}, p AS (SELECT @div(x, 64) AS image_x, @div(y, 64) AS image_y, x % 64 AS x, y % 64 AS y, v FROM pixel),
        s AS (SELECT image_x, image_y, x, y, max(v) AS v FROM p GROUP BY image_x, image_y, x, y),
        t AS (SELECT CAST(i AS BIGINT) AS place, CAST(CASE WHEN i < 0 THEN -1 - i WHEN i > 63 THEN 127 - i ELSE i END AS BIGINT) AS src FROM (SELECT @series(-8, 71) AS i) q)
        SELECT s.image_x, s.image_y, a.place AS x, b.place AS y, s.v FROM s JOIN t a ON a.src = s.x JOIN t b ON b.src = s.y""",
    "tf_border_fix": f"WITH {PIXEL}, p AS (SELECT x % 32 AS x, y % 32 AS y, max(v) AS v FROM pixel GROUP BY x % 32, y % 32) SELECT x + 5 - 7 + 2 AS x, y + 5 - 7 + 2 AS y, v FROM p WHERE x + 5 >= 7 AND y + 5 >= 7 AND x + 5 < 42 - 7 AND y + 5 < 42 - 7",
    "agg_pixel_area": f"WITH {IMAGE} SELECT CAST(sum(CAST(w AS BIGINT) * h) AS BIGINT) AS pixels, {_ROUND('sum(CAST(w AS DOUBLE) * h) * 0.3e0 * 0.3e0 / 1e6', 6)} AS km2 FROM image",
    "agg_band_stats": f"WITH {PIXEL}, s AS (SELECT x, max(CASE WHEN band % 2 = 1 THEN v END) AS dsm, max(CASE WHEN band % 2 = 0 THEN v END) AS dtm FROM pixel GROUP BY x) SELECT {_ROUND('avg(dsm - dtm)', 6)} AS mean_height, CAST(count(*) AS BIGINT) AS n FROM s WHERE dsm IS NOT NULL AND dtm IS NOT NULL",
    "agg_hist": f"WITH h AS (SELECT least(CAST(floor(l_discount * 10 * 29) AS BIGINT), 28) AS bin FROM {{lineitem}}), n AS (SELECT count(*) AS n FROM {{lineitem}}) SELECT bin, {_ROUND('count(*) * 1e0 / max(n)', 6)} AS share FROM h CROSS JOIN n GROUP BY bin",
    "agg_dice": f"WITH {PIXEL} SELECT x AS image_id, {_ROUND(f'greatest(least((2e0 * sum({_P} * {_T}) + 1) / (sum({_P}) + sum({_T}) + 1), 1e0), 0e0)', 6)} AS dice FROM pixel GROUP BY x",
    "agg_dice_bool": "SELECT CASE WHEN sum(quality) + sum(toxic) = 0 THEN 1e0 ELSE 2e0 * sum(quality * toxic) / (sum(quality) + sum(toxic)) END AS dice FROM {labels}",
    "agg_soft_dice": f"WITH {PIXEL} SELECT x AS image_id, {_ROUND(f'1e0 - (2e0 * sum({_P} * {_T}) + 1e-5) / (sum({_P}) + sum({_T}) + 1e-5)', 6)} AS loss FROM pixel GROUP BY x",
    "agg_focal": f"WITH {PIXEL}, p AS (SELECT fold, greatest(CASE WHEN {_T} = 1 THEN {_P} ELSE 1 - {_P} END, 1e-8) AS pt FROM pixel WHERE band <> 7) SELECT fold, {_ROUND('avg(-(1 - pt) * (1 - pt) * ln(pt))', 6)} AS loss FROM p GROUP BY fold",
    "agg_loss_mix": f"""WITH {PIXEL}, p AS (SELECT fold, {_P} AS p, {_T} AS t, greatest(CASE WHEN {_T} = 1 THEN {_P} ELSE 1 - {_P} END, 1e-8) AS pt FROM pixel)
        SELECT fold, {_ROUND('0.75e0 * avg(-(1 - pt) * (1 - pt) * ln(pt)) + 0.25e0 * (1e0 - (2e0 * sum(p * t) + 1e-5) / (sum(p) + sum(t) + 1e-5))', 6)} AS loss FROM p GROUP BY fold""",
    "agg_channel_weight": f"WITH {PIXEL}, w AS (SELECT x, y, max(v) / 255e0 AS weight FROM pixel WHERE band = 7 GROUP BY x, y) SELECT p.src, p.x, p.y, p.band, {_ROUND('p.v * greatest(w.weight, 0.16e0)', 6)} AS v FROM pixel p JOIN w ON p.x = w.x AND p.y = w.y WHERE p.band < 7",
    "fn_sigmoid": f"SELECT event_id, {_ROUND('1e0 / (1e0 + exp(-value))', 9)} AS p FROM {{events}}",
    "fn_clip_dtype": f"WITH {PIXEL} SELECT src, x, y, band, greatest(least(v * 1.5e0, max(v) OVER (PARTITION BY band)), 0e0) AS v FROM pixel",
    "fn_norm_tensor": f"WITH {PIXEL} SELECT src, x, y, band, v / 255e0 AS v FROM pixel",
    "fn_shift_scale": f"WITH {PIXEL} SELECT DISTINCT v, v / 255e0 AS shift FROM pixel",
    "fn_neighbor_offsets": "SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, CAST(dy * 100 + dx AS INT) AS linear FROM (SELECT dy, @series(-1, 1) AS dx FROM (SELECT @series(-1, 1) AS dy) a) b WHERE dy <> 0 OR dx <> 0",
    "fn_unravel": "SELECT o_orderkey AS linear, @div(o_orderkey, 100) - 1 AS row_, o_orderkey % 100 - 1 AS col_ FROM {orders}",
    "tf_sknw_mark": """WITH p AS (SELECT DISTINCT l_partkey % 200 AS x, l_suppkey % 100 AS y FROM {lineitem} WHERE l_quantity > 40),
        o AS (SELECT dy, dx FROM (SELECT dy, @series(-1, 1) AS dx FROM (SELECT @series(-1, 1) AS dy) a) b WHERE dy <> 0 OR dx <> 0),
        a AS (SELECT x + dx AS x, y + dy AS y FROM p CROSS JOIN o)
        SELECT p.x, p.y, CAST(count(a.x) AS BIGINT) AS neighbours, count(a.x) <> 2 AS is_node FROM p LEFT JOIN a ON p.x = a.x AND p.y = a.y GROUP BY p.x, p.y""",
    "img_stack": f"WITH {PIXEL} SELECT src, x, y, band, v FROM pixel UNION ALL SELECT src, x, y, 8, CASE WHEN v > 25 THEN 255e0 ELSE 0e0 END FROM pixel",
    "img_geom_aug": f"WITH {PIXEL}, p AS (SELECT x % 64 AS x, y % 64 AS y, max(v) AS v FROM pixel GROUP BY x % 64, y % 64) SELECT 'vflip' AS op, x, 63 - y AS y, v FROM p UNION ALL SELECT 'hflip', 63 - x, y, v FROM p UNION ALL SELECT 'transpose', y, x, v FROM p UNION ALL SELECT 'rot90', y, 63 - x, v FROM p UNION ALL SELECT 'crop', x - 16, y - 16, v FROM p WHERE x >= 16 AND x < 48 AND y >= 16 AND y < 48",
    "img_color_aug": f"WITH {PIXEL} SELECT src, x, y, 4 - band % 4 AS shuffled_band, 255e0 - v AS inverted, least(v + 20e0, 255e0) AS shifted FROM pixel",
    "sample_crop": "SELECT p_partkey AS image_id, CAST(floor((1400 + 60 * p_size - 1300) * (CAST(ascii(substring(md5(p_name), 1, 1)) % 16 AS DOUBLE) / 16e0)) AS BIGINT) AS x0 FROM {part}",
}

QUERIES: dict = {}
ORACLE_SQL = oracles(TEMPLATES)
