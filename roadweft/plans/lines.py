"""Road lines from images, buffers and masks of roads, augmentations composed on pixel tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.operators import kernels, lines
from roadweft.plans.dual import oracles, spark_query
from roadweft.plans.geometry import POLYLINE
from roadweft.plans.kernels import _mask, images
from roadweft.session import materialize, table

#: Polylines as roads on images of 10 road files, in pixels; a road's file order is vec_id.
ROAD = f"""{POLYLINE}, pt AS (SELECT vec_id, label, i, @rint((x + 0.6e0) * 50e0) AS x, @rint((y + 0.6e0) * 50e0) AS y FROM polyline),
    road AS (SELECT * FROM (SELECT vec_id, label, i, x, y, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS x2, lead(y) OVER (PARTITION BY vec_id ORDER BY i) AS y2 FROM pt) t WHERE x2 IS NOT NULL)"""
#: Pixels at most 2 from a segment; only those of the segment's widened box are looked at.
BUFFER = f"""{ROAD}, box AS (SELECT *, @series(CAST(least(x, x2) AS BIGINT) - 2, CAST(greatest(x, x2) AS BIGINT) + 2) AS px FROM road),
    spot AS (SELECT *, @series(CAST(least(y, y2) AS BIGINT) - 2, CAST(greatest(y, y2) AS BIGINT) + 2) AS py FROM box),
    foot AS (SELECT vec_id, label, px, py, x, y, x2 - x AS dx, y2 - y AS dy, coalesce(greatest(least(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / nullif((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y), 0e0), 1e0), 0e0), 0e0) AS t FROM spot),
    buffer AS (SELECT DISTINCT vec_id, label, px, py FROM foot WHERE (px - x - t * dx) * (px - x - t * dx) + (py - y - t * dy) * (py - y - t * dy) <= 4e0)"""
_DRAW = lambda name: f"substring(md5(concat(CAST(image_id AS STRING), ':{name}:42')), 1, 1)"
#: Images of 64 x 64 pixels, three bands, with a mask.
CHIP = "chip AS (SELECT l_partkey % 50 AS image_id, CAST(l_partkey % 64 AS INT) AS x, CAST(l_suppkey % 64 AS INT) AS y, max(CAST(l_quantity * 5 AS INT)) AS b, max(CAST(l_discount * 2000 AS INT)) AS g, max(CAST(l_tax * 3000 AS INT)) AS r, max(CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END) AS mask FROM {lineitem} GROUP BY 1, 2, 3)"
#: Factors of hue, saturation and value for four copies of an image, from 0.5 to 1.5 (seed 42).
FACTOR = "factor AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {h!r}e0, {s!r}e0, {v!r}e0)" for k, (h, s, v) in enumerate((np.random.RandomState(42).random_sample((4, 3)).round(6) + 0.5).tolist())) + ") AS f(copy, fh, fs, fv))"
#: 8-bit hue (0 to 180), saturation and value, and back, by the usual hexagon.
HSV = f"""{CHIP}, top AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS c FROM chip),
    hue AS (SELECT *, CASE WHEN c = 0 THEN 0e0 WHEN v = r THEN 30e0 * (g - b) / c WHEN v = g THEN 60e0 + 30e0 * (b - r) / c ELSE 120e0 + 30e0 * (r - g) / c END AS h0, CASE WHEN v = 0 THEN 0e0 ELSE @rint(255e0 * c / v) END AS s FROM top),
    hsv AS (SELECT image_id, x, y, mask, @rint(CASE WHEN h0 < 0 THEN h0 + 180e0 ELSE h0 END) AS h, s, v FROM hue),
    scaled AS (SELECT image_id, x, y, mask, copy, least(floor(h * fh), 255e0) AS h, least(floor(s * fs), 255e0) AS s, least(floor(v * fv), 255e0) AS v FROM hsv CROSS JOIN factor),
    sector AS (SELECT *, CAST(floor(h / 30e0) AS INT) % 6 AS k, h / 30e0 - floor(h / 30e0) AS f FROM scaled),
    mix AS (SELECT *, @rint(v * (1e0 - s / 255e0)) AS p0, @rint(v * (1e0 - s / 255e0 * f)) AS q0, @rint(v * (1e0 - s / 255e0 * (1e0 - f))) AS t0 FROM sector),
    bgr AS (SELECT image_id, x, y, mask, copy, CASE k WHEN 0 THEN p0 WHEN 1 THEN p0 WHEN 2 THEN t0 WHEN 3 THEN v WHEN 4 THEN v ELSE q0 END AS b,
        CASE k WHEN 0 THEN t0 WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q0 ELSE p0 END AS g, CASE k WHEN 0 THEN v WHEN 1 THEN q0 WHEN 2 THEN p0 WHEN 3 THEN p0 WHEN 4 THEN t0 ELSE v END AS r FROM mix)"""

TEMPLATES = {
    "geo_buffer": f"WITH {BUFFER} SELECT vec_id, px, py FROM buffer",
    # roads of skipped types leave no trace, later roads overwrite earlier ones
    "geo_roadmask": f"""WITH {BUFFER} SELECT CAST(label AS BIGINT) AS image_id, px, py, max_by(CAST(ceil((5 + vec_id % 61) / 10e0) * 36 AS INT), vec_id) AS burned
        FROM buffer WHERE vec_id % 7 <> 3 GROUP BY label, px, py""",
    # flip, then one of rotation, transposition or nothing, on image and mask; then maybe inversion, on the image alone
    "aug_compose": f"""WITH {CHIP}, drawn AS (SELECT *, {_DRAW('flip')} < '8' AS flip, {_DRAW('one')} AS one, {_DRAW('invert')} < '8' AS invert FROM chip),
        flipped AS (SELECT image_id, one, invert, CASE WHEN flip THEN 63 - x ELSE x END AS x, y, b, mask FROM drawn)
        SELECT image_id, CASE WHEN one < 'a' THEN y ELSE x END AS x, CASE WHEN one < '5' THEN 63 - x WHEN one < 'a' THEN x ELSE y END AS y,
               CASE WHEN invert THEN 255 - b ELSE b END AS value, mask FROM flipped""",
    # per image two files: upside down or turned by 180 degrees, turned by 90 or by 270
    "img_augment_file": f"""WITH {FACTOR}, {HSV}, coin AS (SELECT *, {_DRAW('half')} < '8' AS half, {_DRAW('quarter')} < '8' AS quarter FROM bgr),
        turned AS (
            SELECT image_id, CASE WHEN half THEN 'ud' ELSE 'rot180' END AS file, CASE WHEN half THEN x ELSE 63 - x END AS x, 63 - y AS y, b, g, r, mask FROM coin WHERE copy = CASE WHEN half THEN 1 ELSE 3 END
            UNION ALL
            SELECT image_id, CASE WHEN quarter THEN 'rot90' ELSE 'rot270' END, CASE WHEN quarter THEN y ELSE 63 - y END, CASE WHEN quarter THEN 63 - x ELSE x END, b, g, r, mask FROM coin WHERE copy = 3)
        SELECT image_id, file, x, y, CAST(b AS INT) AS b, CAST(g AS INT) AS g, CAST(r AS INT) AS r, mask FROM turned""",
    "win_position_chunk": "SELECT c_custkey, CAST(@div(row_number() OVER (ORDER BY c_name) - 1, 12) AS BIGINT) AS line FROM {customer}",
}

ORACLE_SQL = oracles(TEMPLATES)


def gr_img2g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every image's pruned skeleton graph."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return lines.image_edges(int(rows.image_id.iloc[0]), _mask(rows))

    return images(spark, sf_dir).groupBy("image_id").applyInPandas(step, lines.EDGE)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(gr_img2g(spark, sf_dir), "image-edges")


def gr_simplify_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straightened lines of all edges, their ends at the nodes."""

    def step(batches):
        for rows in batches:
            found = [lines.snap_line(np.stack([r.ys, r.xs], 1), np.array([r.yu, r.xu]), np.array([r.yv, r.xv])) for r in rows.itertuples()]
            yield rows[["image_id", "u", "v", "key"]].assign(y=[p[:, 0].tolist() for p in found], x=[p[:, 1].tolist() for p in found])

    return gr_img2g(spark, sf_dir).mapInPandas(step, "image_id bigint, u bigint, v bigint, key int, y array<int>, x array<int>")


def gr_bridge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.bridges(_edges(spark, sf_dir))


def gr_to_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the images that have a graph."""
    return lines.graph_lines(_edges(spark, sf_dir))


def gr_dir2wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all images; one without roads has one empty line."""
    every = images(spark, sf_dir).select("image_id").distinct()
    return every.join(gr_to_wkt(spark, sf_dir), "image_id", "left").select("image_id", F.coalesce("wkt", F.lit(lines.EMPTY)).alias("wkt"))


def gr_linemerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines in four pieces, every other one reversed, merged to one line and straightened."""

    def step(batches):
        for rows in batches:
            out = []
            for vec, e in zip(rows.vec_id, rows.e):
                points = np.asarray(e).reshape(-1, 2)
                pieces = [points[k : k + 9][:: 1 if k % 16 else -1] for k in range(0, len(points) - 1, 8)]
                for line in lines.merge_lines(pieces):
                    kept = kernels.simplify_line(np.array(line), 0.1)
                    out.append((vec, len(line), len(kept), round(kernels.path_length(kept), 9)))
            yield pd.DataFrame(out, columns=["vec_id", "merged", "kept", "length"])

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.mapInPandas(step, "vec_id bigint, merged bigint, kept bigint, length double")


QUERIES = {f.__name__: f for f in (gr_img2g, gr_simplify_pts, gr_bridge_gaps, gr_to_wkt, gr_dir2wkt, gr_linemerge)}
# the hexagon of hues is stated once for both sides
QUERIES["img_augment_file"] = spark_query(TEMPLATES["img_augment_file"])
