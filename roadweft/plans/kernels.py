"""Queries of the whole-image kernels; an image is the pixels of 100 parts, 100 x 100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweft.functions import rounded
from roadweft.operators import kernels
from roadweft.session import table


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): the brightest value of each pixel."""
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 100).alias("image_id"), (F.col("l_partkey") % 100).cast("int").alias("y"), (F.col("l_suppkey") % 100).cast("int").alias("x"), F.col("l_quantity").alias("v"))
    return rows.groupBy("image_id", "y", "x").agg(F.max("v").alias("v"))


def _grid(rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros((100, 100))
    out[rows.y, rows.x] = rows.v
    return out


def _mask(rows: pd.DataFrame) -> np.ndarray:
    return kernels.dilate((_grid(rows) > 40).astype(np.uint8), 3)


def _pixels(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = make(rows)
            y, x = np.nonzero(out)
            return pd.DataFrame({"image_id": rows.image_id.iloc[0], "y": y, "x": x, "v": np.asarray(out, float)[y, x]})

        return images(spark, sf_dir).groupBy("image_id").applyInPandas(step, "image_id bigint, y int, x int, v double")

    return run


def tf_sknw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, _ = kernels.skeleton_graph(kernels.thin(_mask(rows)))
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "node": range(len(nodes)), "y": [n[0] for n in nodes], "x": [n[1] for n in nodes]})

    return images(spark, sf_dir).groupBy("image_id").applyInPandas(step, "image_id bigint, node bigint, y double, x double")


def tf_sknw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        _, edges = kernels.skeleton_graph(kernels.thin(_mask(rows)))
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "u": [e[0] for e in edges], "v": [e[1] for e in edges], "weight": [e[2] for e in edges]})

    return images(spark, sf_dir).groupBy("image_id").applyInPandas(step, "image_id bigint, u bigint, v bigint, weight double")


def gr_rdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def step(batches):
        for rows in batches:
            out = []
            for vec, e in zip(rows.vec_id, rows.e):
                kept = kernels.simplify_line(np.asarray(e).reshape(-1, 2), 0.1)
                out.append(pd.DataFrame({"vec_id": vec, "pos": range(len(kept)), "x": kept[:, 0], "y": kept[:, 1]}))
            yield pd.concat(out) if out else pd.DataFrame({"vec_id": [], "pos": [], "x": [], "y": []})

    return lines.mapInPandas(step, "vec_id bigint, pos int, x double, y double")


def img_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    blurred = _pixels(lambda rows: kernels.blur(_grid(rows)))(spark, sf_dir)
    return blurred.withColumn("v", rounded(F.col("v"), 6))


QUERIES = {
    "tf_skeleton": _pixels(lambda rows: kernels.thin(_mask(rows))),
    "tf_area_open": _pixels(lambda rows: kernels.open_areas(_mask(rows), 20)),
    "tf_morph": _pixels(lambda rows: kernels.close_then_open(_mask(rows), 3, 3)),
    "img_blur": img_blur,
    "tf_sknw_nodes": tf_sknw_nodes,
    "tf_sknw_edges": tf_sknw_edges,
    "gr_rdp": gr_rdp,
}

_PIXEL = "pixel AS (SELECT l_partkey // 100 AS image_id, l_partkey % 100 AS y, l_suppkey % 100 AS x, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
_AROUND = "(SELECT dy, dx FROM (VALUES (-1), (0), (1)) AS a(dy) CROSS JOIN (VALUES (-1), (0), (1)) AS b(dx)) o"
_INSIDE = "y + dy BETWEEN 0 AND 99 AND x + dx BETWEEN 0 AND 99"
_dilated = lambda name: f"SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM {name} CROSS JOIN {_AROUND} WHERE {_INSIDE}"
# a pixel stays if all of its neighbours inside the image are there
_eroded = lambda name: f"SELECT image_id, y, x FROM (SELECT image_id, y + dy AS y, x + dx AS x, count(*) AS n FROM {name} CROSS JOIN {_AROUND} WHERE {_INSIDE} GROUP BY 1, 2, 3) e WHERE n = (least(y + 1, 99) - greatest(y - 1, 0) + 1) * (least(x + 1, 99) - greatest(x - 1, 0) + 1)"

ORACLE_SQL: dict[str, str] = {
    "tf_morph": f"""WITH {_PIXEL}, m0 AS (SELECT image_id, y, x FROM pixel WHERE v > 40), m1 AS ({_dilated("m0")}), m2 AS ({_dilated("m1")}), m3 AS ({_eroded("m2")}), m4 AS ({_eroded("m3")}), m5 AS ({_dilated("m4")})
        SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 1e0 AS v FROM m5""",
    "img_blur": f"""WITH {_PIXEL}, k AS (SELECT i, exp(-i * i / (2 * pow(0.3e0 * 2 + 0.8e0, 2))) AS w FROM range(-3, 4) r(i)), n AS (SELECT i, w / sum(w) OVER () AS w FROM k),
        t AS (SELECT o AS place, CASE WHEN o + i < 0 THEN -(o + i) WHEN o + i > 99 THEN 198 - (o + i) ELSE o + i END AS src, sum(w) AS w FROM range(0, 100) p(o) CROSS JOIN n GROUP BY 1, 2),
        down AS (SELECT image_id, t.place AS y, x, sum(v * w) AS v FROM pixel JOIN t ON t.src = y GROUP BY 1, 2, 3)
        SELECT image_id, CAST(y AS INT) AS y, CAST(t.place AS INT) AS x, round_even(sum(v * w) * 1e6, 0) / 1e6 AS v FROM down JOIN t ON t.src = x GROUP BY 1, 2, 3""",
    "gr_rdp": """WITH RECURSIVE pt AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM (SELECT vec_id, embedding, unnest(range(0, 32)) AS i FROM embeddings) e),
        seg(vec_id, a, b) AS (SELECT DISTINCT vec_id, CAST(0 AS BIGINT), CAST(31 AS BIGINT) FROM pt UNION ALL
            SELECT f.vec_id, CASE side WHEN 0 THEN f.a ELSE f.k END, CASE side WHEN 0 THEN f.k ELSE f.b END FROM (
                SELECT s.vec_id, s.a, s.b, arg_max(p.i, abs((p.x - l.x) * (r.y - l.y) - (p.y - l.y) * (r.x - l.x)) / sqrt(pow(r.x - l.x, 2) + pow(r.y - l.y, 2))) AS k,
                       max(abs((p.x - l.x) * (r.y - l.y) - (p.y - l.y) * (r.x - l.x)) / sqrt(pow(r.x - l.x, 2) + pow(r.y - l.y, 2))) AS far
                FROM seg s JOIN pt p ON p.vec_id = s.vec_id AND p.i > s.a AND p.i < s.b JOIN pt l ON l.vec_id = s.vec_id AND l.i = s.a JOIN pt r ON r.vec_id = s.vec_id AND r.i = s.b GROUP BY s.vec_id, s.a, s.b) f
            CROSS JOIN (VALUES (0), (1)) AS t(side) WHERE f.far >= 0.1e0),
        kept AS (SELECT vec_id, a AS i FROM seg UNION SELECT vec_id, b FROM seg)
        SELECT k.vec_id, CAST(row_number() OVER (PARTITION BY k.vec_id ORDER BY k.i) - 1 AS INT) AS pos, p.x, p.y FROM kept k JOIN pt p ON p.vec_id = k.vec_id AND p.i = k.i""",
}
