"""Edge geometries in geographic and projected coordinates, vertex by vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.functions import geo

MOST_METRES = 5000.0


def _mapped(points: Column, to) -> Column:
    def one(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)


def located(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """``edges`` (image_id, u, v, points in pixels, ...) with points_geo (longitude, latitude), by their
    image's origin and pixel size in ``meta`` (image_id, x0, y0, pixel_x, pixel_y)."""
    joined = edges.join(meta.select("image_id", "x0", "y0", "pixel_x", "pixel_y"), "image_id")
    at = lambda x, y: geo.affine(x, y, F.col("x0"), F.col("pixel_x"), F.col("y0"), F.col("pixel_y"))
    return joined.withColumn("points_geo", _mapped(F.col("points"), at)).drop("x0", "y0", "pixel_x", "pixel_y")


def projected(edges: DataFrame, to: str = "utm") -> DataFrame:
    """``edges`` (image_id, u, v, points_geo, ...) with points_utm, utm_zone and utm_letter, or with
    points_3857. An image's zone is that of the first point of its first edge by (u, v)."""
    if to == "3857":
        return edges.withColumn("points_3857", _mapped(F.col("points_geo"), lambda x, y: geo.web_mercator(y, x)))
    if to != "utm":
        raise ValueError(f"unknown projection: {to}")
    first = edges.groupBy(F.col("image_id").alias("_image")).agg(F.min(F.struct("u", "v", F.col("points_geo")[0].alias("at"))).alias("first"))
    zones = first.select("_image", geo.utm_zone(F.col("first.at.x")).alias("utm_zone"), geo.utm_band(F.col("first.at.y")).alias("utm_letter"))
    joined = edges.join(zones, F.col("image_id") == F.col("_image")).drop("_image")
    return joined.withColumn("points_utm", _mapped(F.col("points_geo"), lambda x, y: geo.utm(y, x, F.col("utm_zone"))))


def measured(edges: DataFrame) -> DataFrame:
    """`projected` edges with their lengths in degrees and metres and their lines as WKT; an edge of
    over MOST_METRES is an error."""
    found = edges.withColumn("length_latlon", geo.line_length(F.col("points_geo"))).withColumn("length_utm", geo.line_length(F.col("points_utm")))
    checked = F.when(F.col("length_utm") <= MOST_METRES, F.col("length_utm")).otherwise(F.raise_error("an edge is too long"))
    return found.withColumn("length", checked).withColumn("geometry_latlon_wkt", geo.wkt_of(F.col("points_geo"), 6)).withColumn("geometry_utm_wkt", geo.wkt_of(F.col("points_utm"), 3))
