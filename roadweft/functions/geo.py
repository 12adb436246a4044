"""Geography and plane geometry as column expressions: distances, projections, WKT, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH = 6371009.0
#: WGS84 (fixed values).
MAJOR, ECC2 = 6378137.0, 0.0066943799901413165
#: Latitude bands of UTM, 8 degrees each from -80 (fixed value).
BANDS = "CDEFGHJKLMNPQRSTUVWXX"
EMPTY = "LINESTRING EMPTY"


def haversine(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    h = half(lat, lat2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * half(lon, lon2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_band(lat: Column) -> Column:
    """Letter of the latitude band, null outside 80 degrees south to 84 north."""
    at = F.floor((lat + 80) / 8).cast("int")
    return F.when(lat.between(-80, 84), F.get(F.array(*[F.lit(b) for b in BANDS]), at))


def utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres by Snyder's series for the transverse Mercator projection; the
    southern hemisphere has no false northing here."""
    phi, e4, e6 = F.radians(lat), ECC2**2, ECC2**3
    prime = ECC2 / (1 - ECC2)
    n = MAJOR / F.sqrt(1 - ECC2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), prime * F.cos(phi) * F.cos(phi)
    a = F.cos(phi) * (F.radians(lon) - F.radians(zone * 6.0 - 183.0))
    power = lambda k: F.pow(a, F.lit(float(k)))
    arc = MAJOR * (
        (1 - ECC2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * ECC2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )
    east = a + (1 - t + c) * power(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * prime) * power(5) / 120
    up = power(2) / 2 + (5 - t + 9 * c + 4 * c * c) * power(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * prime) * power(6) / 720
    return 500000.0 + 0.9996 * n * east, 0.9996 * (arc + n * F.tan(phi) * up)


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in EPSG:3857."""
    return MAJOR * F.radians(lon), MAJOR * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def affine(col: Column, row: Column, x0: Column, width: Column, y0: Column, height: Column) -> tuple[Column, Column]:
    """Where a pixel lies, by the raster's origin and pixel size, north up."""
    return col * width + x0, row * height + y0


def points_of(wkt: Column) -> Column:
    """Points (x, y) of a LINESTRING of any number of points; none for LINESTRING EMPTY, null for what
    is no line."""
    body = F.regexp_extract(wkt, r"(?is)^\s*LINESTRING(?:\s+Z)?\s*\((.*)\)\s*$", 1)
    number = lambda parts, k: F.get(parts, F.lit(k)).try_cast("double")
    parts = F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(parts, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    none = F.filter(points, lambda p: F.lit(False))
    return F.when(F.regexp_like(wkt, F.lit(r"(?i)^\s*LINESTRING\s+EMPTY\s*$")), none).when(body != "", points)


def wkt_of(points: Column, digits: int = 1) -> Column:
    """WKT of points (x, y), with ``digits`` decimals; LINESTRING EMPTY for none."""
    shown = F.transform(points, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["x"], p["y"]))
    return F.when(F.size(points) > 0, F.concat(F.lit("LINESTRING ("), F.array_join(shown, ", "), F.lit(")"))).otherwise(EMPTY)


def distance(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))


def line_length(points: Column) -> Column:
    """Length of a line of points (x, y); 0 for fewer than two."""
    pairs = F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def segments(points: DataFrame, *by: str) -> DataFrame:
    """Segments between neighbours of ``points`` (by..., i, x, y, ...): x2, y2 and length are added."""
    order = Window.partitionBy(*by).orderBy("i")
    found = points.withColumn("x2", F.lead("x").over(order)).withColumn("y2", F.lead("y").over(order)).filter("x2 IS NOT NULL")
    return found.withColumn("length", distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))


def along(segmented: DataFrame, *by: str) -> DataFrame:
    """Adds position: how far along its line a segment starts."""
    before = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return segmented.withColumn("position", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle in degrees from vector a to vector b."""
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def off_line(x: Column, y: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """Signed distance of a point from the line through two others; null where they coincide."""
    length = distance(x, y, x2, y2)
    return F.when(length > 0, ((x2 - x) * (py - y) - (y2 - y) * (px - x)) / length)


def off_chord(x: Column, y: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """Distance of a point from the line through two others, or from the point where they coincide."""
    return F.coalesce(F.abs(off_line(x, y, x2, y2, px, py)), distance(x, y, px, py))
