"""From predicted pixels to the submission: road mask, skeleton, lines, graph, speeds, travel times.

What needs a whole image (skeleton, lines, contraction, the boxes around midpoints) runs per image, on
rasters of one row per image and band, so no pixel is a row of a join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.functions import geo, rounded, travel
from roadweft.operators import kernels, lines
from roadweft.session import materialize

SOLUTION = ("ImageId", "WKT_Pix", "length_m", "travel_time_s")
#: Border that is replicated around a mask and cut from its skeleton, and what of the rim is cleared.
REPLICATE, CLIP = 5, 2
MOST_METRES = 5000.0
#: ``v`` is `raster_bytes` of the band.
RASTER = "image_id bigint, band int, v binary"
#: Images per task: rasters deflate to little, so tasks by bytes would be too few.
IMAGES = 48
#: Values of boxes that are sorted at once.
BOX_VALUES = 2_000_000


def raster_bytes(image: np.ndarray) -> bytes:
    """A band as little-endian doubles, row by row, deflated."""
    return zlib.compress(np.ascontiguousarray(image, "<f8").tobytes(), 1)


def raster_of(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<f8").reshape(height, width)


def rasters(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """RASTER of pixels (image_id, band, y, x, v), one band of an image at a time; missing ones are 0."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width))
        image[rows.y, rows.x] = rows.v.fillna(0)
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "band": rows.band.iloc[0], "v": [raster_bytes(image)]})

    own = pixels.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("band").cast("int").alias("band"), "y", "x", F.col("v").cast("double").alias("v"))
    return own.groupBy("image_id", "band").applyInPandas(step, RASTER)


def road_mask(band: np.ndarray, thresh: float, hole: int = 300, close: int = 7, open_: int = 7) -> np.ndarray:
    """Pixels above ``thresh`` of the brightest value possible, without areas and holes under ``hole``
    pixels, closed and opened."""
    return kernels.close_then_open(kernels.open_areas((band > 255 * thresh).astype(np.uint8), hole), close, open_)


def skeleton(band: np.ndarray, thresh: float, medial: bool = False, **sizes: int) -> np.ndarray:
    """Skeleton of a road band. Its border is replicated first, so that roads reach the rim, and what
    was added is cut off again, with CLIP pixels of the rim cleared."""
    mask = road_mask(np.pad(band, REPLICATE, mode="edge"), thresh, **sizes)
    found = kernels.medial_axis(mask) if medial else kernels.thin(mask)
    cut = REPLICATE + CLIP
    return np.pad(found[cut:-cut, cut:-cut], CLIP)


def road_edges(bands: DataFrame, height: int, width: int, band: int, thresh: float, medial: bool = False, spur: float = 10.0, **sizes: int) -> DataFrame:
    """Edges (lines.EDGE) of every image's road band; ``bands``: RASTER."""

    def step(batches):
        for rows in batches:
            for image_id, raw in zip(rows.image_id, rows.v):
                yield lines.skeleton_edges(int(image_id), skeleton(raster_of(raw, height, width), thresh, medial, **sizes), spur)

    return bands.filter(F.col("band") == band).mapInPandas(step, lines.EDGE)


def contracted(wkt: DataFrame, min_length: float = 0.0, max_nodes: int = 20) -> DataFrame:
    """(image_id, edge, points) of every image's lines (image_id, wkt): lines joined wherever exactly
    two ends meet, each once. Images' separate graphs of at most ``max_nodes`` points whose longest
    shortest path is under ``min_length`` pixels are left out."""
    read = wkt.select("image_id", geo.points_of(F.col("wkt")).alias("p")).filter(F.size("p") > 1)
    read = read.select("image_id", F.transform("p", lambda p: p["x"]).alias("along"), F.transform("p", lambda p: p["y"]).alias("down"))

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        legs = {}
        for xs, ys in zip(rows.along, rows.down):
            points = list(zip(xs.tolist(), ys.tolist()))
            for a, b in zip(points, points[1:]):
                if a != b:
                    legs.setdefault((min(a, b), max(a, b)), [a, b])
        kept = _long_enough(list(legs), min_length, max_nodes)
        joined = sorted(lines.merge_lines([legs[k] for k in legs if k in kept]))
        spots = [[{"x": x, "y": y} for x, y in line] for line in joined]
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "edge": range(len(spots)), "points": spots}, columns=["image_id", "edge", "points"])

    return read.groupBy("image_id").applyInPandas(step, "image_id bigint, edge bigint, points array<struct<x:double,y:double>>")


def _long_enough(legs: list[tuple], min_length: float, max_nodes: int) -> set[tuple]:
    """Legs (pairs of points) of the graphs that stay."""
    from roadweft.operators.components import Union
    from roadweft.operators.graph import _dijkstra

    nodes = {p: k for k, p in enumerate(sorted({p for leg in legs for p in leg}))}
    union, around = Union(len(nodes)), {k: [] for k in range(len(nodes))}
    for a, b in legs:
        w = float(np.hypot(a[0] - b[0], a[1] - b[1]))
        union.join(nodes[a], nodes[b])
        around[nodes[a]].append((nodes[b], w))
        around[nodes[b]].append((nodes[a], w))
    members: dict[int, list[int]] = {}
    for k in range(len(nodes)):
        members.setdefault(union.root(k), []).append(k)
    short = {root for root, own in members.items() if len(own) <= max_nodes and max(d for k in own for d, _ in _dijkstra(around, k).values()) < min_length}
    return {leg for leg in legs if union.root(nodes[leg[0]]) not in short}


def box_levels(image: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int, p: float) -> np.ndarray:
    """The truncated percentile, linear between ranks, of the pixels of ``image`` in the box of
    ``reach`` around every spot; what lies beyond the image doesn't count."""
    height, width = image.shape
    out = np.zeros(len(y), np.int64)
    span = np.arange(-reach, reach + 1)
    # what lies beyond sorts behind all pixels
    padded = np.pad(image, reach, constant_values=np.inf)
    inside = lambda at, size: np.maximum(np.minimum(at + reach + 1, size) - np.maximum(at - reach, 0), 0)
    area = inside(y, height) * inside(x, width)
    spots = np.flatnonzero(area)
    for part in np.array_split(spots, max(1, -(-len(spots) * len(span) ** 2 // BOX_VALUES))):
        # a spot beyond the rim has rows and columns beyond the padding, which hold no pixel either
        ys, xs = y[part, None] + reach + span, x[part, None] + reach + span
        beyond = ((ys < 0) | (ys >= padded.shape[0]))[:, :, None] | ((xs < 0) | (xs >= padded.shape[1]))[:, None, :]
        boxes = padded[np.clip(ys, 0, padded.shape[0] - 1)[:, :, None], np.clip(xs, 0, padded.shape[1] - 1)[:, None, :]]
        values = np.sort(np.where(beyond, np.inf, boxes).reshape(len(part), len(span) ** 2), axis=1)
        at = p * (area[part] - 1)
        low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
        row = np.arange(len(part))
        out[part] = np.floor(values[row, low] + (values[row, high] - values[row, low]) * (at - low))
    return out


def edge_speeds(edges: DataFrame, bands: DataFrame, height: int, width: int, channels: int, reach: int = travel.REACH, p: float = travel.PERCENTILE) -> DataFrame:
    """(image_id, edge, channel, mph): per edge the speed of the channel that is brightest in the boxes
    around the middles of its segments; ``bands``: RASTER, those that are missing are 0."""
    spots = travel.midpoints(edges, "image_id", "edge").select("image_id", "edge", "x", "y")

    def step(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        numbers, at = np.unique(rows.edge, return_inverse=True)
        total = np.zeros((channels, len(numbers)), np.int64)
        for band, raw in zip(own.band, own.v):
            level = box_levels(raster_of(raw, height, width), rows.y.to_numpy(), rows.x.to_numpy(), reach, p)
            np.add.at(total[band], at, level)
        found = {"image_id": rows.image_id.iloc[0] if len(rows) else 0, "edge": np.tile(numbers, channels), "channel": np.repeat(np.arange(channels), len(numbers)), "z": total.ravel()}
        return pd.DataFrame(found)

    speeds = bands.filter(F.col("band").between(0, channels - 1))
    level = spots.groupBy("image_id").cogroup(speeds.groupBy("image_id")).applyInPandas(step, "image_id bigint, edge bigint, channel int, z bigint")
    return travel.best_channel(level, "image_id", "edge")


def solution(pixels: DataFrame, height: int, width: int, *args, **options) -> DataFrame:
    """`raster_solution` of ``pixels`` (image_id, band from 0, y, x, v of 0 to 255); pixels that are
    missing are 0."""
    return raster_solution(rasters(pixels, height, width), height, width, *args, **options)


def raster_solution(
    bands: DataFrame, height: int, width: int, band: int = 7, thresh: float = 0.3, metres: float = 0.3, medial: bool = False, min_length: float = 0.0, spur: float = 10.0, **sizes: int
) -> DataFrame:
    """SOLUTION: a row per road edge of every image, and one LINESTRING EMPTY with zeros for an image
    without roads. ``bands`` (RASTER, values 0 to 255, one row per image and band): those below
    ``band`` are speed channels, ``band`` is all roads, missing ones are 0; ``metres`` is a pixel's
    size. Edges over MOST_METRES are an error. Images have the same size."""
    own = materialize(bands, "predicted")
    tasks = max(1, -(-own.select("image_id").distinct().count() // IMAGES))
    dealt = lambda df: df.repartition(tasks, "image_id")
    found = road_edges(dealt(own.filter(F.col("band") == band)), height, width, band, thresh, medial, spur, **sizes)
    wkt = lines.graph_lines(dealt(materialize(found, "road-edges")))
    edges = dealt(materialize(contracted(dealt(wkt), min_length), "road-lines"))
    lengths = edges.select("image_id", "edge", (geo.line_length(F.col("points")) * metres).alias("length_m"), geo.wkt_of(F.col("points")).alias("wkt"))
    lengths = lengths.withColumn("length_m", F.when(F.col("length_m") <= MOST_METRES, F.col("length_m")).otherwise(F.raise_error("an edge is too long")))
    timed = travel.travel_times(edge_speeds(edges, dealt(own), height, width, band), lengths, "image_id", "edge")
    every = own.select("image_id").distinct().join(timed, "image_id", "left")
    return every.select(
        F.col("image_id").cast("string").alias("ImageId"),
        F.coalesce("wkt", F.lit(geo.EMPTY)).alias("WKT_Pix"),
        F.coalesce(rounded(F.col("length_m"), 6), F.lit(0.0)).alias("length_m"),
        F.coalesce("travel_time_s", F.lit(0.0)).alias("travel_time_s"),
    )
