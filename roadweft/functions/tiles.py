"""Tiles and crops of images: where they start, which there are, what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE, STRIDE, PAD = 1300, 1280, 64


def sequential_starts(big: Column, small: int = SLICE, pad: int = PAD) -> Column:
    """Ascending starts of the fewest crops of ``small`` that cover ``big`` and overlap by ``pad`` at
    least: even steps, whose overlap is what the crops have to spare, and a last one that ends at
    the rim. One crop starts at 0, also where it is larger than the image."""
    steps = F.ceil((big - pad) / (small - pad))
    overlap = F.floor((small * steps - big) / (steps - 1))
    last = (big - small).cast("bigint")
    starts = F.concat(F.sequence(F.lit(0).cast("bigint"), last - 1, (small - overlap).cast("bigint")), F.array(last))
    return F.when((big <= small) | (steps <= 1), F.array(F.lit(0).cast("bigint"))).otherwise(starts)


def tile_starts(size: Column, slice_: int = SLICE, stride: int = STRIDE) -> Column:
    """Distinct starts of tiles every ``stride`` that end at the rim where they would pass it."""
    many = F.floor((size - 2) / stride)
    steps = F.sequence(F.lit(0).cast("bigint"), many)
    return F.array_distinct(F.transform(steps, lambda i: F.least(i * stride, size - slice_).cast("bigint")))


def tiles(images: DataFrame, slice_: int = SLICE, stride: int = STRIDE) -> DataFrame:
    """``images`` (w, h, ...) with xmin and ymin: one row per tile."""
    wide = images.withColumn("xmin", F.explode(tile_starts(F.col("w"), slice_, stride)))
    return wide.withColumn("ymin", F.explode(tile_starts(F.col("h"), slice_, stride)))


def crops(images: DataFrame, small: int = SLICE, pad: int = PAD) -> DataFrame:
    """``images`` (w, h, ...) with x0 and y0: one row per sequential crop."""
    wide = images.withColumn("x0", F.explode(sequential_starts(F.col("w"), small, pad)))
    return wide.withColumn("y0", F.explode(sequential_starts(F.col("h"), small, pad)))


def tile_names(tiled: DataFrame, slice_: int = SLICE) -> DataFrame:
    """``tiles`` (image_id, name, ...) with tile: its number in the image, the image's name, its
    place, its size and the image's. Tiles of an image are few, so they are numbered by an array."""
    place = F.struct("xmin", "ymin", "name", "w", "h")
    every = tiled.groupBy("image_id").agg(F.array_sort(F.collect_list(place)).alias("all")).select("image_id", F.posexplode("all").alias("number", "at"))
    parts = ["at.name", "at.xmin", "at.ymin", F.lit(slice_), F.lit(slice_), "at.w", "at.h"]
    return every.select("image_id", F.concat(F.concat_ws("__", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in ["number", *parts]]), F.lit(".tif")).alias("tile"))
