"""Pixel tables (image columns, x, y, band, v): merges, rescaling, masks, padding, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smoothing of the Dice coefficient and of its soft loss, and least probability in the focal loss.
DICE_ONE, SOFT, TINY = 1.0, 1e-5, 1e-8


def truncated_mean(pixels: DataFrame, *by: str) -> DataFrame:
    """(by..., v): the truncated mean of what overlaps, as merged folds and stitched tiles are."""
    return pixels.groupBy(*by).agg(F.floor(F.avg("v")).alias("v"))


def stitch(pixels: DataFrame, *by: str) -> DataFrame:
    """(by..., v, overlap): sum over count where tiles overlap, truncated, and the count."""
    return pixels.groupBy(*by).agg(F.floor(F.sum("v") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("overlap"))


def bounds(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(band, bmin, bmax): percentiles of every band; the lower one is 1 at least."""
    return pixels.groupBy("band").agg(F.greatest(F.lit(1.0), F.percentile("v", F.lit(low))).alias("bmin"), F.percentile("v", F.lit(high)).alias("bmax"))


def to_8bit(pixels: DataFrame, limits: DataFrame) -> DataFrame:
    """``pixels`` with v between its band's ``limits`` spread over 0 to 255, clipped, truncated."""
    spread = 255.0 * (F.col("v") - F.col("bmin")) / (F.col("bmax") - F.col("bmin"))
    joined = pixels.join(limits, "band").withColumn("v", F.floor(F.greatest(F.least(spread, F.lit(255.0)), F.lit(0.0))))
    return joined.drop("bmin", "bmax")


def gamma(value: Column, power: float = 1.66) -> Column:
    """An 8-bit value by the gamma table."""
    return F.floor(F.pow(value / 255.0, F.lit(1.0 / power)) * 255.0)


def one_hot(mask: DataFrame, channels: int = 7) -> DataFrame:
    """(x, y, band, v) of a mask (x, y, value): band value - 1 is 255, so is the last band, of all."""
    band = F.explode(F.sequence(F.lit(0), F.lit(channels))).alias("band")
    return mask.select("x", "y", "value", band).select("x", "y", "band", F.when((F.col("value") == F.col("band") + 1) | (F.col("band") == channels), 255).otherwise(0).alias("v"))


def flips(pixels: DataFrame, size: int) -> DataFrame:
    """The pixels of an image of ``size`` and of its three flips, turned back (x, y, v)."""
    x, y, back = F.col("x"), F.col("y"), lambda c: size - 1 - c
    ways = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (back(x), y), (x, back(y)), (back(x), back(y)))])
    return pixels.select(F.explode(ways).alias("at"), "v").select("at.x", "at.y", "v")


def pad(pixels: DataFrame, size: int, border: int) -> DataFrame:
    """Images (image_x, image_y, x, y, v) of ``size`` with ``border`` pixels mirrored on each side, the
    edge repeated; a pixel gives one to four, found from its own place."""
    places = lambda c: F.filter(
        F.array(F.col(c), F.when(F.col(c) < border, -1 - F.col(c)), F.when(F.col(c) >= size - border, 2 * size - 1 - F.col(c))), lambda p: p.isNotNull()
    )
    wide = pixels.select("image_x", "image_y", F.explode(places("x")).alias("x"), "y", "v")
    return wide.select("image_x", "image_y", "x", F.explode(places("y")).alias("y"), "v")


def cut_border(pixels: DataFrame, size: int, border: int) -> DataFrame:
    """Images without their outer ``border`` pixels, places counted from the new corner."""
    inside = lambda c: (F.col(c) >= border) & (F.col(c) < size - border)
    return pixels.filter(inside("x") & inside("y")).withColumn("x", F.col("x") - border).withColumn("y", F.col("y") - border)


def dice(p: Column, t: Column) -> Column:
    """Aggregate: Dice coefficient of predictions and targets, smoothed, within 0 to 1."""
    return F.greatest(F.least((2.0 * F.sum(p * t) + DICE_ONE) / (F.sum(p) + F.sum(t) + DICE_ONE), F.lit(1.0)), F.lit(0.0))


def soft_dice_loss(p: Column, t: Column) -> Column:
    return 1.0 - (2.0 * F.sum(p * t) + SOFT) / (F.sum(p) + F.sum(t) + SOFT)


def focal_loss(p: Column, t: Column, power: int = 2) -> Column:
    """Aggregate: mean focal loss."""
    right = F.greatest(F.when(t == 1, p).otherwise(1 - p), F.lit(TINY))
    return F.avg(-F.pow(1 - right, F.lit(float(power))) * F.log(right))


def mixed_loss(p: Column, t: Column, focal: float = 0.75, soft: float = 0.25) -> Column:
    return focal * focal_loss(p, t) + soft * soft_dice_loss(p, t)


def turned(pixels: DataFrame, size: int) -> DataFrame:
    """(op, x, y, v): the image flipped, transposed, turned by 90 degrees, and cropped to its middle."""
    x, y, back, quarter = F.col("x"), F.col("y"), lambda c: size - 1 - c, size // 4
    inside = x.between(quarter, size - quarter - 1) & y.between(quarter, size - quarter - 1)
    ways = {"vflip": (x, back(y)), "hflip": (back(x), y), "transpose": (y, x), "rot90": (y, back(x)), "crop": (F.when(inside, x - quarter), F.when(inside, y - quarter))}
    every = F.array(*[F.struct(F.lit(op).alias("op"), a.alias("x"), b.alias("y")) for op, (a, b) in ways.items()])
    return pixels.select(F.explode(every).alias("at"), "v").select("at.op", "at.x", "at.y", "v").filter("x IS NOT NULL")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, share): share of rows in each of ``bins`` even parts of 0 to 1, the last one closed."""
    placed = df.groupBy(F.least(F.floor(value * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = placed.agg(F.sum("n").alias("total"))  # one row
    return placed.crossJoin(total).select("bin", (F.col("n") / F.col("total")).alias("share"))
