"""Masks and pixel tables (image columns, x, y, band, v): filters, thresholds, burning, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flipped(c: Column, size: int) -> Column:
    return size - 1 - c


def share(condition: Column) -> Column:
    """Aggregate: share of rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def bright_tiles(pixels: DataFrame, *by: str, least: float = 1.0) -> DataFrame:
    """(by..., m): tiles whose brightest value m reaches ``least``; black ones go."""
    return pixels.groupBy(*by).agg(F.max("v").alias("m")).filter(F.col("m") >= least)


def mostly_valid(pixels: DataFrame, *by: str, null: float, most: float) -> DataFrame:
    """(by..., zero_frac): images with less than ``most`` of values up to ``null``."""
    return pixels.groupBy(*by).agg(share(F.col("v") <= null).alias("zero_frac")).filter(F.col("zero_frac") < most)


def without_null(pixels: DataFrame, by: str, null: float, least: float) -> DataFrame:
    """``pixels`` with mask: 0 where a value is null in an image of at least ``least`` of such, else the
    band."""
    part = pixels.groupBy(F.col(by).alias("_by")).agg(share(F.col("v") <= null).alias("_zero"))
    joined = pixels.join(part, F.col(by) == F.col("_by"))
    return joined.withColumn("mask", F.when((F.col("_zero") >= least) & (F.col("v") <= null), 0).otherwise(F.col("band"))).drop("_by", "_zero")


def opaque_tiles(pixels: DataFrame, *by: str, least: float) -> DataFrame:
    """(by..., alpha): tiles whose mean alpha is over ``least``."""
    return pixels.groupBy(*by).agg(F.avg("v").alias("alpha")).filter(F.col("alpha") > least)


def above(pixels: DataFrame, thresh: float, most: float) -> DataFrame:
    """Pixels brighter than a share of the brightest value possible; of several bands the brightest."""
    return pixels.groupBy("x", "y").agg(F.max("v").alias("v")).filter(F.col("v") > most * thresh)


def border_fixed(pixels: DataFrame, size: int, replicate: int = 5, clip: int = 2) -> DataFrame:
    """A skeleton that was made with ``replicate`` border pixels more: these are cut, with ``clip``
    pixels of the rim, which are blank then."""
    cut, last = replicate + clip, size + 2 * replicate - replicate - clip
    inside = lambda c: (F.col(c) + replicate >= cut) & (F.col(c) + replicate < last)
    return pixels.filter(inside("x") & inside("y"))


def dissolved(pixels: DataFrame, by: list[str], first: list[str], order: str) -> DataFrame:
    """(by..., x, y, first...): the union of the pixels of every group, with the other columns of its
    first row in ``order``."""
    kept = pixels.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.min_by(F.struct(*first), order).alias("_first"))
    union = pixels.select(*by, "x", "y").distinct()
    joined = union.join(kept, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return joined.select(*by, "x", "y", *[F.col(f"_first.{c}").alias(c) for c in first])


def burned(pixels: DataFrame, *order: str) -> DataFrame:
    """(x, y, burned): the value of the last shape, in ``order``, that covers a pixel."""
    return pixels.groupBy("x", "y").agg(F.max_by("v", F.struct(*order)).alias("burned"))


def area(images: DataFrame, metres: float) -> DataFrame:
    """(pixels, km2) of images (w, h)."""
    total = images.agg(F.sum(F.col("w").cast("bigint") * F.col("h")).alias("pixels"))
    return total.select("pixels", (F.col("pixels") * metres * metres / 1e6).alias("km2"))


def mean_height(pixels: DataFrame, by: str) -> DataFrame:
    """(mean_height, n): mean of surface (odd bands) less terrain (even bands), where both are there."""
    odd = F.col("band") % 2 == 1
    both = pixels.groupBy(by).agg(F.max(F.when(odd, F.col("v"))).alias("dsm"), F.max(F.when(~odd, F.col("v"))).alias("dtm"))
    return both.filter("dsm IS NOT NULL AND dtm IS NOT NULL").agg(F.avg(F.col("dsm") - F.col("dtm")).alias("mean_height"), F.count(F.lit(1)).alias("n"))


def weighted_channels(pixels: DataFrame, last: int, least: float) -> DataFrame:
    """Channels below ``last`` times that channel's weight at their place, ``least`` at least."""
    weight = pixels.filter(F.col("band") == last).groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg((F.max("v") / 255.0).alias("_w"))
    joined = pixels.filter(F.col("band") < last).join(weight, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    return joined.withColumn("v", F.col("v") * F.greatest("_w", F.lit(least))).drop("_x", "_y", "_w")


def clipped(pixels: DataFrame, value: Column) -> DataFrame:
    """``pixels`` with ``value`` as v, clipped to 0 and the greatest v that its band had."""
    most = pixels.groupBy(F.col("band").alias("_band")).agg(F.max("v").alias("_most"))
    joined = pixels.join(most, F.col("band") == F.col("_band"))
    return joined.withColumn("v", F.greatest(F.least(value, F.col("_most")), F.lit(0.0))).drop("_band", "_most")


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def neighbours() -> list[tuple[int, int]]:
    """Offsets of the eight neighbours, row by row."""
    return [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def marked(mask: DataFrame) -> DataFrame:
    """``mask`` (x, y) with its number of neighbours and whether it is a node of a skeleton, having
    other than two. Every pixel counts itself to its neighbours' places."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in neighbours()])
    given = mask.select("x", "y", F.explode(around).alias("o")).groupBy((F.col("x") + F.col("o.dx")).alias("_x"), (F.col("y") + F.col("o.dy")).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    joined = mask.join(given, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").withColumn("neighbours", F.coalesce("_n", F.lit(0)))
    return joined.select("x", "y", "neighbours", (F.col("neighbours") != 2).alias("is_node"))


def stacked(pixels: DataFrame, mask: Column, band: int) -> DataFrame:
    """``pixels`` and their mask as one more band."""
    return pixels.unionByName(pixels.withColumn("band", F.lit(band)).withColumn("v", mask))


def shuffled_band(band: Column) -> Column:
    return 4 - band % 4


def inverted(v: Column) -> Column:
    return 255.0 - v


def shifted(v: Column, by: float) -> Column:
    """A channel shifted, clipped to 8 bits."""
    return F.greatest(F.least(v + by, F.lit(255.0)), F.lit(0.0))
