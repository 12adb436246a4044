"""Speed and travel time of road edges from the values of a mask around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.functions import geo, rounded
from roadweft.functions.speeds import MILES, MPS, channel_mph, nearest_speed

PERCENTILE, LEAST, REACH = 0.85, 128, 6
NO_SPEED = -1.0


def midpoints(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., seg, x, y, length): the middle pixel and the length of every segment of ``lines``
    (by..., points)."""
    n = F.greatest(F.size("points") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("points", 1, n).alias("a"), F.slice("points", 2, n).alias("b"))
    rows = lines.select(*by, F.posexplode(pairs).alias("seg", "p"))
    middle = lambda c: F.rint((F.col(f"p.a.{c}") + F.col(f"p.b.{c}")) * 0.5).cast("bigint").alias(c)
    return rows.select(*by, "seg", middle("x"), middle("y"), geo.distance(F.col("p.a.x"), F.col("p.a.y"), F.col("p.b.x"), F.col("p.b.y")).alias("length"))


def patches(spots: DataFrame, pixels: DataFrame, on: list[str], reach: int = REACH) -> DataFrame:
    """Pixels of ``pixels`` (on..., x, y, ...) in the box of ``reach`` around every spot (on..., x, y,
    ...), one row per pair, with the spot's place as spot_x and spot_y. An equi-join on the box's
    pixels, of which there are (2 reach + 1) squared."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    box = spots.withColumnRenamed("x", "spot_x").withColumnRenamed("y", "spot_y")
    box = box.withColumn("x", F.explode(F.transform(step, lambda k: F.col("spot_x") + k))).filter("x >= 0")
    box = box.withColumn("y", F.explode(F.transform(step, lambda k: F.col("spot_y") + k))).filter("y >= 0")
    return box.join(pixels, [*on, "x", "y"])


def box_size(spots: DataFrame, height: Column, width: Column, reach: int = REACH) -> DataFrame:
    """``spots`` with area: how many pixels of an image of that size their box holds."""
    span = lambda c, size: F.least(F.col(c) + reach + 1, size) - F.greatest(F.col(c) - reach, F.lit(0))
    return spots.withColumn("area", F.greatest(span("x", width), F.lit(0)) * F.greatest(span("y", height), F.lit(0)))


def sparse_percentile(values: Column, count: Column, p: float) -> Column:
    """Percentile, linear between ranks, of ``count`` values of which those not in the array are 0
    and no other is negative."""
    ascending = F.array_sort(values)
    zeros = count - F.size(ascending)
    at = p * (count - 1)
    value = lambda k: F.when(k < zeros, 0.0).otherwise(F.get(ascending, (k - zeros).cast("int")))
    low, high = F.floor(at), F.ceil(at)
    return value(low) + (value(high) - value(low)) * (at - low)


def levels(values: DataFrame, *by: str, p: float = PERCENTILE) -> DataFrame:
    """(by..., channel, z): the truncated percentile of each band's values in a patch (by..., band, v)."""
    return values.groupBy(*by, F.col("band").alias("channel")).agg(F.floor(F.percentile("v", F.lit(p))).alias("z"))


def patch_speeds(level: DataFrame, *by: str, least: int = LEAST) -> DataFrame:
    """(by..., weighted_mph, argmax_mph): mean speed of the channels over ``least`` weighted by their
    level, and the speed of the highest channel (of equal ones the first); NO_SPEED where none is."""
    hit, speed = F.col("z") > least, channel_mph(F.col("channel"))
    top = F.max(F.struct("z", (-F.col("channel")).alias("c")))
    found = level.groupBy(*by).agg((F.sum(F.when(hit, F.col("z") * speed)) / F.sum(F.when(hit, F.col("z")))).alias("weighted"), top.alias("top"))
    best = F.when(F.col("top.z") >= least, channel_mph(-F.col("top.c"))).otherwise(NO_SPEED)
    return found.select(*by, F.coalesce("weighted", F.lit(NO_SPEED)).alias("weighted_mph"), best.alias("argmax_mph"))


def median_of_top(values: DataFrame, *by: str, p: float = 0.8) -> DataFrame:
    """(by..., median, speed): the median of a patch's values that reach its percentile, and the speed
    of the burn value nearest to it."""
    cut = values.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.percentile("v", F.lit(p)).alias("cut"))
    same = [F.col(b) == F.col(f"_{b}") for b in by]
    top = values.join(cut, same).filter(F.col("v") >= F.col("cut")).groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("median"))
    return top.withColumn("speed", nearest_speed(F.col("median")))


def weighted_mean_std(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, mean, std) of ``value`` weighted by ``weight``."""
    mean = df.groupBy(F.col(by).alias("_by")).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"))
    off = F.col(value) - F.col("mean")
    return df.join(mean, F.col(by) == F.col("_by")).groupBy(by).agg(F.max("mean").alias("mean"), F.sqrt(F.sum(F.col(weight) * off * off) / F.sum(weight)).alias("std"))


def best_channel(level: DataFrame, *by: str) -> DataFrame:
    """(by..., channel, mph): the channel whose levels sum highest over an edge's patches, of equal
    ones the first."""
    total = level.groupBy(*by, "channel").agg(F.sum("z").alias("z"))
    best = total.groupBy(*by).agg(F.max(F.struct("z", (-F.col("channel")).alias("c"))).alias("top"))
    return best.select(*by, (-F.col("top.c")).alias("channel"), channel_mph(-F.col("top.c")).alias("mph"))


def travel_times(speeds: DataFrame, lengths: DataFrame, *by: str) -> DataFrame:
    """``speeds`` (by..., mph, ...) of edges with their length_m, length_miles, inferred_speed_mph and
    _mps, and travel_time_s; ``lengths``: (by..., length_m)."""
    found = speeds.join(lengths, list(by)).withColumn("length_miles", F.col("length_m") * MILES)
    found = found.withColumn("inferred_speed_mph", rounded(F.col("mph"), 2)).withColumn("inferred_speed_mps", rounded(F.col("mph") * MPS, 2))
    return found.withColumn("travel_time_s", rounded(3600.0 * F.col("length_miles") / F.col("mph"), 3))
