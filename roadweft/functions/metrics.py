"""Meters of a training run: means by epoch, the best epoch so far, steps of the learning rate, Dice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweft.functions import rounded


def meter(losses: DataFrame, *by: str) -> DataFrame:
    """(by..., loss, n): mean loss, to six digits."""
    return losses.groupBy(*by).agg(rounded(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


def best_so_far(epochs: DataFrame, patience: int = 5) -> DataFrame:
    """``epochs`` (epoch, loss) with the best loss so far, its last epoch, and whether ``patience``
    epochs went by since. One row an epoch, so one partition holds them."""
    order = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    found = epochs.withColumn("best", F.min("loss").over(order))
    found = found.withColumn("best_epoch", F.max(F.when(F.col("loss") == F.col("best"), F.col("epoch"))).over(order))
    return found.withColumn("stopped", F.col("epoch") - F.col("best_epoch") >= patience)


def learning_rate(epoch: Column, lr: float, gamma: float, steps: list[int]) -> Column:
    """The rate after the steps up to an epoch."""
    passed = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= epoch))
    return lr * F.pow(F.lit(gamma), passed.cast("double"))


def dice_of_flags(a: Column, b: Column) -> Column:
    """Aggregate: Dice coefficient of two columns of 0 and 1; two empty ones agree."""
    both = F.sum(a) + F.sum(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.sum(a * b) / both)
