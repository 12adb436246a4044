"""Sequences of rows by a key: pairs, repeats, runs, pieces between repeated segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairwise(steps: DataFrame, by: str, value: str) -> DataFrame:
    """(by, pos, s, e): every value and the next one; ``steps``: by, pos, value."""
    after = F.lead(value).over(Window.partitionBy(by).orderBy("pos"))
    return steps.select(by, "pos", F.col(value).alias("s"), after.alias("e")).filter("e IS NOT NULL")


def without_repeats(steps: DataFrame, by: str, value: str) -> DataFrame:
    """``steps`` without rows that repeat the value before them, numbered anew from 1."""
    order = Window.partitionBy(by).orderBy("pos")
    fresh = steps.withColumn("_before", F.lag(value).over(order)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    return fresh.withColumn("pos", F.row_number().over(order).cast("bigint")).drop("_before")


def pieces(steps: DataFrame, by: str, value: str) -> DataFrame:
    """(by, piece, n, first_pos): pieces of sequences cut where a segment, in either direction, comes
    again. Of several cuts the piece before the last one is lost, as are inner pieces of one value.
    A sequence is one array, since its pieces depend on all of it."""
    every = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("value")))).alias("all")).withColumn("n", F.size("all"))
    # index of every pair, as its two values in order
    pair = lambda i: F.struct(F.least(F.get("all", i)["value"], F.get("all", i + 1)["value"]).alias("a"), F.greatest(F.get("all", i)["value"], F.get("all", i + 1)["value"]).alias("b"))
    indexes = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 2)).otherwise(F.array().cast("array<int>"))
    with_pairs = every.withColumn("pairs", F.transform(indexes, pair))
    again = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_position("pairs", p) - 1 < i, i + 1)), lambda i: i.isNotNull())
    cut = with_pairs.withColumn("cuts", again).withColumn("bounds", F.concat(F.array(F.lit(0)), "cuts", F.array("n")))
    part = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.struct(k.alias("piece"), F.get("bounds", k).alias("from"), F.get("bounds", k + 1).alias("to")))
    rows = cut.select(by, "all", F.size("cuts").alias("cuts"), F.explode(part).alias("p")).withColumn("n", F.col("p.to") - F.col("p.from"))
    inner = (F.col("p.piece") > 0) & (F.col("p.piece") < F.col("cuts")) & (F.col("n") <= 1)
    lost = (F.col("cuts") > 1) & ((F.col("p.piece") == F.col("cuts") - 1) | inner)
    kept = rows.filter(~lost & (F.col("n") > 0))
    return kept.select(by, F.col("p.piece").cast("bigint").alias("piece"), F.col("n").cast("bigint").alias("n"), F.get("all", F.col("p.from"))["pos"].alias("first_pos"))


def runs(steps: DataFrame, by: str, value: str, node: str) -> DataFrame:
    """(by, run, n, first_node): runs of equal values, numbered from 1."""
    order = Window.partitionBy(by).orderBy("pos")
    starts = F.when(F.lag(value).over(order) == F.col(value), 0).otherwise(1)
    marked = steps.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "run").agg(F.count(F.lit(1)).alias("n"), F.min(node).alias("first_node"))
