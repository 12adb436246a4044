"""The functions as SQL: scalar and table functions that Catalyst inlines, and an aggregate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roadweft.functions.speeds import BIN_BURN, BIN_MPH, MAX_MPH, MPS
from roadweft.functions.tiles import SLICE, STRIDE

#: SQL functions by name: arguments, type and body. They are expressions, so plans stay whole.
SCALAR = {
    "mph_to_mps": ("mph DOUBLE", "DOUBLE", f"{MPS}D * mph"),
    "burn_continuous": ("mph DOUBLE", "DOUBLE", f"greatest(least(255D * mph / {MAX_MPH}D, 255D), 0D)"),
    "burn_binned": ("mph DOUBLE", "INT", f"CAST(ceil(mph / {BIN_MPH}D) * {BIN_BURN} AS INT)"),
    "channel_of_burn": ("burn INT", "INT", f"CAST(floor(burn / {BIN_BURN}) - 1 AS INT)"),
}
TABLE = {
    "tile_starts": ("size INT", "start INT", f"SELECT DISTINCT CAST(least({STRIDE} * i, size - {SLICE}) AS INT) FROM (SELECT explode(sequence(0, (size - 2) div {STRIDE})) AS i) t"),
    "wkt_points": (
        "wkt STRING", "pos INT, x DOUBLE, y DOUBLE",
        r"SELECT pos, CAST(split(trim(p), '\\s+')[0] AS DOUBLE), CAST(split(trim(p), '\\s+')[1] AS DOUBLE) FROM (SELECT posexplode(split(regexp_extract(wkt, '\\((.*)\\)', 1), ',')) AS (pos, p)) t WHERE trim(p) <> ''",
    ),
}


def soft_dice(p: pd.Series, t: pd.Series) -> float:
    """Soft Dice loss of predictions and targets."""
    return float(1.0 - (2.0 * (p * t).sum() + 1e-5) / (p.sum() + t.sum() + 1e-5))


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (arguments, kind, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, (arguments, columns, body) in TABLE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
    spark.udf.register("soft_dice", F.pandas_udf(soft_dice, "double"))
