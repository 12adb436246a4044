"""Operators as functions: column expressions, and functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half to even, as numpy rounds."""
    return F.rint(value * 10.0**digits) / 10.0**digits
