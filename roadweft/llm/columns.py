"""Columns of a user's table under names that nothing can clash with.

Operators that return a table's own columns carry them in one struct, ROW, beside the few columns
they compute; a struct's fields can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def named(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct named ROW."""
    return F.struct(*[named(c) for c in docs.columns]).alias(ROW)


def field(name: str) -> Column:
    """A column of the struct under its own name."""
    return F.col(ROW).getField(name).alias(name)


def fields(docs: DataFrame, *but: str) -> list[Column]:
    """All columns of ``docs`` from the struct, ``but`` those named."""
    return [field(c) for c in docs.columns if c not in but]


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
