"""Places in a total order without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.session import materialize


def numbered(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """``df`` with each row's place, from 0, in ``order``, which must be total for reruns to agree.

    A range sort spreads the rows over partitions; a written copy holds each row's partition and its
    place there, and the partitions' sizes, one row each, give what is added. No task sees more
    than a partition. An empty table gives an empty result."""
    marked = materialize(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND((1 << 33) - 1)
    starts, at = [], 0
    for row in sorted(marked.groupBy(part.alias("part")).count().collect()):
        starts.append((row["part"], at))
        at += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint").coalesce(1)
    joined = marked.join(F.broadcast(offsets), part == F.col("_part"))  # as many rows as partitions
    return joined.withColumn(name, place + F.col("_start")).drop("_mark", "_part", "_start")
