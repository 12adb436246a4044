"""Bounds for the batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: One pair of limits for all operators: plans are lazy, so limits of one's own would hold for
#: whatever runs next.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded(spark: SparkSession) -> None:
    """Hand Python workers few rows at a time, since texts can be very long. The session's limits
    are lowered to LIMITS and never raised."""
    for name, limit in LIMITS.items():
        now = spark.conf.get(name).strip().lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= limit:
            spark.conf.set(name, str(limit))


def relax() -> None:
    """Hand memory that a task no longer uses back to the system: Python workers live on, and what
    their allocators keep would add to the next operator's peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
