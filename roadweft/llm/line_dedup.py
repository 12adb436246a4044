"""Line dedup by site-relative frequency.

Pages are grouped by host; a line that stands on more than ``max_ratio`` of its host's pages is
boilerplate and is dropped. Everything is JVM-side:

* a page contributes each of its lines once, as a 64-bit hash, so text never enters the counting
  shuffle and a hot host is pre-aggregated map-side;
* a host has at most (mean lines per page / max_ratio) boilerplate lines, however many pages it
  has, so the table of them is one short array per host. It is written once; Spark then knows its
  size and broadcasts it only below its threshold, else it uses a sort-merge join whose hot host
  adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.llm.columns import ROW, field, named, row_of
from roadweft.session import materialize

#: In the gap between the lines of copied pages (0.048 of a source's pages at most at sf0.1) and the
#: most common header line (0.086 at least): a lower one drops text of copied pages too.
MAX_RATIO = 0.06
#: Few pages say little of a share: with 2, sources of ten pages lose more copied text than headers.
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(line))


def boilerplate(docs: DataFrame, host: str, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """One row per host that has boilerplate: of, bad (hashes of its lines)."""
    pages = docs.select(named(host).alias("host"), _lines(named(text)).alias("lines"))
    seen = pages.select(
        "host",
        F.explode(F.array_distinct(_hashes(F.filter("lines", lambda line: F.trim(line) != "")))).alias("line"),
    )
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("on") > F.col("pages") * F.lit(float(max_ratio)))
        .groupBy(F.col("host").alias("of"))
        .agg(F.sort_array(F.collect_list("line")).alias("bad"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    counts: bool = True,
) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus n_lines and n_dropped (bigint) if ``counts``.

    A line is dropped if it stands on more than ``max_ratio`` of the pages of its host and on at
    least ``min_pages`` of them (a host of one page would otherwise lose every line). Repeats
    within a page count once towards the ratio; all of them are dropped. Lines of blanks are never
    dropped. Lines are compared by 64-bit hashes with the few boilerplate lines of their host.

    Defined cases: null text stays null with 0 lines; empty text has one blank line; null hosts
    form one host of their own; repeated rows count as pages of their own; a line that stands on
    exactly the ratio stays; an empty table gives an empty result. Other columns may have any name
    and are unchanged; with ``counts`` those named n_lines or n_dropped are replaced.
    """
    bad = materialize(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    split = docs.select(row_of(docs), named(host).alias("host"), _lines(named(text)).alias("lines"))
    joined = split.join(bad, F.col("host").eqNullSafe(F.col("of")), "left")
    keep = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: (F.trim(line) == "") | ~F.array_contains("bad", F.xxhash64(line)))
    )
    kept = joined.select(ROW, "lines", keep.alias("kept"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    more = {"n_lines": size("lines"), "n_dropped": size("lines") - size("kept")} if counts else {}
    own = [F.array_join("kept", "\n").alias(c) if c == text else field(c) for c in docs.columns if c not in more]
    return kept.select(*own, *[c.alias(name) for name, c in more.items()])
