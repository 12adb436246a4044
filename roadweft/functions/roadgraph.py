"""Edge tables (u, v, weight): degrees, keys, subgraphs, joins of nodes and geometry, near pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ends(edges: DataFrame) -> DataFrame:
    """(node, other): every edge from both sides."""
    both = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, neighbours, loop): a loop counts twice."""
    loop = F.max((F.col("node") == F.col("other")).cast("int")) == 1
    return ends(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("other").alias("neighbours"), loop.alias("loop"))


def stats(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, tot_edge_km) of a graph whose weights are metres."""
    nodes = ends(edges).agg(F.countDistinct("node").alias("n_nodes"))
    return nodes.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"), (F.sum("weight") / 1000.0).alias("tot_edge_km")))  # a row each


def _undirected(*order: str | Column) -> Window:
    return Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy(*order)


def first_of_parallel(edges: DataFrame, *order: str) -> DataFrame:
    """Of the edges between two nodes, in either direction, the first; map-side where possible."""
    columns = [c for c in edges.columns]
    best = edges.groupBy(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in columns])


def multigraph(edges: DataFrame, *order: str) -> DataFrame:
    """Undirected edges with u the smaller node and key, their number among parallel ones from 0."""
    keyed = edges.withColumn("key", (F.row_number().over(_undirected(*order)) - 1).cast("bigint"))
    return keyed.withColumn("_u", F.least("u", "v")).withColumn("v", F.greatest("u", "v")).withColumn("u", F.col("_u")).drop("_u")


def keyed(edges: DataFrame, *order: str) -> DataFrame:
    """Directed edges with key, their number among parallel ones from 0."""
    return edges.withColumn("key", (F.row_number().over(Window.partitionBy("u", "v").orderBy(*order)) - 1).cast("bigint"))


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, is_endpoint): loops, sources, sinks, and what is no inner node of a way: two neighbours
    and degree two, or four where both directions are edges."""
    one = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("come")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("come")))
    flow = edges.select(F.explode(one).alias("e")).select("e.*").groupBy(F.col("node").alias("_n")).agg(F.sum("out").alias("out"), F.sum("come").alias("come"))
    joined = degrees(edges).join(flow, F.col("node") == F.col("_n"))
    inner = (F.col("neighbours") == 2) & F.col("degree").isin(2, 4)
    return joined.select("node", (F.col("loop") | (F.col("out") == 0) | (F.col("come") == 0) | ~inner).alias("is_endpoint"))


def without_short_tips(edges: DataFrame, least: float) -> DataFrame:
    """Edges but for those at a terminal node whose edge is shorter than ``least``."""
    tips = edges.select(F.explode(F.array("u", "v")).alias("_n"), "weight").groupBy("_n").agg(F.count(F.lit(1)).alias("degree"), F.min("weight").alias("w"))
    return removed(edges, tips.filter((F.col("degree") == 1) & (F.col("w") < least)).select("_n"))


def removed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` of which no end is in ``nodes`` (one column)."""
    bad = nodes.toDF("_bad").distinct()
    return edges.join(bad, F.col("u") == F.col("_bad"), "left_anti").join(bad, F.col("v") == F.col("_bad"), "left_anti")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` of which both ends are in ``nodes`` (one column)."""
    good = nodes.toDF("_good").distinct()
    return edges.join(good, F.col("u") == F.col("_good"), "left_semi").join(good, F.col("v") == F.col("_good"), "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``edges`` with the columns of both their nodes (node, ...), as <column>_u and <column>_v."""
    for end in ("u", "v"):
        side = nodes.select(F.col("node").alias("_n"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        edges = edges.join(side, F.col(end) == F.col("_n")).drop("_n")
    return edges


def filled(edges: DataFrame, geometry: DataFrame) -> DataFrame:
    """`with_ends` edges with mid of ``geometry`` (u, mid) and filled, whether they have none."""
    known = geometry.select(F.col("u").alias("_g"), "mid")
    return edges.join(known, F.col("u") == F.col("_g"), "left").drop("_g").withColumn("filled", F.col("mid").isNull())


def with_projected(edges: DataFrame, projected: DataFrame) -> DataFrame:
    """Keyed edges with what ``projected`` (u, v, key, projected) says of them, or null."""
    known = projected.select(F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("key").alias("_k"), "projected")
    same = (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")) & (F.col("key") == F.col("_k"))
    return edges.join(known, same, "left").drop("_u", "_v", "_k")


def near_pairs(points: DataFrame, most: float, but: float | None = None) -> DataFrame:
    """(s, e, d): pairs of points (id, x, y) over 0 and under ``most`` apart, s < e, not exactly ``but``
    apart. Points meet in the nine cells around each, an equi-join."""
    cell = lambda c: F.floor(F.col(c) / most).alias(f"c{c}")
    cells = points.select("id", "x", "y", cell("x"), cell("y"))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = cells.withColumn("cx", F.explode(F.transform(step, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(step, lambda k: F.col("cy") + k)))
    a, b = around.alias("a"), cells.alias("b")
    met = a.join(b, F.expr("a.cx = b.cx AND a.cy = b.cy AND a.id < b.id"))
    d = F.sqrt((F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y")))
    found = met.select(F.col("a.id").alias("s"), F.col("b.id").alias("e"), d.alias("d")).filter((F.col("d") > 0) & (F.col("d") < most))
    return found if but is None else found.filter(F.col("d") != but)


def not_joined(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (s, e) between which there is no edge, in either direction."""
    joined = edges.select(F.least("u", "v").alias("_u"), F.greatest("u", "v").alias("_v"))
    return pairs.join(joined, (F.col("s") == F.col("_u")) & (F.col("e") == F.col("_v")), "left_anti")


def legs_of_ways(legs: DataFrame) -> DataFrame:
    """Directed edges of the legs (way_id, pos, u, v, oneway) of ways: turned where a way is one-way
    against its points, both ways where it is not one-way, along it else."""
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    ways = F.when(F.col("oneway") == "-1", F.array(back)).when(F.col("oneway") == "no", F.array(there, back)).otherwise(F.array(there))
    return legs.filter("v IS NOT NULL").select("way_id", "pos", F.explode(ways).alias("e")).select("way_id", "pos", "e.*")
