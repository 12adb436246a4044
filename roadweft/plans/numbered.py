"""Queries on places in a total order, by the distributed numbering; their oracles are windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweft.functions import geo, roadgraph, rounded, sequences
from roadweft.operators.ranking import numbered
from roadweft.plans import graph, labels, lines
from roadweft.plans.operators import nodes
from roadweft.session import table

FOLDS = 4


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name").select("c_custkey", (F.col("pos") % FOLDS).cast("int").alias("fold"))


def win_rownum_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir)


def filt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir).filter("fold = 2").select("c_custkey")


def set_except_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold the rows of the other folds."""
    own = _folds(spark, sf_dir)
    others = F.filter(F.array(*[F.lit(k) for k in range(FOLDS)]), lambda k: k != F.col("fold"))
    return own.select(F.explode(others).alias("fold"), "c_custkey")


def sample_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.concat("c_name", F.lit("42"))).alias("draw"))
    return numbered(rows, "draw", name="place").select("c_custkey", "place")


def win_position_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")
    return rows.selectExpr("c_custkey", "pos div 12 AS line")


def ds_names_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    return numbered(table(spark, sf_dir, "pages").select("page_id"), "page_id", name="idx").join(wanted, "page_id", "left_semi").select("idx", "page_id")


def join_dir_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sorted listings side by side; the longer one's rest goes."""
    a = numbered(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    b = numbered(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return a.join(b, "pos").select("p_partkey", "s_suppkey")


def geo_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")
    b = numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return a.join(b, "pos").select("c_custkey", "p_partkey")


def sort_pair_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = roadgraph.near_pairs(graph.terminals(spark, sf_dir), 80.0, 24.0)
    return numbered(pairs, "d", "s", "e").select("s", "e", (F.col("pos") + 1).alias("place"))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node: the nodes of every way in order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("node"))


def win_first_seen_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 10000 on in the order in which the ways name the nodes."""
    seen = _ways(spark, sf_dir).groupBy("node").agg(F.min(F.col("way_id") * 100 + F.col("pos")).alias("ord"))
    return numbered(seen, "ord", "node").select("node", (F.col("pos") + 10000).alias("id"))


def gr_wkt2edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = sequences.pairwise(_ways(spark, sf_dir), "way_id", "node")
    ids = win_first_seen_id(spark, sf_dir)
    a, b = ids.toDF("_a", "u"), ids.toDF("_b", "v")
    joined = legs.join(a, F.col("s") == F.col("_a")).join(b, F.col("e") == F.col("_b"))
    return joined.select("way_id", "pos", "u", "v", F.abs(F.col("e") - F.col("s")).cast("double").alias("length_pix"))


def gr_route_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the route along all nodes."""
    places = numbered(nodes(spark, sf_dir), "node")
    after = places.select((F.col("pos") - 1).alias("pos"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    length = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    ends = [F.col(c).alias(n) for c, n in (("lon", "x0"), ("lat", "y0"), ("lon2", "x1"), ("lat2", "y1"))]
    return places.join(after, "pos").select("node", *ends, rounded(length, 3).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (win_rownum_mod, filt_fold, set_except_fold, sample_shuffle, win_position_chunk, ds_names_idx, join_dir_zip, geo_stamp, sort_pair_dist, win_first_seen_id, gr_wkt2edges, gr_route_coords)
}
_WINDOWS = labels.ORACLE_SQL | graph.ORACLE_SQL | lines.ORACLE_SQL
ORACLE_SQL = {name: _WINDOWS[name] for name in QUERIES}
