"""Queries of masks, sequences, graphs and meters that are functions; as in `operators`, their SQL for
the oracle stands in the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweft.functions import geo, masks, metrics, names, roadgraph, rounded, sequences, speeds, tiles
from roadweft.plans import graph, lines
from roadweft.plans.dual import duck_query
from roadweft.plans.operators import Query, highways, images, nodes, pixels, polylines, with_mph
from roadweft.session import table

QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


# labels and names


@query
def filt_bad_speed(spark: SparkSession, sf: str) -> DataFrame:
    own = highways(spark, sf).select("way_id", F.when(F.col("highway").isin(*speeds.SKIP), -1).otherwise(F.col("p_size")).alias("speed_mph"))
    return own.filter("speed_mph >= 0")


@query
def agg_distinct_sort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("value")).distinct().orderBy("value")


@query
def set_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds met in either of two sets of roads."""
    own = with_mph(spark, sf)
    parts = [own.filter(c).select("speed_mph").distinct() for c in ("road_type <= 3", "road_type >= 3")]
    return parts[0].union(parts[1]).distinct()


@query
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_linestatus")
    return own.filter("l_returnflag = 'A'").unionByName(own.filter("l_linestatus = 'F'")).select("image_id", "line")


@query
def fn_json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of features by the key that they have."""
    p = F.from_json("props", "map<string,string>")
    own = table(spark, sf, "events").select("event_id", p.alias("p"))
    return own.select("event_id", F.col("p")["k"].cast("int").alias("k"), F.coalesce(F.col("p")["highway"], F.col("p")["class"], F.lit("none")).alias("highway"))


@query
def join_img_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose mask, a TIFF of the same root, is there."""
    own = table(spark, sf, "pages").select("page_id", F.concat(names.root(F.concat(F.lit("im"), F.col("page_id").cast("string"), F.lit(".png"))), F.lit(".tif")).alias("mask"))
    there = table(spark, sf, "labels").select(F.concat(F.lit("im"), F.col("doc_id").cast("string"), F.lit(".tif")).alias("mask"))
    return own.join(there, "mask").select("page_id", "mask")


@query
def fn_make_str(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("text"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("name"))


@query
def cfg_dir_select(spark: SparkSession, sf: str) -> DataFrame:
    """Where a stage reads: stitched tiles, merged folds, or the only fold's names without their mark."""
    key = F.col("o_orderkey")
    one = F.regexp_replace(F.concat(F.lit("fold0_"), key.cast("string")), "^fold[0-9]+_", "")
    return table(spark, sf, "orders").select(key.alias("id"), F.when(F.col("o_orderstatus") == "F", "stitched").when(key % 4 > 1, "merged").otherwise(one).alias("input"))


@query
def filt_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.col("l_orderkey") == 7).select("l_orderkey", "l_linenumber", "l_quantity")


@query
def filt_mask_exists(spark: SparkSession, sf: str) -> DataFrame:
    there = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("_k"))
    return table(spark, sf, "orders").select("o_orderkey").join(there, F.col("o_orderkey") == F.col("_k"), "left_semi")


@query
def limit_nmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query
def sort_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_name", "c_custkey").orderBy("c_name")


@query
def proj_solution_cols(spark: SparkSession, sf: str) -> DataFrame:
    weights = {"length": "l_quantity", "travel_time": "l_extendedprice"}
    shown = {"length": "length_m", "travel_time": "travel_time_s"}
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), *[F.col(c).alias(shown[w]) for w, c in weights.items()])


# meters


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("phase"), F.col("value").alias("loss"))


@query
def agg_epoch_meter(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.meter(_losses(spark, sf), "epoch", "phase")


@query
def agg_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_so_far(metrics.meter(_losses(spark, sf), "epoch").select("epoch", "loss"))


@query
def win_detect_lrdrop(spark: SparkSession, sf: str) -> DataFrame:
    return _losses(spark, sf).select("epoch").distinct().withColumn("lr", metrics.learning_rate(F.col("epoch"), 0.1, 0.5, [10, 20]))


@query
def agg_dice_bool(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").agg(metrics.dice_of_flags(F.col("quality"), F.col("toxic")).alias("dice"))


# samples


@query
def sample_split(spark: SparkSession, sf: str) -> DataFrame:
    """Four fifths by a hash of the name."""
    draw = F.conv(F.substring(F.md5(F.concat("c_name", F.lit("42"))), 1, 2), 16, 10).cast("int")
    return table(spark, sf, "customer").select("c_custkey", F.when(draw < 204, "train").otherwise("test").alias("split"))


@query
def sample_choice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").orderBy(F.md5(F.concat("url", F.lit("7"))), "page_id").select("page_id").limit(10)


@query
def sample_crop(spark: SparkSession, sf: str) -> DataFrame:
    draw = F.ascii(F.substring(F.md5("name"), 1, 1)) % 16 / 16.0
    return images(spark, sf).select("image_id", F.floor((F.col("w") - tiles.SLICE) * draw).alias("x0"))


# rasters


@query
def join_prefix_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of all folds under their names without the fold's mark."""
    name = F.concat(F.lit("fold"), (F.col("l_orderkey") % 4).cast("string"), F.lit("_"), F.col("l_partkey").cast("string"))
    own = table(spark, sf, "lineitem").select(F.regexp_extract(name, "^(fold[0-9])_(.*)$", 1).alias("fold"), F.regexp_extract(name, "^(fold[0-9])_(.*)$", 2).alias("image"), F.col("l_quantity").alias("v"))
    return own.groupBy("image").agg(F.countDistinct("fold").alias("folds"), F.floor(F.avg("v")).alias("v"))


@query
def agg_crop_mean(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).filter("x >= 10 AND y >= 10").groupBy("x", "y").agg(rounded(F.avg("v"), 6).alias("v"))


@query
def fn_flip_index(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c: masks.flipped(F.col(c) % 64, 64).alias(f"flipped_{c}")
    return pixels(spark, sf).select("x", "y", at("x"), at("y"), "v")


@query
def agg_pct(spark: SparkSession, sf: str) -> DataFrame:
    levels = {"low": 0.02, "median": 0.5, "high": 0.98}
    return pixels(spark, sf).groupBy("band").agg(*[rounded(F.percentile("v", F.lit(p)), 6).alias(n) for n, p in levels.items()])


def _tiled(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumn("tile", F.floor(F.col("y") / 16))


@query
def filt_black_tile(spark: SparkSession, sf: str) -> DataFrame:
    return masks.bright_tiles(_tiled(spark, sf).withColumn("v", F.col("v") - 25), "x", "tile")


@query
def filt_zero_frac(spark: SparkSession, sf: str) -> DataFrame:
    return masks.mostly_valid(pixels(spark, sf).withColumnRenamed("x", "image_id"), "image_id", null=10, most=0.3).withColumn("zero_frac", rounded(F.col("zero_frac"), 6))


@query
def filt_null_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masks.without_null(pixels(spark, sf), "x", 5, 0.05).select("src", "x", "y", "band", "mask")


@query
def filt_alpha_tile(spark: SparkSession, sf: str) -> DataFrame:
    return masks.opaque_tiles(_tiled(spark, sf), "x", "tile", least=5).withColumn("alpha", rounded(F.col("alpha"), 6))


@query
def tf_thresh(spark: SparkSession, sf: str) -> DataFrame:
    return masks.above(pixels(spark, sf), 0.3, 50)


@query
def tf_border_fix(spark: SparkSession, sf: str) -> DataFrame:
    small = pixels(spark, sf).groupBy((F.col("x") % 32).alias("x"), (F.col("y") % 32).alias("y")).agg(F.max("v").alias("v"))
    return masks.border_fixed(small, 32)


def _buffers(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of widened roads: vec_id, image_id, x, y, speed."""
    image = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), F.col("label").cast("bigint").alias("image_id"))
    found = geo_buffer(spark, sf).join(image, F.col("vec_id") == F.col("_v"))
    return found.select("vec_id", "image_id", F.col("px").alias("x"), F.col("py").alias("y"), (5 + F.col("vec_id") % 61).alias("speed"))


@query
def agg_dissolve(spark: SparkSession, sf: str) -> DataFrame:
    """Buffers of one speed in an image as one shape, with the first road's number."""
    return masks.dissolved(_buffers(spark, sf), ["image_id", "speed"], ["vec_id"], "vec_id")


@query
def geo_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels at most 2 from a road: of each segment's widened box those near enough."""
    spots = polylines(spark, sf).select("vec_id", "i", *[F.rint((F.col(c) + 0.6) * 50).alias(c) for c in ("x", "y")])
    legs = geo.segments(spots, "vec_id")
    box = lambda c: F.explode(F.sequence(F.least(c, f"{c}2").cast("bigint") - 2, F.greatest(c, f"{c}2").cast("bigint") + 2)).alias(f"p{c}")
    met = legs.select("*", box("x")).select("*", box("y"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    along = ((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.least(along, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    off = lambda c, d: F.col(f"p{c}") - F.col(c) - t * d
    return met.filter(off("x", dx) * off("x", dx) + off("y", dy) * off("y", dy) <= 4.0).select("vec_id", "px", "py").distinct()


@query
def geo_roadmask(spark: SparkSession, sf: str) -> DataFrame:
    """Roads burned in their order, those of skipped types left out."""
    burn = _buffers(spark, sf).filter("vec_id % 7 <> 3").withColumn("v", speeds.burn_binned(F.col("speed")))
    return burn.groupBy("image_id", F.col("x").alias("px"), F.col("y").alias("py")).agg(F.max_by("v", "vec_id").alias("burned"))


@query
def geo_rasterize(spark: SparkSession, sf: str) -> DataFrame:
    """Values burned in the order of their sources: the last one stays."""
    own = pixels(spark, sf).withColumn("_src", F.col("src")).withColumn("_band", F.col("band")).withColumn("_v", F.col("v"))
    return masks.burned(own, "_src", "_band", "_v")


@query
def agg_pixel_area(spark: SparkSession, sf: str) -> DataFrame:
    return masks.area(images(spark, sf), 0.3).select("pixels", rounded(F.col("km2"), 6).alias("km2"))


@query
def agg_band_stats(spark: SparkSession, sf: str) -> DataFrame:
    return masks.mean_height(pixels(spark, sf), "x").select(rounded(F.col("mean_height"), 6).alias("mean_height"), "n")


@query
def agg_channel_weight(spark: SparkSession, sf: str) -> DataFrame:
    return masks.weighted_channels(pixels(spark, sf), 7, 0.16).select("src", "x", "y", "band", rounded(F.col("v"), 6).alias("v"))


@query
def fn_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", rounded(masks.sigmoid(F.col("value")), 9).alias("p"))


@query
def fn_clip_dtype(spark: SparkSession, sf: str) -> DataFrame:
    return masks.clipped(pixels(spark, sf), F.col("v") * 1.5).select("src", "x", "y", "band", "v")


@query
def fn_norm_tensor(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("src", "x", "y", "band", (F.col("v") / 255.0).alias("v"))


@query
def fn_shift_scale(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("v").distinct().withColumn("shift", F.col("v") / 255.0)


@query
def fn_neighbor_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(dy, dx, dy * 100 + dx) for dy, dx in masks.neighbours()], "dy int, dx int, linear int")


@query
def fn_unravel(spark: SparkSession, sf: str) -> DataFrame:
    """Places of a padded image of 100 columns, counted without the padding."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("linear"), (F.floor(key / 100) - 1).alias("row_"), (key % 100 - 1).alias("col_"))


@query
def tf_sknw_mark(spark: SparkSession, sf: str) -> DataFrame:
    mask = pixels(spark, sf).filter("v > 40").select((F.col("x") % 200).alias("x"), (F.col("y") % 100).alias("y")).distinct()
    return masks.marked(mask)


@query
def img_stack(spark: SparkSession, sf: str) -> DataFrame:
    own = pixels(spark, sf).select("src", "x", "y", "band", "v")
    return masks.stacked(own, F.when(F.col("v") > 25, 255.0).otherwise(0.0), 8)


@query
def img_color_aug(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return pixels(spark, sf).select("src", "x", "y", masks.shuffled_band(F.col("band")).alias("shuffled_band"), masks.inverted(v).alias("inverted"), masks.shifted(v, 20.0).alias("shifted"))


@query
def aug_compose(spark: SparkSession, sf: str) -> DataFrame:
    """Per image a flip or not, then a rotation, a transposition or neither, on image and mask alike;
    then the image alone inverted or not. Draws are hashes of the image and the step."""
    rows = table(spark, sf, "lineitem")
    small = lambda c: (F.col(c) % 64).cast("int")
    chip = rows.groupBy((F.col("l_partkey") % 50).alias("image_id"), small("l_partkey").alias("x"), small("l_suppkey").alias("y")).agg(
        F.max((F.col("l_quantity") * 5).cast("int")).alias("b"), F.max((F.col("l_linenumber") > 5).cast("int")).alias("mask")
    )
    draw = lambda step: F.conv(F.substring(F.md5(F.concat(F.col("image_id").cast("string"), F.lit(f":{step}:42"))), 1, 1), 16, 10).cast("int")
    drawn = chip.select("image_id", "y", "b", "mask", F.when(draw("flip") < 8, masks.flipped(F.col("x"), 64)).otherwise(F.col("x")).alias("x"), draw("one").alias("one"), (draw("invert") < 8).alias("invert"))
    x, y = F.col("x"), F.col("y")
    turn = F.when(F.col("one") < 5, F.struct(y.alias("x"), masks.flipped(x, 64).alias("y"))).when(F.col("one") < 10, F.struct(y.alias("x"), x.alias("y"))).otherwise(F.struct(x.alias("x"), y.alias("y")))
    value = F.when(F.col("invert"), 255 - F.col("b")).otherwise(F.col("b"))
    return drawn.select("image_id", turn.alias("at"), value.alias("value"), "mask").select("image_id", "at.x", "at.y", "value", "mask")


# sequences


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", pos.alias("pos"))


@query
def win_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.pairwise(_steps(spark, sf), "user_id", "event_type").select("user_id", "pos", "s", "e")


@query
def win_dedup_seq(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.without_repeats(_steps(spark, sf), "user_id", "event_type").select("user_id", "event_id", "event_type")


@query
def win_split_dupseg(spark: SparkSession, sf: str) -> DataFrame:
    own = sequences.without_repeats(_steps(spark, sf), "user_id", "event_type").withColumn("pos", F.col("pos").cast("int"))
    return sequences.pieces(own, "user_id", "event_type")


@query
def win_chain_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.runs(_steps(spark, sf), "user_id", "event_type", "event_id")


@query
def join_raster_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels placed by their image's origin and pixel size."""
    key = F.col("n_nationkey")
    meta = table(spark, sf, "nation").select(key.alias("image_id"), (1000.0 * key).alias("x0"), (500.0 * key).alias("y0"))
    at = F.col("c_custkey")
    x, y = geo.affine(at, at, F.col("x0"), F.lit(0.3), F.col("y0"), F.lit(-0.3))
    return table(spark, sf, "customer").join(meta, F.col("c_nationkey") == F.col("image_id")).select("c_custkey", x.alias("x"), y.alias("y"))


@query
def fn_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all of a label's lines in one list."""
    lists = polylines(spark, sf).groupBy("label", "vec_id").agg(F.collect_list(F.struct("x", "y")).alias("points"))
    return lists.groupBy("label").agg(F.flatten(F.collect_list("points")).alias("points")).select("label", F.size("points").cast("bigint").alias("points"))


# graphs


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with many parallel ones: u, v, weight, ord, line."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.col("l_partkey").alias("u"), (100000 + F.col("l_suppkey")).alias("v"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"))


@query
def agg_degree(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.degrees(_dense(spark, sf)).select("node", "degree", (F.col("degree") == 1).alias("terminal"))


@query
def agg_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.stats(graph.sparse(spark, sf)).select("n_nodes", "n_edges", rounded(F.col("tot_edge_km"), 3).alias("tot_edge_km"))


@query
def set_dedup_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.first_of_parallel(_dense(spark, sf), "ord", "line", "weight").select("u", "v", "weight", "ord")


@query
def gr_build(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.multigraph(_dense(spark, sf), "ord", "line", "weight").select("u", "v", "key", "weight")


@query
def gr_selfloop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.sparse(spark, sf).filter("u <> v")


@query
def gr_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.endpoints(graph.sparse(spark, sf))


@query
def gr_short_edges(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.without_short_tips(graph.sparse(spark, sf), 50_000)


@query
def gr_add_paths(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    oneway = F.get(F.array(F.lit("yes"), F.lit("-1"), F.lit("no"), F.lit("roundabout")), (F.col("l_orderkey") % 4).cast("int"))
    legs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("u"), F.lead("l_partkey").over(order).alias("v"), oneway.alias("oneway"))
    return roadgraph.legs_of_ways(legs).select("way_id", "pos", "u", "v")


@query
def join_edge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    found = roadgraph.with_ends(graph.sparse(spark, sf), nodes(spark, sf), "lat", "lon")
    return found.select("u", "v", "lat_u", "lat_v", rounded(F.abs(F.col("lon_u") - F.col("lon_v")), 6).alias("dlon"))


@query
def join_fill_geom(spark: SparkSession, sf: str) -> DataFrame:
    """Edges without a geometry of their own are lines between their nodes."""
    own = table(spark, sf, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("u")).agg(F.min("l_quantity").alias("mid"))
    found = roadgraph.filled(roadgraph.with_ends(graph.sparse(spark, sf), nodes(spark, sf), "lat"), own)
    return found.select("u", "v", F.coalesce("mid", "lat_u").alias("x0"), F.coalesce("mid", "lat_v").alias("x1"), "filled")


@query
def join_edge_key(spark: SparkSession, sf: str) -> DataFrame:
    own = roadgraph.keyed(_dense(spark, sf), "ord", "line", "weight")
    known = own.filter("key < 2").select("u", "v", "key", (F.col("weight") * 2.0).alias("projected"))
    return roadgraph.with_projected(own, known).select("u", "v", "key", "projected")


def _status(spark: SparkSession, sf: str, status: str) -> DataFrame:
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == status).select("o_orderkey")


@query
def join_semi_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.subgraph(graph.sparse(spark, sf), _status(spark, sf, "F")).select("u", "v")


@query
def join_anti_remove(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.removed(graph.sparse(spark, sf), _status(spark, sf, "P")).select("u", "v")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.near_pairs(graph.terminals(spark, sf), 80.0, 24.0)


@query
def join_proximity(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("s", "e", rounded(F.col("d"), 6).alias("d"), (F.col("d") < 24).alias("close"))


@query
def join_anti_edge(spark: SparkSession, sf: str) -> DataFrame:
    return roadgraph.not_joined(_near(spark, sf), graph.sparse(spark, sf)).select("s", "e")


@query
def join_path_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Of parallel edges along a path the lightest."""
    best = _dense(spark, sf).groupBy("u", "v").agg(F.min(F.struct("weight", "ord", "line")).alias("b"))
    return best.select("u", "v", F.col("b.ord").alias("ord"), F.col("b.weight").alias("length"))


ORACLE_SQL = {
    "agg_dissolve": duck_query(f"WITH {lines.BUFFER}, shape AS (SELECT CAST(label AS BIGINT) AS image_id, 5 + vec_id % 61 AS speed, vec_id, px AS x, py AS y FROM buffer) SELECT image_id, speed, x, y, min(min(vec_id)) OVER (PARTITION BY image_id, speed) AS vec_id FROM shape GROUP BY image_id, speed, x, y"),
    "geo_rasterize": "SELECT l_partkey AS x, l_suppkey AS y, arg_max(l_quantity, [l_orderkey, l_linenumber, l_quantity]) AS burned FROM lineitem GROUP BY 1, 2",
}
