"""Queries of the operators that are functions: each binds driver tables to a function's arguments.

Their SQL for the oracle stands in the other modules (or below, where it is stated anew), so the two
sides of a comparison share no text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweft.functions import geo, names, rasters, rounded, speeds, tiles, travel
from roadweft.operators import geograph, lines
from roadweft.plans.dual import duck_query
from roadweft.plans.geometry import UTM
from roadweft.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


# driver tables as the arguments of operators


def images(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, name, w, h."""
    width, height = (1400 + 60 * F.col("p_size")).cast("int"), (1300 + 200 * (F.col("p_partkey") % 7)).cast("int")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("name"), width.alias("w"), height.alias("h"))


def widths(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf).select("w").distinct()


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """src, x, y, band, fold, v."""
    rows = table(spark, sf, "lineitem")
    fold, band = (F.col("l_orderkey") % 4).cast("int").alias("fold"), F.col("l_linenumber").cast("int").alias("band")
    return rows.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), band, fold, F.col("l_quantity").alias("v"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, road_type, lanes, surface of labelled roads."""
    rows = table(spark, sf, "lineitem")
    lanes = 1 + F.col("l_quantity").cast("int") % 12
    surface = F.when(F.col("l_returnflag") == "N", 2).otherwise(1)
    return rows.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("road_type"), lanes.alias("lanes"), surface.alias("surface"))


def with_mph(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).withColumn("speed_mph", speeds.mph(F.col("road_type"), F.col("lanes"), F.col("surface")))


def ways(spark: SparkSession, sf: str) -> DataFrame:
    """way_id, p_size and properties of OSM ways: some have no highway but a class and a type."""
    kinds = {"ECONOMY": "motorway", "STANDARD": "Primary", "SMALL": "secondary_link", "MEDIUM": "residential", "LARGE": "footway"}
    highway = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("p_type")], F.lit("track"))
    size = F.col("p_size")
    tunnel = F.struct(F.lit("tunnel").alias("key"), F.when(size % 10 == 0, "yes").otherwise("no").alias("value"))
    class_ = F.struct(F.lit("class").alias("key"), F.when(size % 7 == 0, "railway").otherwise("highway").alias("value"))
    kind = F.struct(F.when(size % 3 == 0, "type").otherwise("highway").alias("key"), highway.alias("value"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("way_id"), "p_size", F.map_from_entries(F.array(tunnel, class_, kind)).alias("properties"))


def highways(spark: SparkSession, sf: str) -> DataFrame:
    """way_id, highway, p_size."""
    p = F.col("properties")
    return ways(spark, sf).select("way_id", F.coalesce(p["highway"], p["type"]).alias("highway"), "p_size")


def polylines(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, i, x, y of lines of 32 points."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), F.get("e", 2 * i).alias("x"), F.get("e", 2 * i + 1).alias("y")))
    return rows.select("vec_id", "label", F.explode(spots).alias("p")).select("vec_id", "label", "p.*")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return geo.segments(polylines(spark, sf), "vec_id")


def patch(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, band, v: seven bands of eight values around each of an edge's segments."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 56).alias("e"))
    values = rows.select("vec_id", "label", F.posexplode("e").alias("p", "e"))
    v = F.greatest(F.least(F.floor((F.col("e") + 0.6) * 200.0).cast("double"), F.lit(255.0)), F.lit(0.0))
    return values.select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("band"), v.alias("v"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node, lat, lon."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("node"), (36.0 + 0.001 * (key % 1000)).alias("lat"), (-115.0 + 0.001 * (key % 777)).alias("lon"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring nodes: u, v, lat, lon, lat2, lon2."""
    first = nodes(spark, sf)
    second = first.select(F.col("node").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return first.withColumnRenamed("node", "u").join(second, F.col("v") == F.col("u") + 1)


# tiles


@query
def tf_tile(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.tiles(images(spark, sf)).select("image_id", "xmin", "ymin", "w", "h")


@query
def set_dedup_coords(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.tiles(images(spark, sf)).groupBy("image_id").agg(F.count(F.lit(1)).alias("tiles"))


@query
def fn_tile_starts(spark: SparkSession, sf: str) -> DataFrame:
    return widths(spark, sf).select(F.col("w").alias("dim"), F.explode(tiles.tile_starts(F.col("w"))).alias("start"))


@query
def fn_tile_name(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.tile_names(tiles.tiles(images(spark, sf)))


@query
def fn_seq_starts(spark: SparkSession, sf: str) -> DataFrame:
    return widths(spark, sf).select(F.col("w").alias("b"), F.posexplode(tiles.sequential_starts(F.col("w"))).alias("i", "start"))


@query
def sort_starts(spark: SparkSession, sf: str) -> DataFrame:
    heights = images(spark, sf).select("h").distinct()
    return heights.select(F.col("h").alias("dim"), F.explode(tiles.sequential_starts(F.col("h"), 512, 64)).alias("start")).orderBy("dim", "start")


@query
def tf_crops(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.crops(images(spark, sf)).select("image_id", "x0", "y0")


# labels


@query
def join_speed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return with_mph(spark, sf).groupBy("road_type", "lanes", "surface").agg(F.min("speed_mph").alias("speed_mph"), F.count(F.lit(1)).alias("n"))


def _sn3(spark: SparkSession, sf: str) -> DataFrame:
    """id, properties: roads under either spelling of their keys, some without one of them."""
    rows = table(spark, sf, "lineitem")
    key = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    old = F.col("l_orderkey") % 2 == 0
    lanes, surface = 1 + F.col("l_quantity").cast("int") % 12, F.when(F.col("l_returnflag") == "N", 2).otherwise(1)
    entries = F.array(
        key("road_type", F.col("l_linenumber")),
        F.struct(F.when(old, "lane_numbe").otherwise("lane_number").alias("key"), lanes.cast("string").alias("value")),
        key("paved", surface),
        F.when(F.col("l_orderkey") % 5 > 0, F.struct(F.when(old, "bridge_typ").otherwise("bridge_type").alias("key"), F.lit("2").alias("value"))),
    )
    return rows.select(F.col("l_orderkey").alias("id"), F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("properties"))


def _sn5(spark: SparkSession, sf: str) -> DataFrame:
    """id, properties: lanes as decimal numbers, two surfaces."""
    size = F.col("p_size")
    pairs_ = (F.lit("highway"), F.col("highway"), F.lit("lanes"), F.concat((1 + size % 4).cast("string"), F.lit(".0")), F.lit("surface"), F.when(size % 2 == 0, "paved").otherwise("asphalt"), F.lit("bridge"), F.lit("null"))
    return highways(spark, sf).select(F.col("way_id").alias("id"), F.create_map(*pairs_).alias("properties"))


@query
def fn_speed_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Speeds by all three dialects."""
    tables = {"sn3": _sn3(spark, sf), "osm": ways(spark, sf).select(F.col("way_id").alias("id"), "properties"), "sn5": _sn5(spark, sf)}
    every = [df.select(F.lit(k).alias("dialect"), "id", speeds.speed_mph(F.col("properties"), k).alias("mph")) for k, df in tables.items()]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    return rows.groupBy("dialect", "id").agg(F.min("mph").alias("least_mph"), F.max("mph").alias("most_mph"), F.count(F.lit(1)).alias("n"))


@query
def filt_skipset(spark: SparkSession, sf: str) -> DataFrame:
    """Ways that are roads; the class says so only where there is no highway."""
    p = F.col("properties")
    kept = ways(spark, sf).filter(speeds.speed_mph(p, "osm") >= 0)
    return kept.select("way_id", F.coalesce(p["highway"], p["type"]).alias("highway"))


@query
def fn_highway_class(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.coalesce(speeds.highway_type(F.col("highway")), F.lit(0))
    return highways(spark, sf).groupBy("highway", kind.alias("road_type")).agg(F.count(F.lit(1)).alias("n"))


@query
def filt_roadtypes(spark: SparkSession, sf: str) -> DataFrame:
    return highways(spark, sf).filter(speeds.is_masked(F.col("highway"))).select("way_id", F.lower("highway").alias("highway"))


@query
def proj_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of which half have the short key."""
    odd = F.col("o_orderkey") % 2 == 1
    key, value = F.when(odd, "bridge_type").otherwise("bridge_typ"), F.when(odd, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), speeds.renamed(F.create_map(key, value))["bridge_type"].alias("bridge_type"))


@query
def proj_withcol_speed(spark: SparkSession, sf: str) -> DataFrame:
    speed = F.col("speed_mph")
    return with_mph(spark, sf).select("image_id", "road_type", "lanes", speed.alias("inferred_speed_mph"), rounded(speeds.mps(speed), 3).alias("inferred_speed_mps"))


@query
def fn_unit(spark: SparkSession, sf: str) -> DataFrame:
    speed = F.col("speed_mph")
    return with_mph(spark, sf).select(speed, speeds.mps(speed).alias("mps"), rounded(speed / speeds.MILES / 3600.0, 3).alias("meters_per_s")).distinct()


@query
def agg_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return with_mph(spark, sf).groupBy("speed_mph").agg(F.count(F.lit(1)).alias("n"))


@query
def fn_burn_contin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), speeds.burn_continuous(F.col("p_size")).alias("burn_val"))


@query
def fn_burn_bin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), speeds.burn_binned(F.col("p_size")).alias("burn_val"))


@query
def fn_channel_of_burn(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), speeds.channel_of_burn(speeds.burn_binned(F.col("p_size"))).alias("channel"))


@query
def agg_bin_mean(spark: SparkSession, sf: str) -> DataFrame:
    return speeds.channel_means(speeds.binned_table(spark.range(1, speeds.MAX_MPH + 1).select(F.col("id").cast("int").alias("speed"))))


@query
def agg_contin_map(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(speeds.continuous_keys(), "burn_val double, speed int")


@query
def join_nearest_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_size").alias("value")).distinct().withColumn("speed", speeds.nearest_speed(F.col("value")))


@query
def fn_color_bin(spark: SparkSession, sf: str) -> DataFrame:
    speed = F.col("id").cast("int")
    return spark.range(80).select(speed.alias("speed"), speeds.color(speed).alias("color"))


# file names


@query
def fn_basename(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of names with the marks of chips, a prefix, or by area."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "PS-RGB_").otherwise("PS-MS_"), F.lit("merged_AOI_"), F.col("p_partkey").cast("string"), F.lit(".tif.ovr"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.root(name).alias("name"), names.after(name, "merged_").alias("tail"), names.area_root(name).alias("area"))


@query
def join_img_label(spark: SparkSession, sf: str) -> DataFrame:
    """Images and the label files that their names lead to, which some don't have."""
    number = F.col("p_partkey").cast("string")
    image = F.concat(F.lit("SN3_roads_AOI_2_"), F.when(F.col("p_partkey") % 2 == 0, "PS-RGB").otherwise("PS-MS"), F.lit("_img"), number, F.lit(".tif"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("SN3_roads_AOI_2_geojson_roads_speed_img"), F.col("s_suppkey").cast("string"), F.lit(".geojson")).alias("label"))
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), image.alias("image"))
    return own.withColumn("label", names.label_of(F.col("image"), "SN3")).join(files, "label").select("id", "image", "label")


@query
def scan_lookup_img(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    files = table(spark, sf, "supplier").select(F.concat(F.when(key % 2 == 0, "RGB-PanSharpen_").when(key % 3 == 0, "MUL-PanSharpen_").otherwise(""), F.lit("im"), key.cast("string"), F.lit(".tif")).alias("name"))
    return names.resolved(table(spark, sf, "part").select(F.concat(F.lit("im"), F.col("p_partkey").cast("string")).alias("image_id")), files, 3)


@query
def ds_imageprovider(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.concat(F.lpad(F.col("page_id").cast("string"), 9, "0"), F.when(F.col("page_id") % 3 == 0, "_RGB.tif").otherwise("_MS.tif")).alias("name"))
    return names.provider(files, "_RGB")


# speed inference


@query
def agg_patch_multi(spark: SparkSession, sf: str) -> DataFrame:
    found = travel.patch_speeds(travel.levels(patch(spark, sf), "vec_id"), "vec_id")
    return found.select("vec_id", rounded(F.col("weighted_mph"), 6).alias("weighted_mph"), "argmax_mph")


@query
def agg_median_top(spark: SparkSession, sf: str) -> DataFrame:
    found = travel.median_of_top(patch(spark, sf), "vec_id")
    return found.select("vec_id", rounded(F.col("median"), 6).alias("median"), "speed")


@query
def agg_wmean_std(spark: SparkSession, sf: str) -> DataFrame:
    found = travel.weighted_mean_std(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity")
    return found.select("l_suppkey", rounded(F.col("mean"), 3).alias("mean"), rounded(F.col("std"), 3).alias("std"))


def _level(spark: SparkSession, sf: str) -> DataFrame:
    return travel.levels(patch(spark, sf), "vec_id", "label")


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).groupBy("label").agg((F.sum("length") * 100.0).alias("length_m"))


@query
def agg_argmax_ch(spark: SparkSession, sf: str) -> DataFrame:
    return travel.best_channel(_level(spark, sf), "label").withColumnRenamed("label", "edge_id")


@query
def agg_travel(spark: SparkSession, sf: str) -> DataFrame:
    found = travel.travel_times(travel.best_channel(_level(spark, sf), "label"), _lengths(spark, sf), "label")
    return found.select(
        F.col("label").alias("edge_id"), "channel", "inferred_speed_mph", rounded(F.col("length_m"), 3).alias("length_m"), rounded(F.col("length_miles"), 6).alias("length_miles"), "inferred_speed_mps", "travel_time_s"
    )


@query
def agg_edge_time(spark: SparkSession, sf: str) -> DataFrame:
    """Hours and miles of edges whose speed varies by segment."""
    own = travel.patch_speeds(_level(spark, sf), "vec_id", "label").select("vec_id", "label", "weighted_mph")
    miles = segments(spark, sf).groupBy("vec_id").agg((F.sum("length") * 100.0 * travel.MILES).alias("miles"))
    found = own.join(miles, "vec_id").groupBy(F.col("label").alias("edge_id")).agg(F.sum(F.col("miles") / F.col("weighted_mph")).alias("hours"), F.sum("miles").alias("miles"))
    return found.select("edge_id", rounded(F.col("hours"), 9).alias("hours"), rounded(F.col("miles"), 6).alias("miles"))


@query
def join_patch(spark: SparkSession, sf: str) -> DataFrame:
    own = pixels(spark, sf).groupBy("x", "y").agg(F.max("v").alias("z"))
    spots = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") * 3 % 1900).alias("x"), (F.col("vec_id") % 90).alias("y"))
    found = travel.patches(spots, own, [], 4).groupBy("vec_id").agg(F.count(F.lit(1)).alias("pixels"), F.percentile("z", F.lit(0.85)).alias("z"))
    return found.select("vec_id", "pixels", rounded(F.col("z"), 6).alias("z"))


# geometry


@query
def win_seg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    middle = lambda c: F.rint((F.col(c) + F.col(f"{c}2")) * 50.0).alias(f"mid_{c}")
    return segments(spark, sf).select("vec_id", "i", middle("x"), middle("y"), rounded(F.col("length"), 9).alias("length"))


@query
def fn_line_length(spark: SparkSession, sf: str) -> DataFrame:
    spots = polylines(spark, sf).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("points"))
    return spots.select("vec_id", rounded(geo.line_length(F.col("points")), 6).alias("length"))


@query
def fn_line_project(spark: SparkSession, sf: str) -> DataFrame:
    return geo.along(segments(spark, sf), "vec_id").select("vec_id", "i", rounded(F.col("position"), 6).alias("position"))


@query
def fn_angle(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("vec_id").orderBy("i")
    legs = segments(spark, sf).withColumn("bx", F.lead("x2").over(order) - F.col("x2")).withColumn("by", F.lead("y2").over(order) - F.col("y2")).filter("bx IS NOT NULL")
    found = geo.angle(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"), F.col("bx"), F.col("by"))
    return legs.select("vec_id", (F.col("i") + 1).alias("i"), rounded(found, 6).alias("angle"))


def _ends() -> list[Column]:
    return [F.col(c) for c in ("x", "y", "x2", "y2")]


@query
def fn_line_pt_dist(spark: SparkSession, sf: str) -> DataFrame:
    found = segments(spark, sf).select("vec_id", "i", rounded(geo.off_line(*_ends(), F.lit(0.0), F.lit(0.0)), 6).alias("distance"))
    return found.filter("distance IS NOT NULL")


@query
def fn_seg_dist(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select("vec_id", "i", rounded(geo.off_chord(*_ends(), F.lit(0.0), F.lit(0.0)), 6).alias("distance"))


def _length() -> Column:
    return geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))


@query
def fn_haversine(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("u", "v", rounded(_length(), 3).alias("length"))


@query
def gr_edge_len(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of edges; without coordinates 0."""
    return pairs(spark, sf).select("u", "v", rounded(F.coalesce(_length(), F.lit(0.0)), 3).alias("length"))


@query
def filt_edge_len(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).withColumn("length", _length()).filter("length <= 5000").select("u", "v", rounded(F.col("length"), 3).alias("length"))


@query
def filt_lat(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).filter(F.abs("lat") > 90).agg(F.count(F.lit(1)).alias("bad"))


@query
def fn_utm_zone(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).agg(F.avg("lon").alias("lon")).select(geo.utm_zone(F.col("lon")).alias("zone"))


def _utm(spark: SparkSession, sf: str) -> DataFrame:
    east, north = geo.utm(F.col("lat"), F.col("lon"), F.col("zone"))
    return nodes(spark, sf).withColumn("zone", geo.utm_zone(F.col("lon"))).select("*", east.alias("east"), north.alias("north"))


@query
def fn_utm_forward(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes in the zone of the first one, with its band's letter."""
    own = nodes(spark, sf)
    first = own.agg(F.min_by(F.struct("lat", "lon"), "node").alias("at"))  # one row
    zone = first.select(geo.utm_zone(F.col("at.lon")).alias("zone"), geo.utm_band(F.col("at.lat")).alias("letter"))
    east, north = geo.utm(F.col("lat"), F.col("lon"), F.col("zone"))
    return own.crossJoin(zone).select("node", "zone", "letter", rounded(east, 3).alias("east"), rounded(north, 3).alias("north"))


@query
def gr_node_geo(spark: SparkSession, sf: str) -> DataFrame:
    return _utm(spark, sf).select("node", "lat", "lon", "zone", rounded(F.col("east"), 2).alias("utm_east"), rounded(F.col("north"), 2).alias("utm_north"))


def road_edges(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, u, v, points in pixels: an edge of three points per line, at most 500 pixels wide."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p, k = F.col("l_partkey"), F.col("l_linenumber")
    points = F.array(at(p % 500, F.col("l_suppkey") % 500), at(p % 500 + k, F.col("l_suppkey") % 500), at(p % 500 + k, F.col("l_suppkey") % 500 + 2 * k))
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") % 16).alias("image_id"), F.col("l_orderkey").alias("u"), k.cast("bigint").alias("v"), points.alias("points"))


def _meta(spark: SparkSession) -> DataFrame:
    """Sixteen images of pixels of 0.000003 degrees."""
    key = F.col("id")
    return spark.range(16).select(key.alias("image_id"), (-115.5 + 0.25 * key).alias("x0"), (36.0 + 0.5 * key).alias("y0"), F.lit(3e-6).alias("pixel_x"), F.lit(-3e-6).alias("pixel_y"))


@query
def gr_edge_geo(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of edges along their vertices in the zone of their image's first edge."""
    found = geograph.measured(geograph.projected(geograph.located(road_edges(spark, sf), _meta(spark))))
    return found.select("image_id", "u", "v", "utm_zone", "utm_letter", rounded(F.col("length_latlon"), 9).alias("length_latlon"), rounded(F.col("length"), 3).alias("length_m"))


@query
def gr_project(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of edges in EPSG:3857."""
    found = geograph.projected(geograph.located(road_edges(spark, sf), _meta(spark)), "3857")
    rows = found.select("image_id", "u", "v", F.posexplode("points_3857").alias("i", "p"))
    return rows.select("image_id", "u", "v", "i", rounded(F.col("p.x"), 3).alias("x"), rounded(F.col("p.y"), 3).alias("y"))


@query
def fn_webmerc(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    return nodes(spark, sf).select("node", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query
def fn_affine(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.affine(F.col("l_partkey"), F.col("l_suppkey"), F.lit(1000.0), F.lit(0.3), F.lit(2000.0), F.lit(-0.3))
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("col_"), F.col("l_suppkey").alias("row_"), x.alias("x"), y.alias("y"))


@query
def fn_wkt_format(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    line = geo.wkt_of(F.array(at("l_suppkey", "l_partkey"), at("l_linenumber", "l_partkey")))
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", line.alias("wkt"))


@query
def fn_wkt_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Points of lines of up to seven points; a line of none is LINESTRING EMPTY."""
    parts = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda i: F.concat((F.col("l_suppkey") + i).cast("string"), F.lit(".5 "), F.col("l_partkey").cast("string"))), ", ")
    wkt = F.when(F.col("l_orderkey") % 9 == 0, geo.EMPTY).otherwise(F.concat(F.lit("LINESTRING ("), parts, F.lit(")")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geo.points_of(wkt).alias("points"))
    return rows.select("l_orderkey", "l_linenumber", F.size("points").cast("bigint").alias("n"), F.posexplode_outer("points").alias("i", "p")).select("l_orderkey", "l_linenumber", "n", F.coalesce("i", F.lit(-1)).alias("i"), "p.x", "p.y")


@query
def agg_extent(spark: SparkSession, sf: str) -> DataFrame:
    return polylines(spark, sf).groupBy("label").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), (F.max("y") - F.min("y")).alias("range_y"))


@query
def set_line_substr_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel lines along one way, from and to different points of it, half of them turned."""
    rows = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    first = F.col("l_suppkey") % 3
    steps = F.transform(F.sequence(first, first + F.col("l_linenumber")), lambda i: F.concat(i.cast("string"), F.lit(".0 "), (i * i).cast("string"), F.lit(".0")))
    own = rows.select(F.col("l_partkey").alias("edge"), F.row_number().over(order).alias("key"), F.when(F.col("l_orderkey") % 2 == 0, F.reverse(steps)).otherwise(steps).alias("points"))
    return lines.without_parts(own, "edge").select("edge", F.col("key").cast("bigint").alias("key"), F.array_join("points", ", ").alias("line"))


# rasters


@query
def agg_fold_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.truncated_mean(pixels(spark, sf), "x", "fold")


@query
def agg_stitch(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.stitch(pixels(spark, sf), "x", "y")


@query
def agg_tta_mean(spark: SparkSession, sf: str) -> DataFrame:
    small = pixels(spark, sf).select((F.col("x") % 64).alias("x"), (F.col("y") % 64).alias("y"), "v")
    return rasters.flips(small, 64).groupBy("x", "y").agg(rounded(F.avg("v"), 6).alias("v"))


@query
def fn_rescale_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.bounds(pixels(spark, sf))


@query
def fn_rescale_8bit(spark: SparkSession, sf: str) -> DataFrame:
    own = pixels(spark, sf)
    return rasters.to_8bit(own, rasters.bounds(own)).select("src", "x", "y", "band", "v")


@query
def fn_gamma_lut(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(256).select(F.col("id").cast("int").alias("i"), rasters.gamma(F.col("id")).alias("v"))


@query
def fn_onehot_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.one_hot(pixels(spark, sf).groupBy("x", "y").agg(F.max("band").alias("value")))


def _small(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Images of ``size`` cut from the keys."""
    cut = lambda c: (F.floor(F.col(c) / size).alias(f"image_{c}"), (F.col(c) % size).alias(c))
    return pixels(spark, sf).select(*cut("x"), *cut("y"), "v").groupBy("image_x", "image_y", "x", "y").agg(F.max("v").alias("v"))


@query
def tf_pad(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.pad(_small(spark, sf, 64), 64, 8)


@query
def tf_cut_border(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.cut_border(_small(spark, sf, 1000), 1000, 22).select("image_x", "image_y", "x", "y", "v")


@query
def img_geom_aug(spark: SparkSession, sf: str) -> DataFrame:
    own = pixels(spark, sf).groupBy((F.col("x") % 64).alias("x"), (F.col("y") % 64).alias("y")).agg(F.max("v").alias("v"))
    return rasters.turned(own, 64)


@query
def agg_hist(spark: SparkSession, sf: str) -> DataFrame:
    found = rasters.histogram(table(spark, sf, "lineitem"), F.col("l_discount") * 10, 29)
    return found.select("bin", rounded(F.col("share"), 6).alias("share"))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("x", "band", "fold", F.greatest(F.least(F.col("v") / 50.0, F.lit(1.0)), F.lit(0.0)).alias("p"), F.when(F.col("band") > 3, 1.0).otherwise(0.0).alias("t"))


@query
def agg_dice(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).groupBy(F.col("x").alias("image_id")).agg(rounded(rasters.dice(F.col("p"), F.col("t")), 6).alias("dice"))


@query
def agg_soft_dice(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).groupBy(F.col("x").alias("image_id")).agg(rounded(rasters.soft_dice_loss(F.col("p"), F.col("t")), 6).alias("loss"))


@query
def agg_focal(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).filter("band <> 7").groupBy("fold").agg(rounded(rasters.focal_loss(F.col("p"), F.col("t")), 6).alias("loss"))


@query
def agg_loss_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).groupBy("fold").agg(rounded(rasters.mixed_loss(F.col("p"), F.col("t")), 6).alias("loss"))


_ROAD = """road AS (SELECT row_number() OVER () AS rid, l_orderkey % 16 AS image_id, l_orderkey AS u, CAST(l_linenumber AS BIGINT) AS v, -115.5e0 + 0.25e0 * (l_orderkey % 16) AS x0, 36e0 + 0.5e0 * (l_orderkey % 16) AS y0,
    [l_partkey % 500, l_partkey % 500 + l_linenumber, l_partkey % 500 + l_linenumber] AS cols, [l_suppkey % 500, l_suppkey % 500, l_suppkey % 500 + 2 * l_linenumber] AS rows_ FROM lineitem),
    spot AS (SELECT rid, image_id, u, v, unnest(range(0, 3)) AS i, unnest(list_transform(cols, lambda c: c * 3e-6 + x0)) AS lon, unnest(list_transform(rows_, lambda r: r * -3e-6 + y0)) AS lat FROM road)"""
# UTM by the series of Krueger in the third flattening, published apart from Snyder's; they agree to a millimetre near the meridian
_KRUEGER = """zone AS (SELECT image_id, CAST(floor((arg_min(lon, [u, v, i]) + 180) / 6) + 1 AS INT) AS utm_zone, substring('CDEFGHJKLMNPQRSTUVWXX', 1 + CAST(floor((arg_min(lat, [u, v, i]) + 80) / 8) AS INT), 1) AS utm_letter FROM spot GROUP BY image_id),
    c AS (SELECT *, f / (2 - f) AS n FROM (SELECT 1 / 298.257223563e0 AS f) q),
    k AS (SELECT 6378137e0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS big, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM c),
    t AS (SELECT s.*, z.utm_zone, z.utm_letter, k.*, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon - (utm_zone * 6 - 183)) AS dl FROM spot s JOIN zone z USING (image_id) CROSS JOIN k),
    x AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t),
    utm AS (SELECT rid, image_id, u, v, i, lon, lat, utm_zone, utm_letter, 0.9996e0 * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS east,
        0.9996e0 * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS north FROM x)"""
_CROP = """CASE WHEN {b} <= {s} OR ceil(({b} - {p}) / ({s} - {p})) = 1 THEN [0] ELSE list_append(
    range(0, CAST({b} - {s} AS BIGINT), CAST({s} - floor(({s} * ceil(({b} - {p}) / ({s} - {p})) - {b}) / (ceil(({b} - {p}) / ({s} - {p})) - 1)) AS BIGINT)), CAST({b} - {s} AS BIGINT)) END"""
_SIZED = "sized AS (SELECT p_partkey AS image_id, 1400e0 + 60 * p_size AS w, 1300e0 + 200 * (p_partkey % 7) AS h FROM part)"
_KIND = "(SELECT * FROM (VALUES ('motorway', 55, 65, 1), ('Primary', 45, 55, 2), ('secondary_link', 35, 45, 3), ('residential', 25, 30, 5), ('track', 20, 20, 7), ('footway', -1, -1, 0)) AS k(kind, few, many, type_))"
_WAY = """way AS (SELECT p_partkey AS id, p_size, CASE p_type WHEN 'ECONOMY' THEN 'motorway' WHEN 'STANDARD' THEN 'Primary' WHEN 'SMALL' THEN 'secondary_link' WHEN 'MEDIUM' THEN 'residential' WHEN 'LARGE' THEN 'footway' ELSE 'track' END AS kind FROM part),
    osm AS (SELECT id, w.kind, p_size, CASE WHEN p_size % 3 = 0 AND p_size % 7 = 0 THEN -1 WHEN w.kind = 'footway' OR p_size % 10 = 0 THEN -1 ELSE few END AS mph FROM way w JOIN """ + _KIND + """ k ON k.kind = w.kind)"""
#: Speeds per road type in a list, for 1-2 and 3-12 lanes.
_SN3 = """sn3 AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 5 = 0 THEN 20e0 ELSE
    (CASE WHEN 1 + CAST(l_quantity AS INT) % 12 <= 2 THEN [55, 45, 35, 30, 25, 20, 20] ELSE [65, 55, 45, 35, 30, 20, 20] END)[l_linenumber] * CASE l_returnflag WHEN 'N' THEN 0.75e0 ELSE 1e0 END END AS mph FROM lineitem)"""

ORACLE_SQL = {
    "fn_seq_starts": f"WITH {_SIZED}, s AS (SELECT DISTINCT w, {_CROP.format(b='w', s='1300e0', p='64e0')} AS starts FROM sized) SELECT CAST(w AS INT) AS b, CAST(unnest(range(len(starts))) AS INT) AS i, CAST(unnest(starts) AS BIGINT) AS start FROM s",
    "sort_starts": f"WITH {_SIZED}, s AS (SELECT DISTINCT h, {_CROP.format(b='h', s='512e0', p='64e0')} AS starts FROM sized) SELECT CAST(h AS INT) AS dim, CAST(unnest(starts) AS BIGINT) AS start FROM s ORDER BY dim, start",
    "tf_crops": f"WITH {_SIZED}, a AS (SELECT image_id, h, unnest({_CROP.format(b='w', s='1300e0', p='64e0')}) AS x0 FROM sized) SELECT image_id, CAST(x0 AS BIGINT) AS x0, CAST(unnest({_CROP.format(b='h', s='1300e0', p='64e0')}) AS BIGINT) AS y0 FROM a",
    "fn_speed_rule": f"""WITH {_WAY}, {_SN3}, rules AS (
        SELECT 'sn3' AS dialect, id, mph FROM sn3 UNION ALL SELECT 'osm', id, CAST(mph AS DOUBLE) FROM osm
        UNION ALL SELECT 'sn5', id, CASE WHEN kind = 'footway' THEN NULL ELSE (CASE WHEN p_size % 4 >= 2 THEN many ELSE few END) * CASE p_size % 2 WHEN 0 THEN 1e0 ELSE 0.75e0 END END
        FROM way JOIN {_KIND} k USING (kind))
        SELECT dialect, id, min(mph) AS least_mph, max(mph) AS most_mph, count(*) AS n FROM rules GROUP BY dialect, id""",
    "filt_skipset": f"WITH {_WAY} SELECT id AS way_id, kind AS highway FROM osm WHERE mph >= 0",
    "fn_rescale_bounds": "SELECT CAST(l_linenumber AS INT) AS band, greatest(1e0, quantile_cont(l_quantity, 0.02e0)) AS bmin, quantile_cont(l_quantity, 0.98e0) AS bmax FROM lineitem GROUP BY 1",
    "agg_median_top": """WITH v AS (SELECT vec_id, list_transform(embedding[1:56], lambda e: greatest(least(floor((CAST(e AS DOUBLE) + 0.6e0) * 200e0), 255e0), 0e0)) AS vs FROM embeddings),
        t AS (SELECT vec_id, list_filter(vs, lambda x: x >= list_aggregate(vs, 'quantile_cont', 0.8e0)) AS top FROM v), m AS (SELECT vec_id, list_aggregate(top, 'quantile_cont', 0.5e0) AS median FROM t),
        k AS (SELECT s AS speed, 255e0 * s / 65e0 AS burn FROM range(0, 66) r(s)), ranked AS (SELECT vec_id, median, speed, row_number() OVER (PARTITION BY vec_id ORDER BY abs(burn - median), speed) AS place FROM m CROSS JOIN k)
        SELECT vec_id, round_even(median * 1e6, 0) / 1e6 AS median, CAST(speed AS INT) AS speed FROM ranked WHERE place = 1""",
    "fn_basename": "SELECT p_partkey AS id, 'merged_AOI_' || p_partkey AS name, 'AOI_' || p_partkey || '.tif.ovr' AS tail, 'AOI_' || p_partkey AS area FROM part",
    "join_img_label": "SELECT p_partkey AS id, 'SN3_roads_AOI_2_' || CASE WHEN p_partkey % 2 = 0 THEN 'PS-RGB' ELSE 'PS-MS' END || '_img' || p_partkey || '.tif' AS image, 'SN3_roads_AOI_2_geojson_roads_speed_img' || p_partkey || '.geojson' AS label FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)",
    "scan_lookup_img": """SELECT 'im' || p_partkey AS image_id, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_suppkey % 2 = 0 THEN 'RGB-PanSharpen_im' || s_suppkey || '.tif' WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'im' || s_suppkey || '.tif' END AS image
        FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""",
    "ds_imageprovider": "SELECT row_number() OVER (ORDER BY page_id) - 1 AS idx, lpad(CAST(page_id AS VARCHAR), 9, '0') || '_RGB.tif' AS name FROM pages WHERE page_id % 3 = 0",
    "gr_project": f"WITH {_ROAD} SELECT image_id, u, v, CAST(i AS INT) AS i, round_even(6378137e0 * radians(lon) * 1e3, 0) / 1e3 AS x, round_even(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) * 1e3, 0) / 1e3 AS y FROM spot",
    "gr_edge_geo": f"""WITH {_ROAD}, {_KRUEGER}, leg AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(east) OVER w AS east2, lead(north) OVER w AS north2 FROM utm WINDOW w AS (PARTITION BY rid ORDER BY i))
        SELECT image_id, u, v, utm_zone, utm_letter, round_even(sum(sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2))) * 1e9, 0) / 1e9 AS length_latlon, round_even(sum(sqrt(pow(east2 - east, 2) + pow(north2 - north, 2))) * 1e3, 0) / 1e3 AS length_m
        FROM leg WHERE lon2 IS NOT NULL GROUP BY rid, image_id, u, v, utm_zone, utm_letter""",
    "fn_utm_forward": duck_query(f"WITH {UTM} SELECT node, zone, substring('CDEFGHJKLMNPQRSTUVWXX', 1 + CAST(floor((36e0 + 80e0) / 8e0) AS INT), 1) AS letter, round_even(east * 1e3, 0) / 1e3 AS east, round_even(north * 1e3, 0) / 1e3 AS north FROM utm"),
    "set_line_substr_dedup": """WITH p AS (SELECT l_partkey AS edge, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS key, l_orderkey % 2 = 0 AS turned,
            list_transform(range(l_suppkey % 3, l_suppkey % 3 + l_linenumber + 1), lambda i: concat(i, '.0 ', i * i, '.0')) AS pts FROM lineitem),
        l AS (SELECT edge, key, array_to_string(CASE WHEN turned THEN list_reverse(pts) ELSE pts END, ', ') AS line, array_to_string(CASE WHEN turned THEN pts ELSE list_reverse(pts) END, ', ') AS back FROM p)
        SELECT edge, key, line FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.edge = a.edge AND b.key < a.key AND (contains(b.line, a.line) OR contains(b.line, a.back)))""",
    "fn_wkt_parse": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE l_linenumber END AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(n AS BIGINT) AS n, CAST(coalesce(i - 1, -1) AS INT) AS i, l_suppkey + i + 0.5e0 AS x, CASE WHEN i IS NOT NULL THEN CAST(l_partkey AS DOUBLE) END AS y FROM l, LATERAL (SELECT unnest(CASE n WHEN 0 THEN [NULL] ELSE range(1, CAST(n AS BIGINT) + 1) END) AS i) t""",
}
