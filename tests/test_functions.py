"""Operators as functions against values worked out by hand, numpy, and images drawn by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweft.functions import geo, names, rasters, speeds, tiles, travel
from roadweft.operators import flow


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("big", "small", "pad", "want"),
    [(3800, 1300, 64, [0, 834, 1668, 2500]), (1300, 1300, 64, [0]), (1000, 1300, 64, [0]), (1324, 768, 0, [0, 556]), (1400, 1300, 64, [0, 100]), (2536, 1300, 64, [0, 1236])],
)
def test_sequential_starts(spark, big, small, pad, want):
    assert one(spark, tiles.sequential_starts(F.lit(big), small, pad)) == want


def test_tile_starts(spark):
    assert one(spark, tiles.tile_starts(F.lit(3900))) == [0, 1280, 2560, 2600]
    assert one(spark, tiles.tile_starts(F.lit(1300))) == [0]


def props(**values):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


@pytest.mark.parametrize(
    ("dialect", "properties", "want"),
    [
        ("osm", {"highway": "primary", "class": "railway"}, 45.0),  # the class says nothing where there is a highway
        ("osm", {"class": "highway", "type": "Motorway_Link"}, 55.0),
        ("osm", {"class": "railway", "type": "motorway"}, -1.0),
        ("osm", {"name": "x"}, -1.0),
        ("osm", {"highway": "footway"}, -1.0),
        ("osm", {"highway": "residential", "tunnel": "yes"}, -1.0),
        ("osm", {"highway": "residential", "tunnel": "no"}, 25.0),
        ("osm", {"highway": "unheard_of"}, None),
        ("sn3", {"road_type": "5", "lane_numbe": "2", "paved": "1", "bridge_typ": "2"}, 25.0),
        ("sn3", {"road_type": "1", "lane_number": "3", "paved": "2", "bridge_type": "1"}, 48.75),
        ("sn3", {"road_type": "1", "lane_number": "3", "paved": "1"}, 20.0),  # malformed: an unclassified paved road of one lane
        ("sn3", {"road_type": "x", "lane_number": "3", "paved": "1", "bridge_type": "2"}, None),
        ("sn5", {"highway": "unclassified", "bridge": "null", "surface": "paved", "lanes": "2"}, 20.0),
        ("sn5", {"highway": "secondary", "bridge": "yes", "surface": "gravel", "lanes": "3.0"}, 33.75),
        ("sn5", {"highway": "secondary", "surface": "paved", "lanes": "13"}, None),
    ],
)
def test_speed_rules(spark, dialect, properties, want):
    assert one(spark, speeds.speed_mph(props(**properties), dialect)) == want


def test_features_with_speeds(spark):
    rows = [(1, {"road_type": "5", "lane_numbe": "2", "paved": "1", "bridge_typ": "2", "ingest_tim": "t"}), (2, {"road_type": "9", "lane_number": "2", "paved": "1", "bridge_type": "2"})]
    found = speeds.with_speeds(spark.createDataFrame(rows, "id int, properties map<string,string>"), "sn3").collect()
    assert [(r.id, r.inferred_speed_mph, r.inferred_speed_mps) for r in found] == [(1, 25.0, 11.176)]
    assert found[0].properties == {"road_type": "5", "lane_number": "2", "paved": "1", "bridge_type": "2", "ingest_time": "t"}


def test_nearest_speed(spark):
    keys = speeds.continuous_keys()
    values = [0.0, 1.9, 1.97, 255.0, 300.0, 100.0, 127.45, (keys[3][0] + keys[4][0]) / 2]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("s", speeds.nearest_speed(F.col("v"))).collect()
    assert {r.v: r.s for r in rows} == {v: min(keys, key=lambda k: (abs(k[0] - v), k[0]))[1] for v in values}


def test_wkt(spark):
    points = lambda wkt: one(spark, geo.points_of(F.lit(wkt)))
    assert [tuple(p) for p in points("LINESTRING (1 2, 3.5 -4e1,5 6)")] == [(1, 2), (3.5, -40), (5, 6)]
    assert points("LINESTRING EMPTY") == [] and points("POINT (1 2)") is None and points("") is None
    assert one(spark, geo.wkt_of(geo.points_of(F.lit("LINESTRING (1 2, 3.25 4, 5 6)")))) == "LINESTRING (1.0 2.0, 3.3 4.0, 5.0 6.0)"
    assert one(spark, geo.wkt_of(geo.points_of(F.lit("linestring empty")))) == "LINESTRING EMPTY"
    assert one(spark, geo.line_length(geo.points_of(F.lit("LINESTRING (0 0, 3 4, 3 10)")))) == 11.0


def test_utm_of_a_known_point(spark):
    """The CN Tower: 17T 630084 4833438."""
    lat, lon = F.lit(43.642567), F.lit(-79.387139)
    assert one(spark, geo.utm_zone(lon)) == 17 and one(spark, geo.utm_band(lat)) == "T"
    east, north = geo.utm(lat, lon, F.lit(17))
    assert abs(one(spark, east) - 630084) < 2 and abs(one(spark, north) - 4833438) < 2


def test_names(spark):
    assert one(spark, names.label_of(F.lit("SN3_AOI_2_PS-RGB_img7.tif"), "SN3")) == "SN3_AOI_2_geojson_roads_speed_img7.geojson"
    assert one(spark, names.label_of(F.lit("Pan-Sharpen_Atlanta_nadir7_748451_3743589.tif"), "SN4")) == "spacenet-roads_748451_3743589_speed.geojson"
    assert one(spark, names.root(F.lit("AOI_3_PS-MS_img1.v2.tif"))) == "AOI_3_img1"
    files = spark.createDataFrame([("RGB-PanSharpen_a.tif",), ("a.tif",), ("b.tif",)], "name string")
    found = names.resolved(spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string"), files)
    assert {r.image_id: r.image for r in found.collect()} == {"a": "RGB-PanSharpen_a.tif", "b": "b.tif", "c": None}


def test_patch_speeds(spark):
    level = spark.createDataFrame([(1, 0, 200), (1, 3, 200), (1, 5, 128), (2, 1, 50), (3, 2, 128)], "id int, channel int, z int")
    found = {r.id: (r.weighted_mph, r.argmax_mph) for r in travel.patch_speeds(level, "id").collect()}
    assert found == {1: ((7.5 + 35) / 2, 7.5), 2: (-1.0, -1.0), 3: (-1.0, 25.0)}


def test_sparse_percentile_is_numpys(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        some = rng.integers(1, 256, rng.integers(0, 30)).astype(float).tolist()
        rows.append((k, some, len(some) + int(rng.integers(1, 40))))
    found = spark.createDataFrame(rows, "k int, vs array<double>, n int").withColumn("p", travel.sparse_percentile(F.col("vs"), F.col("n"), 0.85)).collect()
    for r in found:
        assert r.p == pytest.approx(np.percentile([0.0] * (r.n - len(r.vs)) + r.vs, 85))


def test_losses_are_numpys(spark):
    rng = np.random.default_rng(2)
    p, t = rng.random(200), (rng.random(200) > 0.5).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t)], "p double, t double")
    got = df.agg(rasters.dice(F.col("p"), F.col("t")), rasters.soft_dice_loss(F.col("p"), F.col("t")), rasters.focal_loss(F.col("p"), F.col("t")), rasters.mixed_loss(F.col("p"), F.col("t"))).first()
    right = np.maximum(np.where(t == 1, p, 1 - p), 1e-8)
    dice, soft, focal = (2 * (p * t).sum() + 1) / (p.sum() + t.sum() + 1), 1 - (2 * (p * t).sum() + 1e-5) / (p.sum() + t.sum() + 1e-5), (-((1 - right) ** 2) * np.log(right)).mean()
    assert list(got) == pytest.approx([dice, soft, focal, 0.75 * focal + 0.25 * soft])


def predictions(spark, images):
    """Pixels of images (bands, 120, 120)."""
    rows = [(k, int(b), int(y), int(x), float(image[b, y, x])) for k, image in images.items() for b, y, x in zip(*np.nonzero(image))]
    return spark.createDataFrame(rows, "image_id bigint, band int, y int, x int, v double")


def test_flow_of_a_drawn_image(spark):
    """A straight road across image 1 whose channel 2 (25 mph) is bright, a crossing in image 2, and
    in image 3 a blot too small for a road."""
    road, cross, blot = (np.zeros((8, 120, 120)) for _ in range(3))
    road[7, 57:64, :] = road[2, 57:64, :] = 255
    cross[7, 57:64, :] = cross[7, :, 57:64] = cross[4, 57:64, :] = cross[4, :, 57:64] = 255
    blot[7, 50:54, 50:54] = blot[1, 50:54, 50:54] = 255
    found = flow.solution(predictions(spark, {1: road, 2: cross, 3: blot}), 120, 120, hole=100).collect()
    by = {}
    for r in found:
        by.setdefault(r.ImageId, []).append(r)
    assert [(r.WKT_Pix, r.length_m, r.travel_time_s) for r in by["3"]] == [("LINESTRING EMPTY", 0.0, 0.0)]
    (line,) = by["1"]
    (x0, y0), *_, (x1, y1) = [tuple(map(float, p.split())) for p in line.WKT_Pix[12:-1].split(", ")]
    assert abs(abs(x1 - x0) - 116) <= 4 and all(abs(y - 60) <= 2 for y in (y0, y1))
    assert line.length_m == pytest.approx(0.3 * np.hypot(x1 - x0, y1 - y0), abs=0.6)
    assert line.travel_time_s == pytest.approx(round(3600 * line.length_m * 0.000621371 / 25, 3), abs=0.002)
    assert len(by["2"]) == 4 and all(r.travel_time_s == pytest.approx(3600 * r.length_m * 0.000621371 / 45, abs=0.002) for r in by["2"])
    assert sum(r.length_m for r in by["2"]) == pytest.approx(0.3 * 232, abs=4)


def test_flow_leaves_out_short_graphs(spark):
    image = np.zeros((8, 120, 120))
    image[7, 57:64, :] = image[0, 57:64, :] = image[7, 20:27, 30:70] = 255
    wkt = lambda **o: len(flow.solution(predictions(spark, {1: image}), 120, 120, hole=100, **o).collect())
    assert wkt() == 2 and wkt(min_length=60.0) == 1


def test_registered_sql_functions(spark):
    from roadweft.functions.register import register, soft_dice

    register(spark)
    assert spark.sql("SELECT mph_to_mps(100D), burn_continuous(13D), burn_binned(21D), channel_of_burn(108)").first()[:] == (pytest.approx(44.704), 51.0, 108, 2)
    assert sorted(r.start for r in spark.sql("SELECT start FROM tile_starts(3900)").collect()) == [0, 1280, 2560, 2600]
    assert [tuple(r) for r in spark.sql("SELECT pos, x, y FROM wkt_points('LINESTRING (1 2, 3.5 4)') ORDER BY pos").collect()] == [(0, 1, 2), (1, 3.5, 4)]
    assert spark.sql("SELECT * FROM wkt_points('LINESTRING EMPTY')").count() == 0
    got = spark.sql("SELECT k, soft_dice(p, t) AS loss FROM VALUES (1, 0.5D, 1D), (1, 1D, 1D), (2, 0D, 1D) AS v(k, p, t) GROUP BY k ORDER BY k").collect()
    import pandas as pd

    assert [r.loss for r in got] == pytest.approx([soft_dice(pd.Series([0.5, 1.0]), pd.Series([1.0, 1.0])), soft_dice(pd.Series([0.0]), pd.Series([1.0]))])


def test_scores_are_batched_padded_and_turned_back(spark, tmp_path):
    from roadweft.operators import scoring
    from roadweft.sources import codecs

    rng = np.random.default_rng(3)
    made = {f"im{k}.tif": rng.integers(0, 255, (3, 20 + k % 2, 30)).astype(np.uint8) for k in range(7)}
    df = spark.createDataFrame([(n, codecs.write_tiff(i)) for n, i in made.items()], "name string, content binary").repartition(2)
    seen = str(tmp_path / "seen")

    def load():
        def model(images):
            with open(seen, "a") as out:
                out.write(f"{len(images)} {images.shape[2]}x{images.shape[3]}\n")
            ramp = np.linspace(0, 1, images.shape[3])[None, None, None]  # a model that flips don't commute with
            return np.concatenate([images[:, :1] / 255 * ramp, images[:, 1:2] / 255], 1)

        return model

    found = {r["name"]: codecs.read(bytes(r.content))[0] for r in scoring.score(df, load, batch=2, flips=1, border=4, fold=3).collect()}
    assert set(found) == {f"fold3_{n}" for n in made}
    for name, image in made.items():
        got = found[f"fold3_{name}"]
        assert got.shape == (2, *image.shape[1:]) and (np.abs(got[1].astype(int) - image[1]) <= 1).all()
        assert (np.abs(got[0].astype(int) - image[0] / 2) <= 1.01).all()  # the ramp and its mirror image make a half
    assert {line.split()[1] for line in open(seen)} == {"28x38", "29x38"} and {int(line.split()[0]) for line in open(seen)} <= {1, 2}


def test_shapefile_round_trip():
    from roadweft.sources import shapes

    lines = [[(0.0, 1.5), (2.0, -3.25)], [(5.0, 6.0), (7.0, 8.0), (9.0, 1e7)]]
    shp, shx, dbf = shapes.write_lines(lines, [{"id": 1, "a_long_name_here": "x"}, {"id": 2, "a_long_name_here": None}])
    assert [(parts, values) for parts, values in shapes.read_lines(shp, dbf)] == [([lines[0]], {"id": "1", "a_long_nam": "x"}), ([lines[1]], {"id": "2", "a_long_nam": ""})]
    assert int.from_bytes(shp[24:28], "big") * 2 == len(shp) and int.from_bytes(shx[24:28], "big") * 2 == len(shx) == 100 + 16
    assert shapes.read_lines(*[shapes.write_lines([], [])[k] for k in (0, 2)]) == []


def test_utm_agrees_with_another_series(spark):
    """Within a millimetre or two of the query's oracle by Krueger's series, as the lengths show."""
    from roadweft.operators import geograph

    edges = spark.createDataFrame([(1, 10, 11, [(0.0, 0.0), (100.0, 50.0)])], "image_id int, u int, v int, points array<struct<x:double,y:double>>")
    meta = spark.createDataFrame([(1, -79.387139, 43.642567, 3e-6, -3e-6)], "image_id int, x0 double, y0 double, pixel_x double, pixel_y double")
    row = geograph.measured(geograph.projected(geograph.located(edges, meta))).first()
    assert (row.utm_zone, row.utm_letter) == (17, "T") and abs(row.points_utm[0].x - 630084) < 2 and abs(row.points_utm[0].y - 4833438) < 2
    assert row.length == pytest.approx(np.hypot(100 * 3e-6 * 111320 * np.cos(np.radians(43.6425)), 50 * 3e-6 * 111050), rel=0.01)
    assert row.geometry_latlon_wkt.startswith("LINESTRING (-79.387139 43.642567, ")
    far = edges.select("image_id", "u", "v", F.expr("transform(points, p -> named_struct('x', p.x * 1000, 'y', p.y))").alias("points"))
    with pytest.raises(Exception, match="too long"):
        geograph.measured(geograph.projected(geograph.located(far, meta))).collect()


def test_colours_there_and_back():
    from roadweft.operators import augment

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    assert (np.abs(augment.from_lab(augment.to_lab(image)).astype(int) - image) <= 1).all()
    assert (np.abs(augment.from_hsv(augment.to_hsv(image)).astype(int) - image) <= 6).all()  # hue has 180 steps
    assert augment.to_hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [7, 7, 7]]], np.uint8)).tolist() == [[[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 7]]]
    assert augment.to_lab(np.array([[[255, 255, 255]]])).round(1).tolist() == [[[100, 0, 0]]]
    assert (augment.shift_hsv(np.array([[[255, 0, 0]]], np.uint8), 60, 0, 0) == [0, 255, 0]).all()
    assert augment.shift_channels(np.array([[[250, 5, 9]]], np.uint8), 20, -20, 1).tolist() == [[[255, 0, 10]]]


def test_filters():
    from roadweft.operators import augment

    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (32, 48, 3)).astype(np.uint8)
    blurred = augment.box_blur(image, 3)
    assert blurred[5, 7, 1] == np.rint(image[4:7, 6:9, 1].mean()) and blurred.shape == image.shape
    flat = np.full((32, 48, 3), 90, np.uint8)
    assert (augment.box_blur(flat, 5) == 90).all() and (augment.sharpen(flat) == 90).all()
    grey = np.clip(rng.normal(120, 6, (256, 256)), 0, 255).astype(np.uint8)
    wider = augment.limited_contrast(grey, 4.0)
    assert wider.std() > 1.5 * grey.std() and augment.limited_contrast(grey, 1.0).std() < wider.std()
    order = np.argsort(np.unique(grey))
    one = augment.limited_contrast(grey, 4.0, grid=1)  # one tile: one rising map
    assert (np.diff([one[grey == v][0].astype(int) for v in np.unique(grey)[order]]) >= 0).all()
    assert augment.clahe(image).shape == image.shape and (augment.random_filter(image, 1) == augment.clahe(image)).all()
