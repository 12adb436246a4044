"""Sources, sinks, configuration, streaming extension, and the driver's entry."""

import json

import pytest

from roadweft.sources import files, sinks


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 36.0, 1), (1, 72.0, 11)], "idx int, burn double, speed int")
    sinks.csv(df, str(tmp_path / "c"))
    sinks.csv(df.limit(1), str(tmp_path / "c"), overwrite=False)
    back = files.csv(spark, str(tmp_path / "c"), df.schema, indexed=True)
    assert sorted(map(tuple, back.collect())) == [(36.0, 1), (72.0, 11)]


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"properties": {"highway": "primary"}, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.geojson").write_text("{ not json")
    found = files.geojson(spark, str(tmp_path)).collect()
    assert [(r.properties["highway"], r.kind, r.points) for r in found] == [("primary", "LineString", [[0, 1], [2, 3]])]


def test_geojson_kinds(spark, tmp_path):
    feature = lambda kind, coordinates: {"type": "Feature", "properties": {"n": 1.5, "none": None}, "geometry": {"type": kind, "coordinates": coordinates}}
    kinds = [feature("Point", [1, 2]), feature("MultiLineString", [[[0, 1, 9], [2, 3, 9]], [[4, 5], [6, 7]]]), {"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"x": 1}, "features": kinds}))
    found = files.geojson(spark, str(tmp_path)).orderBy("feature", "part").collect()
    assert [(r.feature, r.kind, r.part, r.points) for r in found] == [
        (0, "Point", 0, [[1, 2]]), (1, "MultiLineString", 0, [[0, 1, 9], [2, 3, 9]]), (1, "MultiLineString", 1, [[4, 5], [6, 7]]), (2, None, None, None)
    ]
    assert found[0].properties == {"n": "1.5", "none": None}


def test_geojson_sink_is_read_back(spark, tmp_path):
    df = spark.sql("SELECT id % 2 AS image, id, map('highway', 'primary') AS properties, named_struct('type', 'LineString', 'coordinates', array(array(id * 1.5D, 2D), array(3D, 4D))) AS geometry FROM range(6)")
    sinks.geojson(df.repartition(3), str(tmp_path / "out"), "image", "id")
    parts = sorted((tmp_path / "out").glob("image=*/part-*"))
    assert [len(json.loads(p.read_text())["features"]) for p in parts] == [3, 3]
    assert sorted(r.points[0][0] for r in files.geojson(spark, str(tmp_path / "out")).collect()) == [0, 1.5, 3, 4.5, 6, 7.5]


def test_bands_are_oriented():
    import numpy as np

    assert files.oriented(np.zeros((8, 30, 40))).shape == (8, 30, 40)
    assert files.oriented(np.zeros((30, 40, 3))).shape == (3, 30, 40)
    assert files.oriented(np.zeros((30, 40))).shape == (1, 30, 40)


def test_listing(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    assert [(r.name, r.bytes) for r in files.listing(spark, str(tmp_path)).collect()] == [("a.tif", 3)]


def test_graph_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, "a")], "u bigint, v bigint, image_id string")
    sinks.graph(edges.select("u", "image_id"), edges, str(tmp_path))
    assert files.graph(spark, str(tmp_path))[1].count() == 1


def test_config_is_strict(tmp_path):
    import dataclasses

    good = dataclasses.asdict(files.Config())
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert files.Config.load(str(tmp_path / "c.json")) == files.Config()
    (tmp_path / "c.json").write_text(json.dumps(good | {"more": 1}))
    with pytest.raises(ValueError):
        files.Config.load(str(tmp_path / "c.json"))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from roadweft.streaming.travel import window_means

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = window_means(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("means").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("means").count() == window_means(events).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rasters_as_files(spark, tmp_path):
    rows = [("a", band, y, x, float(band * 10 + y + x)) for band in (1, 2) for y in range(3) for x in range(4)]
    pixels = spark.createDataFrame(rows, "name string, band int, y int, x int, v double")
    folder = str(tmp_path / "images")
    written = sinks.images(sinks.encoded(pixels, 3, 4, 2), folder).collect()
    assert [r.name for r in written] == ["a.tif"]
    assert [r.name for r in files.listing(spark, folder).collect()] == ["a.tif"]
    decoded = files.bands(files.rasters(spark, folder))
    assert [(r.band, r.height, r.width, r.x0) for r in decoded.orderBy("band").collect()] == [(1, 3, 4, None), (2, 3, 4, None)]
    got = {(r.band, r.y, r.x, r.v) for r in files.pixels(decoded).collect()}
    assert got == {(band, y, x, v) for _, band, y, x, v in rows}


def test_no_rasters(spark):
    assert files.pixels(files.bands(spark.createDataFrame([], "name string, content binary"))).count() == 0
