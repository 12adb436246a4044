"""Shapefiles in pieces: the bytes of whole files, whatever the size of pieces, and read back."""

import random
import time

from pyspark.sql import functions as F

from roadweft.sources import files, shapes, sinks


def rows_of(n):
    rng = random.Random(4)
    line = lambda k: [(rng.uniform(-9, 9), float(k)) for _ in range(k % 4)]
    return [(k % 2 or None, k, line(k), {"id": str(k), "näme of road": rng.choice([None, "", "é" * 200, " a b "])}) for k in range(n)]


def test_pieces_are_the_whole_file_and_read_back(spark):
    rows = rows_of(50)
    df = spark.createDataFrame(rows, "image int, pos int, points array<struct<x:double,y:double>>, attributes map<string,string>")
    names = df.select("attributes").first().attributes
    found = sinks.shapefiles(df, "image", piece_lines=7).collect()
    assert {r.piece for r in found} == {0, 1, 2, 3}
    for image, stem in ((1, "1"), (None, "null")):
        own = [r for r in rows if r[0] == image]
        whole = shapes.write_lines([r[2] for r in own], [{n: r[3][n] for n in names} for r in own])
        for end, content in zip(("shp", "shx", "dbf"), whole):
            assert b"".join(bytes(r.content) for r in sorted(found, key=lambda r: r.piece) if r.name == f"{stem}.{end}") == content
    kinds = "name string, piece bigint, content binary"
    pieces = files.shapefiles(spark.createDataFrame(found, kinds)).collect()
    joined = [(n, b"".join(bytes(r.content) for r in sorted(found, key=lambda r: r.piece) if r.name == n)) for n in {r.name for r in found}]
    again = files.shapefiles(spark.createDataFrame([*joined, ("x.shp", b"alone")], "name string, content binary")).collect()
    assert sorted(map(str, pieces)) == sorted(map(str, again)) and len(pieces) == 50
    for r in pieces:
        want = [w for w in rows if (w[0] is None) == (r.name == "null")][r.pos]
        assert [tuple(p) for p in r.points] == want[2] and r.attributes["id"] == want[3]["id"]


def test_many_lines_take_time_in_proportion():
    """Bytes that grew by a record at a time were copied for every record: 200 000 took minutes."""
    lines = [[(0.0, float(k)), (1.0, 2.0)] for k in range(200_000)]
    began = time.time()
    shp, shx, dbf = shapes.write_lines(lines, [{"id": 1}] * len(lines))
    assert len(shp) == 100 + len(lines) * (56 + 32) and time.time() - began < 20
    assert [p for p, _ in shapes.read_lines(shp, dbf)][-1] == [lines[-1]]


def test_one_image_is_written_by_many_tasks(spark):
    lines = spark.range(100).select(F.lit(1).alias("image"), F.col("id").alias("pos"), F.expr("array(struct(0D AS x, 1D AS y))").alias("points"), F.expr("map('id', string(id))").alias("attributes"))
    found = sinks.shapefiles(lines, "image", piece_lines=10)
    assert found.groupBy("name").count().collect()[0]["count"] == 10
