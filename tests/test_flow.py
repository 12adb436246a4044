"""The flow on rasters: levels of boxes against brute force, and plans without a row per pixel."""

import numpy as np
from pyspark.sql import functions as F

from roadweft.operators import flow, kernels


def test_box_levels_count_only_pixels_of_the_image():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (17, 23)).astype(float)
    y, x = rng.integers(-9, 27, 300), rng.integers(-9, 33, 300)
    for reach, p in ((6, 0.85), (1, 0.5), (0, 0.3)):
        found = flow.box_levels(image, y, x, reach, p)
        for a, b, z in zip(y, x, found):
            box = image[max(0, a - reach) : max(0, a + reach + 1), max(0, b - reach) : max(0, b + reach + 1)].ravel()
            want, at = np.sort(box), p * (box.size - 1)
            low = int(np.floor(at))
            assert z == (np.floor(want[low] + (want[int(np.ceil(at))] - want[low]) * (at - low)) if box.size else 0)


def test_speeds_neither_broadcast_nor_make_a_row_per_pixel(spark):
    """An estimate knows nothing of the 169 pixels a box has: 4000 segments looked small enough to broadcast."""
    points = F.expr("transform(sequence(0, 4), k -> struct(cast(10 * k AS double) AS x, cast(id % 40 AS double) AS y))")
    edges = spark.range(1000).select((F.col("id") % 4).alias("image_id"), F.col("id").alias("edge"), points.alias("points"))
    raw = [flow.raster_bytes(np.full((40, 50), v)) for v in (100.0, 200.0)]
    bands = spark.createDataFrame([(i, b, bytearray(raw[b])) for i in range(4) for b in (0, 1)], flow.RASTER)
    found = flow.edge_speeds(edges, bands, 40, 50, 2)
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and plan.split("== Physical Plan ==")[1].count("Generate ") == 1
    assert found.count() == 1000 and {r.channel for r in found.collect()} == {1}


def test_rasters_hold_pixels(spark):
    rows = spark.createDataFrame([(5, 0, 1, 2, 7.0), (5, 0, 3, 0, 9.5), (5, 3, 0, 0, None)], "image_id int, band int, y int, x int, v double")
    found = {(r.image_id, r.band): flow.raster_of(r.v, 4, 3) for r in flow.rasters(rows, 4, 3).collect()}
    want = np.zeros((4, 3))
    want[1, 2], want[3, 0] = 7.0, 9.5
    assert set(found) == {(5, 0), (5, 3)} and (found[5, 0] == want).all() and not found[5, 3].any()


def test_thinning_by_table_is_the_published_rule():
    rng = np.random.default_rng(5)
    for _ in range(20):
        now = mask = kernels.dilate((rng.random((25, 31)) < 0.1).astype(np.uint8), 3)
        while True:
            before = now
            for step in (0, 1):
                next_ = now.copy()
                padded = np.pad(now, 1)
                for y, x in zip(*np.nonzero(now)):
                    r = [int(padded[y + 1 + dy, x + 1 + dx]) for dy, dx in kernels.RING]
                    n, e, s, w = r[0], r[2], r[4], r[6]
                    free = not (n and e and s) and not (e and s and w) if step == 0 else not (n and e and w) and not (n and s and w)
                    if 2 <= sum(r) <= 6 and sum(not r[k] and r[(k + 1) % 8] for k in range(8)) == 1 and free:
                        next_[y, x] = 0
                now = next_
            if (now == before).all():
                break
        assert (kernels.thin(mask) == now).all()
