"""Distributed numbering against sorting."""

import random

from roadweft.operators.ranking import numbered


def test_places_over_several_partitions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None])) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, pos_of string").repartition(5)
    got = {r.k: r.place for r in numbered(df, "pos_of", "k", name="place").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert got == {k: at for at, (k, _) in enumerate(want)}


def test_nothing_to_number(spark):
    got = numbered(spark.createDataFrame([], "k int"), "k")
    assert got.columns == ["k", "pos"] and got.count() == 0
