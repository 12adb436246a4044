"""File names: roots, labels that belong to images, images by their channels, providers by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of file names (fixed values).
CHIPS = ("PS-RGB", "PS-MS")
BY_CHANNELS = {3: "RGB-PanSharpen_", 8: "MUL-PanSharpen_"}


def root(name: Column) -> Column:
    """A file's name up to its first point, without the marks of chips."""
    for chip in CHIPS:
        name = F.replace(name, F.lit(f"{chip}_"), F.lit(""))
    return F.split_part(name, F.lit("."), F.lit(1))


def after(name: Column, prefix: str) -> Column:
    """What follows the last ``prefix`` in a name, or all of it."""
    return F.substring_index(name, prefix, -1)


def area_root(name: Column) -> Column:
    """A name by the convention that its area of interest (AOI...) begins it."""
    return F.concat(F.lit("AOI"), F.split_part(F.substring_index(name, "AOI", -1), F.lit("."), F.lit(1)))


def label_of(image: Column, kind: str) -> Column:
    """The GeoJSON file of an image's labels, for SN3, SN4 or SN5 names."""
    stem = F.split_part(image, F.lit("."), F.lit(1))
    if kind in ("SN3", "SN5"):
        for chip in CHIPS:
            stem = F.replace(stem, F.lit(chip), F.lit("geojson_roads_speed"))
        return F.concat(stem, F.lit(".geojson"))
    if kind == "SN4":
        return F.concat(F.lit("spacenet-roads_"), F.substring_index(stem, "_", -2), F.lit("_speed.geojson"))
    raise ValueError(f"unknown kind of labels: {kind}")


def resolved(ids: DataFrame, files: DataFrame, channels: int = 3) -> DataFrame:
    """``ids`` (image_id) with image: the file (name) with the prefix of its channels, else the plain
    one; null where neither is there."""
    prefix = BY_CHANNELS.get(channels, BY_CHANNELS[8])
    names = files.select("name").distinct()
    a, b = names.select(F.col("name").alias("_a")), names.select(F.col("name").alias("_b"))
    own = F.concat("image_id", F.lit(".tif"))
    found = ids.join(a, F.concat(F.lit(prefix), own) == F.col("_a"), "left").join(b, own == F.col("_b"), "left")
    return found.withColumn("image", F.coalesce("_a", "_b")).drop("_a", "_b")


def provider(files: DataFrame, suffix: str | None = None) -> DataFrame:
    """(idx, name): the files that hold ``suffix`` in their names, numbered in the order of names."""
    from roadweft.operators.ranking import numbered

    kept = files.select("name") if suffix is None else files.filter(F.contains("name", F.lit(suffix))).select("name")
    return numbered(kept, "name", name="idx")
