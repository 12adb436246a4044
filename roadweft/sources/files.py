"""Sources: listings, CSV, GeoJSON, graphs, configuration."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweft.sources import codecs, shapes

IMAGES = "*.{tif,tiff,jpg,JPEG,JPG,png}"
#: Coordinates are read as text, since they nest by the kind of geometry.
GEOJSON = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
#: Brackets around a position of a kind (fixed values of the format).
_NESTED = {"Point": 0, "LineString": 1, "MultiPoint": 1, "MultiLineString": 2, "Polygon": 2}
#: A mask's first axis is its bands if it is shorter than this (fixed value).
MOST_BANDS = 20


def listing(spark: SparkSession, folder: str, pattern: str = IMAGES) -> DataFrame:
    """(path, name, bytes) of the files below a folder that match, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def rasters(spark: SparkSession, folder: str, pattern: str = IMAGES) -> DataFrame:
    """Raw rasters (path, name, content), for `bands`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def csv(spark: SparkSession, path: str, schema: str | T.StructType, indexed: bool = False) -> DataFrame:
    """A CSV with a header and a stated schema; ``indexed`` drops its unnamed first column."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.drop(rows.columns[0]) if indexed else rows


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature, properties, kind, part, points) of every feature of the FeatureCollections in a
    folder's files, feature being its place in the file. Geometries of several lines or rings give a
    row per part; points are [x, y, ...] of any number of dimensions. A feature without a geometry
    that can be read has null points; unreadable files give no rows; every property is text."""
    files = spark.read.schema(GEOJSON).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = files.filter("type = 'FeatureCollection' OR type IS NULL").select(F.input_file_name().alias("path"), F.posexplode("features").alias("feature", "f"))
    text, kind, parts = F.col("f.geometry.coordinates"), F.col("f.geometry.type"), F.lit(None).cast("array<array<array<double>>>")
    for name, depth in _NESTED.items():
        read = F.from_json(text, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        parts = F.when(kind == name, F.array(F.array(read)) if not depth else F.array(read) if depth == 1 else read).otherwise(parts)
    return rows.select("path", "feature", F.col("f.properties").alias("properties"), kind.alias("kind"), F.posexplode_outer(parts).alias("part", "points"))


def shapefiles(files: DataFrame) -> DataFrame:
    """(name, pos, part, points, attributes) of the lines of shapefiles (name, content), whose .shp and
    .dbf are there; other files are passed over. Files may come in pieces (name, piece, content), as
    `sinks.shapefiles` makes them: pieces of a number hold the same records, whole, the headers
    are in piece 0."""
    piece = F.col("piece").cast("bigint") if "piece" in files.columns else F.lit(0).cast("bigint")
    kind = F.regexp_extract("name", r"\.([^.]*)$", 1)
    parts = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), piece.alias("piece"), kind.alias("kind"), "content").filter(F.col("kind").isin("shp", "dbf"))
    # a .dbf says at its ninth byte, in two, how long its header is
    long = F.conv(F.hex(F.concat(F.substring("content", 10, 1), F.substring("content", 9, 1))), 16, 10).cast("int")
    tables = parts.filter((F.col("kind") == "dbf") & (F.col("piece") == 0))
    heads = tables.select(F.col("stem").alias("_stem"), F.substring(F.col("content"), F.lit(1), long).alias("head"))
    both = parts.join(heads, F.col("stem") == F.col("_stem")).drop("_stem")

    def step(rows: pa.Table) -> pa.Table:
        content = dict(zip(rows["kind"].to_pylist(), rows["content"].to_pylist()))
        stem, number = rows["stem"][0].as_py(), rows["piece"][0].as_py()
        if len(content) < 2:
            return pa.table({c: pa.array([], t) for c, t in _SHAPE_TYPES.items()})
        shp, dbf = content["shp"], content["dbf"]
        start, width, fields = shapes.read_head(rows["head"][0].as_py())
        if number:
            start, at, first = 0, 0, int.from_bytes(shp[:4], "big") - 1
            count = len(dbf) // width  # but for the byte that ends the file
        else:
            at, first = 100, 0
            count = min(int.from_bytes(dbf[4:8], "little"), (len(dbf) - start) // width)
        xy, lengths, parts = shapes.read_records(shp, at, count)
        record = np.repeat(np.arange(count), parts)
        place = np.arange(len(record)) - np.repeat(np.cumsum(parts) - parts, parts)
        offset = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        points = pa.ListArray.from_arrays(offset(lengths), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))
        values = [v for row in zip(*shapes.read_rows(dbf, start, count, width, fields)) for v in row]
        maps = pa.MapArray.from_arrays(offset(np.full(count, len(fields))), pa.array([f[0] for f in fields] * count, pa.string()), pa.array(values, pa.string()))
        columns = [pa.array([stem] * len(record), pa.string()), pa.array(first + record, pa.int32()), pa.array(place, pa.int32()), points, maps.take(pa.array(record))]
        return pa.table(dict(zip(_SHAPE_TYPES, columns)))

    return both.groupBy("stem", "piece").applyInArrow(step, "name string, pos int, part int, points array<struct<x:double,y:double>>, attributes map<string,string>")


_SHAPE_TYPES = {
    "name": pa.string(), "pos": pa.int32(), "part": pa.int32(),
    "points": pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), "attributes": pa.map_(pa.string(), pa.string()),
}


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a stored graph."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


@dataclasses.dataclass(frozen=True)
class Config:
    """Settings of a run; unknown and missing keys are errors. Names are the configuration files'."""

    path_src: str = ""
    path_results_root: str = ""
    save_weights_dir: str = ""
    num_channels: int = 3
    network: str = "resnet34"
    skeleton_thresh: float = 0.25
    use_medial_axis: int = 0
    min_subgraph_length_pix: int = 600
    min_spur_length_m: int = 12
    rdp_epsilon: int = 1
    skeleton_band: int = 7
    intersection_band: int = -1
    early_stopper_patience: int = 5
    num_folds: int = 1
    default_val_perc: float = 0.2
    train_data_refined_dir_ims: str = ""
    train_data_refined_dir_masks: str = ""
    speed_conversion_file: str = ""
    folds_file_name: str = "folds4.csv"
    test_data_refined_dir: str = ""
    test_results_dir: str = ""
    test_sliced_dir: str = ""
    slice_x: int = 1300
    slice_y: int = 1300
    stride_x: int = 1280
    stride_y: int = 1280
    GSD: float = 0.3
    tile_df_csv: str = "tile_df.csv"
    folds_save_dir: str = "folds"
    merged_dir: str = "merged"
    stitched_dir_raw: str = "stitched/mask_raw"
    stitched_dir_norm: str = "stitched/mask_norm"
    stitched_dir_count: str = "stitched/mask_count"
    wkt_submission: str = "wkt_submission_nospeed.csv"
    skeleton_dir: str = "skeleton"
    skeleton_pkl_dir: str = "sknw_gpickle"
    graph_dir: str = "graphs"
    iter_size: int = 1
    target_rows: int = 512
    target_cols: int = 512
    loss: dict = dataclasses.field(default_factory=lambda: {"soft_dice": 0.25, "focal": 0.75})
    optimizer: str = "adam"
    lr: float = 0.00015
    lr_steps: list = dataclasses.field(default_factory=lambda: [20, 25])
    lr_gamma: float = 0.2
    batch_size: int = 12
    epoch_size: int = 8
    nb_epoch: int = 70
    predict_batch_size: int = 1
    test_pad: int = 64
    num_classes: int = 8
    warmup: int = 0
    ignore_target_size: bool = False
    padding: int = 22
    eval_rows: int = 1344
    eval_cols: int = 1344
    log_to_console: int = 0

    @classmethod
    def of(cls, text: str) -> "Config":
        """A configuration from its JSON."""
        given = json.loads(text)
        known = {f.name for f in dataclasses.fields(cls)}
        if bad := sorted(set(given) ^ known):
            raise ValueError(f"unknown or missing keys: {bad}")
        return cls(**given)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> "Config":
        """A configuration file, local, or anywhere that ``spark`` reads."""
        text = Path(path).read_text() if spark is None else spark.read.text(path, wholetext=True).first()[0]
        return cls.of(text)

    def updated(self, **changes) -> "Config":
        return dataclasses.replace(self, **changes)


BAND = "name string, band int, height int, width int, x0 double, y0 double, pixel_x double, pixel_y double, type string, pixels binary"


def oriented(image: np.ndarray) -> np.ndarray:
    """Rows, columns and bands in any usual order as (band, y, x): a first axis shorter than
    MOST_BANDS is the bands, else the last one; an image of two axes has one band."""
    if image.ndim == 2:
        return image[None]
    return image if image.shape[0] < MOST_BANDS else np.moveaxis(image, -1, 0)


def bands(images: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Decoded bands (schema BAND, pixels row by row, counted from 1) of images (name, content), one
    image at a time; of ``wanted`` bands those that a file has, in that order. Geography is null
    where a file has none. Files that are no TIFF or PNG are errors."""

    def step(batches):
        names = [c.split()[0] for c in BAND.split(", ")]
        for rows in batches:
            for name, content in zip(rows.name, rows.content):
                image, geo = codecs.read(bytes(content))
                for k in wanted or range(1, len(image) + 1):
                    if 1 <= k <= len(image):
                        yield pd.DataFrame([(name, k, *image[k - 1].shape, *(geo or (None,) * 4), str(image.dtype), image[k - 1].tobytes())], columns=names)

    return images.select("name", "content").mapInPandas(step, BAND)


def pixels(decoded: DataFrame) -> DataFrame:
    """(name, band, y, x, v): the pixels of ``bands`` that are not zero."""

    def step(batches):
        for rows in batches:
            for r in rows.itertuples():
                image = np.frombuffer(r.pixels, r.type).reshape(r.height, r.width)
                y, x = np.nonzero(image)
                yield pd.DataFrame({"name": r.name, "band": r.band, "y": y, "x": x, "v": image[y, x].astype(float)})

    return decoded.mapInPandas(step, "name string, band int, y int, x int, v double")
