"""Sinks: CSV, GeoJSON, graphs, split folders, rasters."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweft.operators.ranking import numbered
from roadweft.sources import codecs, shapes


def csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """CSV with a header; an existing target is kept unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").option("header", True).csv(path)


def geojson(df: DataFrame, path: str, by: str, order: str | None = None) -> None:
    """One FeatureCollection per value of ``by``, in a file of its own below ``path``/by=value, from
    columns properties (a map) and geometry (a struct of type and coordinates); features in the
    order of ``order``. An image's features are few, so one row holds them."""
    feature = F.struct(F.lit("Feature").alias("type"), "properties", "geometry")
    ordered = F.array_sort(F.collect_list(F.struct((F.col(order) if order else F.lit(0)).alias("at"), F.to_json(feature).alias("text"))))
    texts = df.groupBy(by).agg(F.transform(ordered, lambda f: f["text"]).alias("features"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":[\n'), F.array_join("features", ",\n"), F.lit("\n]}"))
    # one row a file, however rows fall on tasks
    texts.select(by, whole.alias("value")).write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", 1).text(path)


def graph(nodes: DataFrame, edges: DataFrame, folder: str, by: str = "image_id", srid: int | None = None) -> None:
    """Nodes and edges as parquet, one partition per image; copies in another projection go below a
    folder of their ``srid``."""
    base = folder if srid is None else f"{folder}_{srid}"
    nodes.write.mode("overwrite").partitionBy(by).parquet(f"{base}/nodes")
    edges.write.mode("overwrite").partitionBy(by).parquet(f"{base}/edges")


#: Lines of a piece of a shapefile; Parquet holds a hundred rows before it looks at their size.
PIECE_LINES = 2048
#: Pieces of a stored file: Spark reads 4096 rows at once, whatever their size.
FILE_PIECES = 96


def shapefiles(df: DataFrame, by: str, piece_lines: int = PIECE_LINES) -> DataFrame:
    """(name, piece, content): a shapefile's three files per value of ``by``, from columns points (x, y),
    attributes (a map of strings) and pos, their order. A file is its pieces in a row, each of
    ``piece_lines`` lines but the last, so no task sees more of an image."""
    lines = numbered(df.select(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("stem"), "pos", "points", "attributes"), "stem", "pos", name="_place").drop("pos")
    first = lines.groupBy("stem").agg(F.min("_place").alias("_first"))
    placed = lines.join(first, "stem").select("stem", (F.col("_place") - F.col("_first")).alias("rank"), "points", "attributes")
    placed = placed.withColumn("piece", F.floor(F.col("rank") / piece_lines))
    at = lambda end, c: getattr(F, f"array_{end}")(F.transform("points", lambda p: p[c]))
    edges = [getattr(F, end)(at(end, c)).alias(f"{end}_{c}") for end in ("min", "max") for c in "xy"]
    sizes = placed.groupBy("stem", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum(56 + 16 * F.size("points")).alias("bytes"), F.min_by(F.map_keys("attributes"), "rank").alias("names"), *edges)
    every = Window.partitionBy("stem")
    before = F.coalesce(F.sum("bytes").over(every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    box = [F.coalesce(getattr(F, e.split("_")[0])(e).over(every), F.lit(0.0)).alias(e) for e in ("min_x", "min_y", "max_x", "max_y")]
    whole = sizes.select(F.col("stem").alias("of_stem"), F.col("piece").alias("of_piece"), before.alias("before"), F.sum("n").over(every).alias("lines"), F.sum("bytes").over(every).alias("bytes"), F.max("piece").over(every).alias("last"), F.min_by("names", "piece").over(every).alias("names"), *box)

    def step(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows, of = rows.sort_by("rank").combine_chunks(), own.to_pylist()[0]
        points, n = rows["points"].chunk(0), rows.num_rows
        flat = points.flatten()
        xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)
        counts = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        shp, shx = shapes.records(xy, counts, of["of_piece"] * piece_lines, 100 + of["before"])
        values = [dict(a) for a in rows["attributes"].to_pylist()]
        dbf = shapes.table_rows([[v[name] for v in values] for name in of["names"]], n)
        if not of["of_piece"]:
            span = [of[e] for e in ("min_x", "min_y", "max_x", "max_y")]
            shp, shx = shapes.header(100 + of["bytes"], span) + shp, shapes.header(100 + 8 * of["lines"], span) + shx
            dbf = shapes.table_head(of["names"], of["lines"]) + dbf
        dbf += b"\x1a" * (of["of_piece"] == of["last"])
        names = [f"{of['of_stem']}.{end}" for end in ("shp", "shx", "dbf")]
        return pa.table({"name": names, "piece": pa.array([of["of_piece"]] * 3, pa.int64()), "content": pa.array([shp, shx, dbf], pa.binary())})

    return placed.groupBy("stem", "piece").cogroup(whole.groupBy("of_stem", "of_piece")).applyInArrow(step, "name string, piece bigint, content binary")


def archive(files: DataFrame, by: str) -> DataFrame:
    """(name, content): a gzipped tar per value of ``by`` of files (by, name, content), in the order of
    names and without times, so that reruns agree. A folder's files meet in one task."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for name, content in sorted(zip(rows["name"], rows.content)):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pd.DataFrame({"name": [f"{rows[by].iloc[0]}.tar.gz"], "content": [gzip.compress(raw.getvalue(), mtime=0)]})

    return files.select(by, "name", "content").groupBy(by).applyInPandas(step, "name string, content binary")


def split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def encoded(pixels: DataFrame, height: int, width: int, count: int, form: str = "tif", geo: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(name, content): 8-bit TIFF or PNG files of pixels (name, band, y, x, v), one image at a time;
    pixels that are missing are 0, of several for one place the largest holds. ``geo`` is a TIFF's
    origin and pixel size (x0, y0, pixel_x, pixel_y)."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((count, height, width), np.uint8)
        np.maximum.at(image, (rows.band.to_numpy() - 1, rows.y.to_numpy(), rows.x.to_numpy()), rows.v.to_numpy().astype(np.uint8))
        content = codecs.write_png(image) if form == "png" else codecs.write_tiff(image, geo=geo)
        return pd.DataFrame({"name": [f"{rows['name'].iloc[0]}.{form}"], "content": [content]})

    return pixels.groupBy("name").applyInPandas(step, "name string, content binary")


def images(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) to files in a folder that all executors share, by its scheme; returns
    (name, bytes) of what was written. A file appears whole or not at all, so a task that runs again
    does no harm."""

    def step(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for rows in batches:
            for name, content in zip(rows["name"], rows.content):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{name}")
            yield pd.DataFrame({"name": rows["name"], "bytes": rows.content.map(len)})

    return files.mapInPandas(step, "name string, bytes bigint")
