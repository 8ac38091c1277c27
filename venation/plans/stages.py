"""Stages over photographs: decode, ingest, masks, measure, organise; leaves.py cuts them out, run.py goes from folder to files.

Pictures travel as Spark's image struct (height, width, nChannels, data). A stage gives every row a status and a reason, in
place of leaving out what fails. Decoders of raw photographs, segmenters and models of normals are passed in as functions on
one array; the segmenter's default is a threshold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kernels as K
from ..operators import raster as R
from ..operators import relational as L
from ..sources import png
from .workers import with_package

PICTURE = "path string, height int, width int, channels int, data binary"


def as_array(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def _mapped(pictures: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pictures after f, with status and reason. A few rows at a time: a frame is tens of MB."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                try:
                    out = np.ascontiguousarray(f(as_array(row)))
                    got = (row.path, *out.shape, out.tobytes(), "ok", None)
                except ValueError as e:
                    got = (row.path, row.height, row.width, row.channels, None, "error", str(e))
                yield pd.DataFrame([got], columns=["path", "height", "width", "channels", "data", "status", "reason"])

    return with_package(pictures).mapInPandas(of, PICTURE + ", status string, reason string")


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray] = png.decode) -> DataFrame:
    """Pictures of files (path, content). One that can't be decoded has the status 'error', a reason and no picture."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    out = np.ascontiguousarray(decode(content))
                    got = (path, *out.shape, out.tobytes(), "ok", None)
                except (ValueError, struct.error, zlib.error) as e:
                    got = (path, None, None, None, None, "error", str(e))
                yield pd.DataFrame([got], columns=["path", "height", "width", "channels", "data", "status", "reason"])

    return with_package(files.select("path", "content")).mapInPandas(of, PICTURE + ", status string, reason string")


def images(spark: SparkSession, path: str, as_grey: bool = False) -> DataFrame:
    """Pictures below a path by Spark's own image source, which reads JPEG, PNG, GIF and BMP: red, green, blue (and alpha), or grey. What it can't read has a status and a reason."""
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(path).select("image.*")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                if row.height < 0:
                    got = (row.origin, None, None, None, None, "error", "not a picture")
                else:
                    out = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                    out = out[..., [2, 1, 0, 3][: row.nChannels]] if row.nChannels > 1 else out  # the source gives blue first
                    out = np.ascontiguousarray(png.grey(out) if as_grey else out)
                    got = (row.origin, *out.shape, out.tobytes(), "ok", None)
                yield pd.DataFrame([got], columns=["path", "height", "width", "channels", "data", "status", "reason"])

    return with_package(found.select("origin", "height", "width", "nChannels", "data")).mapInPandas(of, PICTURE + ", status string, reason string")


def ingest(pictures: DataFrame, resolution: int = 1920) -> DataFrame:
    """Decoded pictures fitted to the resolution."""
    return _mapped(pictures, lambda a: K.fit(a, resolution))


def foreground(pictures: DataFrame, segment: Callable[[np.ndarray], np.ndarray] = K.threshold_segmenter) -> DataFrame:
    """One-channel masks of 0 and 255."""
    return _mapped(pictures, lambda a: segment(a)[..., None])


def runs_of_masks(masks: DataFrame) -> DataFrame:
    """Row runs (image_id, y, x0, x1) of masks (image_id, height, width, channels, data)."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                on = np.pad(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width) > 128, ((0, 0), (1, 1))).astype(np.int8)
                change = np.diff(on, axis=1)
                (y, x0), (_, x1) = np.nonzero(change == 1), np.nonzero(change == -1)
                yield pd.DataFrame({"image_id": np.full(len(y), row.image_id), "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": (x1 - 1).astype(np.int32)})

    return with_package(masks).mapInPandas(of, "image_id long, y int, x0 int, x1 int")


def measure(runs: DataFrame, photos: DataFrame, min_area: int = 1) -> DataFrame:
    """Leaves with sizes in cm. photos: image_id, w, h and the focal length as printed in the photo."""
    leaves = L.ordinals(R.regions(R.label(runs)), "image_id", "label", F.col("area") >= min_area)
    joined = leaves.join(photos.withColumn("focal", C.focal_length(F.col("printed"))), "image_id")
    a, b = C.pixel_pitch(F.col("w"), F.col("h"))
    pw, ph = C.pixels_per_cm(F.col("focal.mm"), a), C.pixels_per_cm(F.col("focal.mm"), b)
    problem = F.when(~F.col("focal.ok"), "focal length is no number").when(pw.isNull(), "focal length equals the distance")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = joined.withColumn("width_cm", C.rint3(width / pw)).withColumn("height_cm", C.rint3(height / ph)).withColumn("area_cm2", C.rint3(F.col("area") / (pw * ph)))
    return L.statuses(sized, problem).select("image_id", "ordinal", width.alias("width_px"), height.alias("height_px"), "area", "width_cm", "height_cm", "area_cm2", "status", "reason")


def summary(leaves: DataFrame) -> DataFrame:
    """One JSON a picture, nulls kept."""
    leaf = F.struct("width_cm", "height_cm", "area_cm2")
    entry = F.struct(F.concat(F.lit("leaf_"), "ordinal").alias("key"), leaf.alias("value"))
    by = leaves.groupBy("image_id").agg(F.count("*").alias("leaf_count"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("leaves"))
    return by.select("image_id", F.to_json(F.struct("leaf_count", "leaves"), {"ignoreNullFields": "false"}).alias("json"))


def square(pictures: DataFrame, size: int = 1024, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Decoded pictures fitted and centred on squares of one colour."""
    return _mapped(pictures, lambda a: K.letterbox(K.three_channels(a), size, size, background))


def fitted(pictures: DataFrame, height: int, width: int) -> DataFrame:
    """Decoded pictures fitted into height x width, black beside."""
    return _mapped(pictures, lambda a: K.letterbox(K.three_channels(a), height, width, (0, 0, 0)))


def in_raw_folder(files: DataFrame) -> DataFrame:
    """New path of raw files that lie loose in their object's folder: below `raw`. Others keep theirs."""
    loose = F.col("folder").isNull()
    return files.where("role = 'raw'").withColumn("new_path", F.when(loose, F.regexp_replace("path", r"/([^/]*)$", "/raw/$1")).otherwise(F.col("path")))


def organise(files: DataFrame) -> DataFrame:
    """New path of each texture (object_name, leaf, role, path): below its leaf's processed folder."""
    name = F.format_string("%s_%s.png", F.col("leaf"), F.col("role"))
    return files.where(F.col("role").isin("mask", "diffuse", "normal")).withColumn("new_path", F.concat_ws("/", "object_name", "leaf", F.lit("processed"), name))


def contours_of(pictures: DataFrame, level: float) -> DataFrame:
    """(image_id, idx, n_points, area, perimeter) of the simplified outlines in pictures (image_id, rows of y and values)."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for image, rows in zip(part["image_id"], part["rows"]):
                grid = np.array([r["embedding"] for r in rows], np.float64)
                for i, ring in enumerate(K.contours(np.where(grid > level, 255, 0))):
                    kept = K.simplified(ring, 0.002 * K.perimeter(ring))
                    out.append((image, i, len(kept), K.polygon_area(kept), round(K.perimeter(kept), 9)))
            yield pd.DataFrame(out, columns=["image_id", "idx", "n_points", "area", "perimeter"])

    return with_package(pictures).mapInPandas(of, "image_id long, idx int, n_points int, area double, perimeter double")


def encoded(pictures: DataFrame) -> DataFrame:
    """(path, png) of pictures of 1, 3 or 4 channels."""
    to_png = F.udf(lambda h, w, c, data: png.encode(np.frombuffer(data, np.uint8).reshape(h, w, c)), "binary", useArrow=True)
    return with_package(pictures).select("path", to_png("height", "width", "channels", "data").alias("png"))
