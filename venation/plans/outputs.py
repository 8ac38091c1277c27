"""What is written: pictures as files, a JSON for each object, one for the data set, and sizes at a fixed scale.

Files are written by the executors through Arrow's file systems, under a name of their own first and then moved, so that a
task that is run twice, or a lost executor, leaves whole files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as L
from .workers import settled, with_package


def camera(w, h, focal):
    """Struct of a photo's camera, keys in order; rounded as it is written."""
    a, b = C.pixel_pitch(w, h)
    return F.struct(
        F.lit(C.DISTANCE_MM).alias("distance_mm"), focal.alias("focal_length_mm"), h.alias("image_height"), w.alias("image_width"), C.orientation(w, h).alias("orientation"),
        F.bround(b, 6).alias("pixel_size_h_mm"), F.bround(a, 6).alias("pixel_size_w_mm"), F.bround(C.pixels_per_cm(focal, a), 2).alias("pixels_per_cm_horizontal"), F.bround(C.pixels_per_cm(focal, b), 2).alias("pixels_per_cm_vertical"),
        F.lit(C.SENSOR_H_MM).alias("sensor_height_mm"), F.lit(C.SENSOR_W_MM).alias("sensor_width_mm"),
    )


def sized(leaves: DataFrame, photos: DataFrame) -> DataFrame:
    """Leaves (image_id, ordinal, box, area) with sizes in cm by their photo: image_id, object_name, w, h, printed focal length."""
    joined = leaves.join(photos.withColumn("focal", C.focal_length(F.col("printed"))), "image_id")
    a, b = C.pixel_pitch(F.col("w"), F.col("h"))
    pw, ph = C.pixels_per_cm(F.col("focal.mm"), a), C.pixels_per_cm(F.col("focal.mm"), b)
    problem = F.when(~F.col("focal.ok"), "focal length is no number").when(pw.isNull(), "focal length equals the distance")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = joined.withColumns({"width_px": width, "height_px": height, "width_cm": C.rint3(width / pw), "height_cm": C.rint3(height / ph), "area_cm2": C.rint3(F.col("area") / (pw * ph))})
    return L.statuses(out, problem)


def object_json(leaves: DataFrame, photos: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(object_name, leaf_count, json) of leaves by sized(). listed: (object_name, leaf) folders that exist; leaves without one count but aren't listed."""
    name = F.concat(F.lit("leaf_"), "ordinal")
    record = F.struct(
        F.struct("area_cm2", "height_cm", "width_cm").alias("dimensions"), name.alias("leaf_id"), F.col("object_name").alias("object_name"),
        F.struct(F.col("area").alias("area_pixels"), F.col("height_px").alias("height_pixels"), F.col("width_px").alias("width_pixels")).alias("pixels"),
        F.struct(
            F.lit(True).alias("measured_at_full_resolution"), F.lit("focal_length_distance_based").alias("measurement_method"), F.array("w", "h").alias("original_image_size"), F.lit("full_resolution_raw").alias("source"),
            F.array(F.lit("cropping"), F.lit("orientation_alignment")).alias("transformations_applied"),
        ).alias("processing_info"),
    )
    rows = leaves.where("status = 'ok'").select("object_name", "ordinal", name.alias("leaf"), record.alias("record"))
    rows = rows.withColumn("there", F.lit(True)) if listed is None else rows.join(listed.select("object_name", "leaf", F.lit(True).alias("there")).distinct(), ["object_name", "leaf"], "left")
    entry = F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("ordinal", "leaf", "record"))))
    by = rows.groupBy("object_name").agg(F.count("*").alias("leaf_count"), F.map_from_entries(F.transform(entry, lambda e: F.struct(e["leaf"], e["record"]))).alias("leaves"))
    focal = C.focal_length(F.col("printed"))["mm"]
    cameras = photos.groupBy("object_name").agg(F.min_by(camera(F.col("w"), F.col("h"), focal), "image_id").alias("camera_parameters"))
    joined = by.join(cameras, "object_name")
    return joined.select("object_name", "leaf_count", F.to_json(F.struct("camera_parameters", "leaf_count", "leaves", "object_name"), {"ignoreNullFields": "false"}).alias("json"))


def summary_json(objects: DataFrame, records: DataFrame, base: str, when: str | None = None) -> DataFrame:
    """One row, json: all folders (object_name) count as objects; those with records (object_name, leaf_count, json) are listed. when: the date, now if None."""
    total = objects.agg(F.count("*").alias("total_objects"))
    part = F.concat(F.regexp_replace(F.to_json(F.array("object_name")), r"^\[|\]$", ""), F.lit(":"), F.col("json"))
    listed = records.agg(F.coalesce(F.sum("leaf_count"), F.lit(0)).alias("total_leaves"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("object_name", part.alias("part")))), lambda e: e["part"]), ",").alias("objects"))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS") if when is None else F.lit(when)
    info = F.to_json(F.struct(F.lit(base).alias("base_folder"), date.alias("processing_date"), "total_leaves", "total_objects"))
    return total.join(listed, how="cross").select(F.concat(F.lit('{"dataset_info":'), info, F.lit(',"objects":{'), "objects", F.lit("}}")).alias("json"))  # a row each


def scales_json(leaves: DataFrame, group: str) -> DataFrame:
    """(group, json): height and width of every leaf (leaf, height_px, width_px) at the fixed scale."""
    entry = F.struct("leaf", F.struct(C.fixed_cm(F.col("height_px")).alias("height_cm"), C.fixed_cm(F.col("width_px")).alias("width_cm")).alias("size"))
    return leaves.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("m")).select(group, F.to_json("m").alias("json"))


def write_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Writes each row's content (binary or text) to its path: (path, bytes) of what was written. Folders are made; files that are there are replaced whole."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part["path"], part["data"]):
                data = data.encode() if isinstance(data, str) else bytes(data)
                system, place = _system(path)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                own = f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(own) as out:
                    out.write(data)
                system.move(own, place)
                yield pd.DataFrame({"path": [path], "bytes": [len(data)]})

    return with_package(files).select("path", F.col(content).alias("data")).mapInPandas(of, "path string, bytes long")


def read_json(spark, root: str, pattern: str = "*_leaves_data.json") -> DataFrame:
    """(object_name, path, json) of every object's records below root: of several the first by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    rows = found.select(F.element_at(F.split("path", "/"), -2).alias("object_name"), "path", F.col("content").cast("string").alias("json"))
    return rows.groupBy("object_name").agg(F.min_by(F.struct("path", "json"), "path").alias("r")).select("object_name", "r.*")


def measured_heights(records: DataFrame) -> DataFrame:
    """(mesh_name, height_cm) of the leaves in objects' records (object_name, json)."""
    shape = "leaves map<string, struct<dimensions: struct<height_cm: double>>>"
    rows = records.select("object_name", F.explode(F.from_json("json", shape)["leaves"]).alias("leaf", "r"))
    return rows.select(F.concat_ws("_", "object_name", "leaf").alias("mesh_name"), F.col("r.dimensions.height_cm").alias("height_cm"))


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def move_files(files: DataFrame) -> DataFrame:
    """Moves each row's path to its new_path, in place of what is there: (path, new_path). A file that is there already from an earlier try counts as moved."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            for path, new_path in zip(part["path"], part["new_path"]):
                (system, old), (_, new) = _system(path), _system(new_path)
                if system.get_file_info(old).type == fs.FileType.File:
                    system.create_dir(new.rsplit("/", 1)[0], recursive=True)
                    system.move(old, new)
                yield pd.DataFrame({"path": [path], "new_path": [new_path]})

    return with_package(settled(files.select("path", "new_path"))).mapInPandas(of, "path string, new_path string")


def delete_folders(folders: DataFrame) -> DataFrame:
    """Deletes folders (path) with all that is in them: path of each; ones that aren't there are passed over."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            for path in part["path"]:
                system, place = _system(path)
                if system.get_file_info(place).type == fs.FileType.Directory:
                    system.delete_dir(place)
            yield part[["path"]]

    return with_package(folders).select("path").mapInPandas(of, "path string")
