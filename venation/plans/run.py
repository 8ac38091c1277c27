"""From a folder of objects to leaves, normals, sizes and meshes: every step reads what the one before wrote, and skips what is there.

Decoders, the segmenter and the model of normals are passed in (see models.py). Steps write files and give a table of what they
did; a step can be run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import relational as L
from ..sources import catalog, png
from . import leaves, meshes, outputs, scene, stages
from .models import RAW_OPTIONS, flat_normals
from .workers import settled, with_package


def _root(base: str) -> str:
    return base.rstrip("/")


def _pngs(pictures: DataFrame) -> DataFrame:
    to_png = F.udf(lambda h, w, c, data: png.encode(np.frombuffer(data, np.uint8).reshape(h, w, c)), "binary", useArrow=True)
    return with_package(pictures).withColumn("content", to_png("height", "width", "channels", "data"))


def _decoded(found: DataFrame, decode: Callable) -> DataFrame:
    """Pictures of files, with the files' names."""
    done = stages.decoded(found, decode).where("status = 'ok'").drop("status", "reason")
    return done.join(found.select("path", "object_name", "leaf", "name", "stem"), "path")


class Steps:
    """The steps over one base folder."""

    def __init__(self, spark: SparkSession, base: str, decode_raw: Callable, segment: Callable = K.threshold_segmenter, model: Callable = flat_normals, decode: Callable = png.decode):
        self.spark, self.base, self.decode_raw, self.segment, self.model, self.decode = spark, _root(base), decode_raw, segment, model, decode

    def objects(self) -> DataFrame:
        return catalog.folders(self.spark, self.base)

    def files(self, pattern: str = catalog.PICTURES, content: bool = False) -> DataFrame:
        return catalog.files(self.spark, self.base, pattern, content)

    def collect_raw(self) -> DataFrame:
        """Loose raw files are moved below `raw`: (path, new_path)."""
        loose = stages.in_raw_folder(self.files(catalog.RAW)).where("path <> new_path")
        return outputs.move_files(loose)

    def compress(self, resolution: int = 1920) -> DataFrame:
        """Raw files as PNGs below `compressed`, of objects that have fewer PNGs there than raw files: (path, bytes)."""
        raw = self.files(catalog.RAW, content=True).where("folder = 'raw'")
        made = self.files("*.png").where("folder = 'compressed'")
        todo = L.not_done_by_count(raw.select("object_name"), made.select("object_name"), "object_name").where("not skipped").select("object_name")
        decode, options = self.decode_raw, RAW_OPTIONS["camera"]
        pictures = stages.decoded(raw.join(todo, "object_name"), lambda data: decode(data, **options)).where("status = 'ok'").drop("status", "reason")
        small = stages.ingest(pictures, resolution).where("status = 'ok'").drop("status", "reason")
        path = F.regexp_replace("path", r"/raw/([^/]*?)\.[^./]*$", "/compressed/$1.png")
        return outputs.write_files(_pngs(small).withColumn("path", path))

    def found(self) -> DataFrame:
        """The leaves in each object's diffuse picture."""
        return leaves.regions(leaves.diffuse_of(self.compressed()), self.segment)

    def compressed(self) -> DataFrame:
        return _decoded(self.files(content=True).where("folder = 'compressed'"), self.decode).select("object_name", "name", "height", "width", "channels", "data")

    def extract(self) -> DataFrame:
        """Leaves cut from every picture, below `compressed/leaf_N`: (path, bytes)."""
        cut = leaves.extracted(self.compressed(), self.found()).where("status = 'ok'")
        path = F.concat_ws("/", F.lit(self.base), "object_name", F.lit("compressed"), "leaf", "name")
        return outputs.write_files(_pngs(cut).withColumn("path", path))

    def normals(self) -> DataFrame:
        """Normals of each leaf in its folder: (path, bytes)."""
        own = _decoded(self.files(content=True).where("leaf is not null and folder = leaf"), self.decode)
        made = leaves.normal_maps(own.select("object_name", "leaf", "name", "height", "width", "channels", "data"), self.model).where("status = 'ok'")
        path = F.concat_ws("/", F.lit(self.base), "object_name", F.lit("compressed"), "leaf", "name")
        return outputs.write_files(_pngs(made).withColumn("path", path))

    def organise(self) -> DataFrame:
        """Leaf folders go to the object's own folder, in place of what is there, their textures below `processed`: (path, new_path)."""
        own = self.files().where("leaf is not null and folder = leaf and path like '%/compressed/%'")
        plain = own.where(~F.col("role").isin("mask", "diffuse", "normal")).withColumn("new_path", F.concat_ws("/", F.lit(self.base), "object_name", "leaf", "name"))
        textures = stages.organise(own).withColumn("new_path", F.concat_ws("/", F.lit(self.base), "new_path"))
        moves = settled(plain.select("path", "new_path", "object_name", "leaf").unionByName(textures.select("path", "new_path", "object_name", "leaf")))
        old = moves.select(F.concat_ws("/", F.lit(self.base), "object_name", "leaf").alias("path")).distinct()
        outputs.delete_folders(old).count()
        return outputs.move_files(moves)

    def photos(self) -> DataFrame:
        """Of each object with raw files and a diffuse picture the raw file of its stem, else the first: image_id, object_name, path, printed, content."""
        raw = self.files(catalog.RAW, content=True).where("folder = 'raw'")
        diffuse = self.files("*_diffuse.png").where("folder = 'compressed'").groupBy("object_name").agg(F.replace(F.min("name"), F.lit("_diffuse.png"), F.lit("")).alias("stem"))
        chosen = L.match_with_fallback(diffuse, raw.select("object_name", "stem", "path"), "object_name", "stem", "path").where("chosen is not null")
        rows = chosen.select(F.col("chosen").alias("path")).join(raw.select("object_name", "path", "content"), "path")
        return catalog.focal_lengths(rows).withColumn("image_id", F.xxhash64("object_name"))

    def measure(self, when: str | None = None) -> DataFrame:
        """A JSON for each object and one for all, at full resolution, from the linear development: (path, bytes)."""
        photos, decode, options = self.photos(), self.decode_raw, RAW_OPTIONS["linear"]
        pictures = stages.decoded(photos.select("path", "content"), lambda data: decode(data, **options)).where("status = 'ok'").join(photos.select("path", "object_name", "printed", "image_id"), "path")
        sizes = leaves.upright_sizes(leaves.regions(pictures.select("object_name", "height", "width", "channels", "data"), self.segment))
        cameras = pictures.select("image_id", "object_name", F.col("width").alias("w"), F.col("height").alias("h"), "printed")
        boxed = sizes.join(cameras.select("image_id", "object_name"), "object_name").drop("object_name").withColumns({"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("width_px"), "y1": F.col("height_px")})
        listed = self.files().where("leaf is not null and path not like '%/compressed/%'").select("object_name", "leaf")
        records = outputs.object_json(outputs.sized(boxed.drop("height_px", "width_px"), cameras), cameras, listed)
        each = records.select(F.concat_ws("/", F.lit(self.base), "object_name", F.concat("object_name", F.lit("_leaves_data.json"))).alias("path"), F.col("json").alias("content"))
        done = settled(outputs.write_files(each))  # before the summary is
        kept = outputs.read_json(self.spark, self.base).withColumn("leaf_count", F.from_json("json", "leaf_count long")["leaf_count"])
        whole = outputs.summary_json(self.objects(), kept.select("object_name", "leaf_count", "json"), self.base, when)
        return done.unionByName(outputs.write_files(whole.select(F.lit(f"{self.base}/dataset_summary.json").alias("path"), F.col("json").alias("content"))))

    def scene(self, scale: float = 2.0, use_sizes: bool = False) -> dict[str, DataFrame]:
        """Tables of the scene: meshes, placements, material nodes and links, collections."""
        textures = catalog.textures(self.files()).withColumn("mesh_name", F.concat_ws("_", "object_name", "leaf"))
        content = self.files("*_mask.png", content=True).select(F.col("path"), "content")
        masks = stages.decoded(content.join(textures.select(F.col("mask").alias("path")), "path"), lambda data: png.grey(png.decode(data))).where("status = 'ok'")
        made = meshes.meshes(masks.join(textures.select(F.col("mask").alias("path"), "mesh_name"), "path"), scale)
        boxes = meshes.boxes(made).join(textures.select("mesh_name", "object_name"), "mesh_name")
        sizes = outputs.measured_heights(outputs.read_json(self.spark, self.base)) if use_sizes else None
        nodes, links = scene.materials(textures.select(F.col("mesh_name").alias("leaf"), "diffuse", "normal", "mask"))
        return {"meshes": made, "placements": scene.placed(boxes, sizes, use_sizes=use_sizes), "nodes": nodes, "links": links, "collections": scene.collections(textures)}

    def run(self, resolution: int = 1920, when: str | None = None) -> dict[str, int]:
        """All steps in order: how many files each moved or wrote."""
        steps = [("collect_raw", self.collect_raw), ("compress", lambda: self.compress(resolution)), ("extract", self.extract), ("normals", self.normals), ("organise", self.organise), ("measure", lambda: self.measure(when))]
        return {name: step().count() for name, step in steps}
