"""Folders and files as tables.

Files are listed by Spark (binaryFile, which prunes names at the listing). Folders, empty ones too, need a listing of their
own: a Python data source, read on the executors, a partition for each root.
"""

from __future__ import annotations

import os
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as C
from ..operators import relational as L
from ..plans.workers import with_package

RAW, PICTURES = "*.{NEF,nef}", "*.{png,jpg,jpeg,PNG,JPG,JPEG}"


class _Root(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self):
        return [_Root(r) for r in self.roots]

    def read(self, partition):
        if "://" not in partition.path:
            for entry in sorted(os.scandir(partition.path), key=lambda e: e.name):
                if entry.is_dir():
                    yield entry.name, entry.path
            return
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(partition.path)
        for entry in sorted(system.get_file_info(fs.FileSelector(place)), key=lambda e: e.base_name):
            if entry.type == fs.FileType.Directory:
                yield entry.base_name, f"{partition.path.rstrip('/')}/{entry.base_name}"


class Folders(DataSource):
    """spark.read.format("folders").load(path): the folders in a folder, by name. Several roots are parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "object_name string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))


def folders(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(Folders)
    return spark.read.format("folders").load(root)


def leaf_folders(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The `leaf_` folders in some folders: leaf, path."""
    return folders(spark, ",".join(paths)).where(C.is_leaf_folder(F.col("object_name"))).withColumnRenamed("object_name", "leaf")


def files(spark: SparkSession, root: str, pattern: str, content: bool = False) -> DataFrame:
    """Files below root whose names match: object_name, leaf, folder, name, stem, role, path, length (and content).

    The folders below root say whose a file is: `<object>/<file>`, `<object>/<folder>/<file>`, with `leaf_` folders on the way.
    Roles are by name: diffuse, mask, normal, raw, or companion.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    rest = F.split(F.regexp_replace("path", r"^\w+:/*" + re.escape(base) + "/", ""), "/")
    name = F.element_at(rest, -1)
    role = F.when(name.endswith("_diffuse.png"), "diffuse").when(name.endswith("_mask.png"), "mask").when(name.endswith("_normal.png"), "normal").when(F.lower(name).endswith(".nef"), "raw").otherwise("companion")
    leaf = F.get(F.filter(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), C.is_leaf_folder), 0)
    return found.select(
        F.when(F.size(rest) > 1, rest[0]).alias("object_name"), leaf.alias("leaf"), F.when(F.size(rest) > 2, F.element_at(rest, -2)).alias("folder"),
        name.alias("name"), C.stem(name).alias("stem"), role.alias("role"), "path", "length", *(["content"] if content else []),
    )


def textures(found: DataFrame) -> DataFrame:
    """(object_name, leaf, mask, diffuse, normal): the textures of each leaf that has all three, from its processed folder, else from beside it."""
    rows = found.where(F.col("role").isin("mask", "diffuse", "normal") & F.col("leaf").isNotNull())
    inner = rows.groupBy("object_name", "leaf").agg(F.max(F.col("folder") == "processed").alias("_inner"))
    rows = rows.join(inner, ["object_name", "leaf"]).where((F.col("folder") == "processed") | ~F.col("_inner"))
    key = F.struct("object_name", "leaf")
    return L.with_all_roles(rows.withColumn("k", key), "k", "role", "path", ["mask", "diffuse", "normal"]).select("k.*", "mask", "diffuse", "normal")


def focal_lengths(found: DataFrame) -> DataFrame:
    """Files with content, and `printed`: the focal length that each one's EXIF block names."""
    return with_package(found).withColumn("printed", F.udf(lambda data: focal_length(bytes(data)), "string", useArrow=True)("content"))


def focal_length(data: bytes) -> str | None:
    """The focal length that a TIFF-structured photo prints in its EXIF block: '85', '105/2', or None."""
    if data[:2] not in (b"II", b"MM"):
        return None
    e = "<" if data[:2] == b"II" else ">"

    def entries(at: int) -> dict[int, tuple[int, int, int]]:
        if at + 2 > len(data):
            return {}
        (n,) = struct.unpack_from(e + "H", data, at)
        found = {}
        for i in range(n):
            if at + 14 + 12 * i > len(data):
                break
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
            found[tag] = (kind, count, at + 10 + 12 * i)
        return found

    # The tags of the EXIF block and of the focal length in it.
    top = entries(struct.unpack_from(e + "I", data, 4)[0])
    if 0x8769 not in top:
        return None
    own = entries(struct.unpack_from(e + "I", data, top[0x8769][2])[0])
    if 0x920A not in own:
        return None
    a, b = struct.unpack_from(e + "II", data, struct.unpack_from(e + "I", data, own[0x920A][2])[0])
    return str(a // b) if b and a % b == 0 else f"{a}/{b}"
