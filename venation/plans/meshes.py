"""Meshes of leaves as tables: outline, vertices, triangles and texture places, from masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels as K
from .stages import as_array
from .workers import with_package

VERTEX = "struct<x: double, y: double, z: double, u: double, v: double>"
OUT = f"mesh_name string, outline array<struct<x: int, y: int>>, vertices array<{VERTEX}>, faces array<array<int>>, status string, reason string"


def mesh_of(mask: np.ndarray, scale: float = 2.0, cuts: int = 3, epsilon: float = 0.002):
    """The largest region of a mask as (outline, vertices, triangles): its simplified outline as one face, triangulated, every edge cut. None where there is no face."""
    rings = K.contours(mask)
    if not rings:
        return None
    ring = max(rings, key=K.polygon_area)  # of equal ones the first
    ring = K.simplified(ring, epsilon * K.perimeter(ring))
    if len(ring) < 3 or not K.polygon_area(ring):
        return None
    h, w = mask.shape
    sx, sy = (scale, h / w * scale) if w > h else (w / h * scale, scale)
    index: dict[tuple[float, float], int] = {}
    faces = []
    for triangle in K.triangles(ring):
        for small in K.subdivided(*(ring[i] for i in triangle), cuts):
            faces.append([index.setdefault((round(x, 9), round(y, 9)), len(index)) for x, y in small])
    vertices = [((x / w - 0.5) * sx, (y / h - 0.5) * sy, 0.0, x / w, 1.0 - y / h) for x, y in index]
    return ring, vertices, faces


def meshes(masks: DataFrame, scale: float = 2.0, cuts: int = 3) -> DataFrame:
    """One row a mask (mesh_name, height, width, channels, data): its mesh, or why there is none."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                got = mesh_of(as_array(row)[..., 0], scale, cuts)
                out = (None, None, None, "skipped", "no outline of three vertices") if got is None else (*got, "ok", None)
                yield pd.DataFrame([(row.mesh_name, *out)], columns=["mesh_name", "outline", "vertices", "faces", "status", "reason"])

    return with_package(masks.select("mesh_name", "height", "width", "channels", "data")).mapInPandas(of, OUT)


def boxes(made: DataFrame) -> DataFrame:
    """(mesh_name, corners): the eight corners of each mesh's box."""
    end = lambda f, axis: f(F.transform("vertices", lambda v: v[axis]))
    sides = [(end(F.array_min, a), end(F.array_max, a)) for a in "xyz"]
    corners = [F.struct(*(s[k >> i & 1].alias(a) for i, (a, s) in enumerate(zip("xyz", sides)))) for k in range(8)]
    return made.where("status = 'ok'").select("mesh_name", F.array(*corners).alias("corners"))


def projected(made: DataFrame) -> DataFrame:
    """Meshes whose texture places are those of a projection onto their plane, fitted into the unit square with the aspect kept.

    A flat mesh unwraps to itself; a 3D program's own unwrapping may turn it and leave a margin.
    """
    low = lambda a: F.array_min(F.transform("vertices", lambda v: v[a]))
    high = lambda a: F.array_max(F.transform("vertices", lambda v: v[a]))
    side = F.greatest(high("x") - low("x"), high("y") - low("y"), F.lit(1e-12))
    sized = made.withColumns({"_x": low("x"), "_y": low("y"), "_side": side})
    moved = F.transform("vertices", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), ((v["x"] - F.col("_x")) / F.col("_side")).alias("u"), ((v["y"] - F.col("_y")) / F.col("_side")).alias("v")))
    return sized.withColumn("vertices", moved).drop("_x", "_y", "_side")
