"""Masks as row runs, and everything that is measured on them.

A mask is rows (image_id, y, x0, x1): the runs of foreground pixels. Box, area, moments, halves and bands are closed forms
over runs, summed by Spark; pixels are never exploded for them. Only component labelling looks at a whole image at once,
which is bounded by the camera's frame, not by the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import connected

REGIONS = "image_id long, label int, y int, x0 int, x1 int"


def runs_of_pixels(pixels: DataFrame) -> DataFrame:
    """Runs of foreground pixels (image_id, y, x)."""
    island = F.col("x") - F.row_number().over(W.partitionBy("image_id", "y").orderBy("x"))
    return pixels.withColumn("island", island).groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def runs_of_rows(rows: DataFrame, values: str, threshold: float) -> DataFrame:
    """Runs of values over a threshold in arrays, one array a row of the picture (image_id, y, values). No shuffle."""
    on = F.transform(F.col(values), lambda v: v.cast("double") > threshold)
    n = F.size("on")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("on", i) & ~F.coalesce(F.get("on", i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("on", i) & ~F.coalesce(F.get("on", i + 1), F.lit(False)))
    made = rows.withColumn("on", on).where("size(on) > 0").select("image_id", "y", F.explode(F.arrays_zip(starts.alias("x0"), ends.alias("x1"))).alias("r"))
    return made.select("image_id", "y", "r.x0", "r.x1")


def label(runs: DataFrame) -> DataFrame:
    """Runs with the label of their 8-connected region; labels count from 1 in the order of regions' first pixels."""

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x0"], ignore_index=True)
        root = connected(*(part[c].to_numpy() for c in ("y", "x0", "x1")))
        part["label"] = np.unique(root, return_inverse=True)[1] + 1  # a region's first run is the least
        return part[["image_id", "label", "y", "x0", "x1"]]

    return runs.groupBy("image_id").applyInPandas(of, REGIONS)


def _pyramid(k: Column) -> Column:
    """0 + 1 + 4 + ... + k * k"""
    return k * (k + 1) * (2 * k + 1) / 6


def regions(labelled: DataFrame, keys: tuple[str, ...] = ("image_id", "label")) -> DataFrame:
    """Box, area and integer moment sums of each region."""
    n, y = (F.col("x1") - F.col("x0") + 1).cast("long"), F.col("y").cast("long")
    sx = ((F.col("x0") + F.col("x1")).cast("long") * n / 2).cast("long")
    sxx = (_pyramid(F.col("x1").cast("long")) - _pyramid(F.col("x0").cast("long") - 1)).cast("long")
    return labelled.groupBy(*keys).agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(n).alias("area"),
        F.sum(sx).alias("sx"), F.sum(y * n).alias("sy"), F.sum(sxx).alias("sxx"), F.sum(y * y * n).alias("syy"), F.sum(sx * y).alias("sxy"),
    )


def angle() -> Column:
    """Degrees of the long axis from the row axis, from exact integer moments, so that symmetric regions don't depend on noise."""
    big = lambda a, b: F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")
    m11 = (big("area", "sxy") - big("sx", "sy")).cast("double")
    m20, m02 = (big("area", "syy") - big("sy", "sy")).cast("double"), (big("area", "sxx") - big("sx", "sx")).cast("double")
    return F.degrees(F.lit(0.5) * F.atan2(2 * m11, m20 - m02))


def halves(labelled: DataFrame, keys: tuple[str, ...] = ("image_id", "label")) -> DataFrame:
    """Foreground left and right of each region's middle column; the middle of an odd width counts as right."""
    box = labelled.groupBy(*keys).agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"))
    middle = F.col("bx0") + F.floor((F.col("bx1") - F.col("bx0") + 1) / 2)
    left = F.greatest(F.lit(0), F.least(F.col("x1") + 1, middle) - F.col("x0"))
    return labelled.join(box, list(keys)).groupBy(*keys).agg(F.sum(left).alias("left_px"), F.sum(F.col("x1") - F.col("x0") + 1 - left).alias("right_px"))


def side() -> Column:
    return F.when(F.col("right_px") > F.col("left_px"), "right").when(F.col("left_px") > F.col("right_px"), "left").otherwise("none")


def bands(runs: DataFrame, height: Column | int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Foreground in the top and the bottom tenth of a picture of `height` rows."""
    h = F.lit(height) if isinstance(height, int) else height
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    return runs.groupBy(*keys).agg(
        F.sum(F.when(F.col("y") < F.floor(h / 10), n).otherwise(0)).alias("top_px"),
        F.sum(F.when(F.col("y") >= h - F.ceil(h / 10), n).otherwise(0)).alias("bottom_px"),
    )


def turned(pixels: DataFrame, quarter: int, h: int, w: int) -> DataFrame:
    """Pixels (image_id, y, x) turned a quarter: +1 against the clock, -1 with it."""
    if quarter == 1:
        return pixels.select("image_id", (F.lit(w - 1) - F.col("x")).alias("y"), F.col("y").alias("x"))
    return pixels.select("image_id", F.col("x").alias("y"), (F.lit(h - 1) - F.col("y")).alias("x"))


def flipped(pixels: DataFrame, h: int) -> DataFrame:
    return pixels.select("image_id", (F.lit(h - 1) - F.col("y")).alias("y"), "x")


def cropped(runs: DataFrame, y0: Column, y1: Column, x0: Column, x1: Column, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Runs clipped to the half-open box and moved to its origin."""
    a, b = F.greatest(F.col("x0"), x0), F.least(F.col("x1"), x1 - 1)
    return runs.where((F.col("y") >= y0) & (F.col("y") < y1) & (a <= b)).select(*keys, (F.col("y") - y0).alias("y"), (a - x0).alias("x0"), (b - x0).alias("x1"))


def under_mask(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, ..) with `inside`: whether a run of the mask holds them. Runs of a row don't meet, so none is matched twice."""
    own = runs.select("image_id", "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    joined = pixels.join(own, (pixels["image_id"] == own["image_id"]) & (pixels["y"] == own["y"]) & pixels["x"].between(own["_x0"], own["_x1"]), "left")
    return joined.select(*(pixels[c] for c in pixels.columns), own["_x0"].isNotNull().alias("inside"))
