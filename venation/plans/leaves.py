"""Leaves as pictures: found in the diffuse photo, cut from every photo of their object, turned upright, and their normals.

Pictures are rows (object_name, name, height, width, channels, data). A photo meets the leaves of its object by one join, with
the leaves as an array that the photo's frame bounds; no task holds more than one photo, but for normals, which take the few
pictures of one leaf's folder. What can't be done has a status and a reason.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kernels as K
from ..operators import relational as L
from .models import flat_normals
from .stages import as_array
from .workers import with_package

LEAF = "struct<ordinal: int, y0: int, y1: int, x0: int, x1: int, mask: binary>"
OUT = "object_name string, leaf string, name string, height int, width int, channels int, data binary, status string, reason string"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _row(object_name, leaf, name, image: np.ndarray | None, status: str = "ok", reason: str | None = None) -> tuple:
    if image is None:
        return (object_name, leaf, name, None, None, None, None, status, reason)
    image = np.ascontiguousarray(image if image.ndim == 3 else image[..., None])
    return (object_name, leaf, name, *image.shape, image.tobytes(), status, reason)


def diffuse_of(pictures: DataFrame) -> DataFrame:
    """Of each object the diffuse picture, of several the first by name."""
    rows = pictures.where(F.col("name").endswith("_diffuse.png"))
    return rows.groupBy("object_name").agg(F.min_by(F.struct(*rows.columns), "name").alias("r")).select("r.*")


def regions(diffuse: DataFrame, segment: Callable = K.threshold_segmenter, min_sum: int = 100) -> DataFrame:
    """(object_name, height, width, leaves, status, reason): the leaves of each diffuse picture, numbered from 1 in the order of their first pixels.

    Regions whose mask of 0 and 255 sums to less than min_sum are no leaves (at 100 every pixel is one). Masks are compressed.
    """

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                on = np.pad(segment(as_array(row)) > 128, ((0, 0), (1, 1))).astype(np.int8)
                change = np.diff(on, axis=1)
                (y, x0), (_, x1) = np.nonzero(change == 1), np.nonzero(change == -1)
                root, found = K.connected(y, x0, x1 - 1), []
                for first in np.flatnonzero(root == np.arange(len(root))):
                    mine = np.flatnonzero(root == first)
                    top, bottom, left, right = int(y[mine].min()), int(y[mine].max()) + 1, int(x0[mine].min()), int(x1[mine].max())
                    mask = np.zeros((bottom - top, right - left), np.uint8)
                    for i in mine:
                        mask[y[i] - top, x0[i] - left : x1[i] - left] = 255
                    if mask.sum(dtype=np.int64) >= min_sum:
                        found.append((len(found) + 1, top, bottom, left, right, zlib.compress(mask.tobytes())))
                yield pd.DataFrame([(row.object_name, row.height, row.width, found, *(("ok", None) if found else ("skipped", "no foreground")))], columns=["object_name", "height", "width", "leaves", "status", "reason"])

    return with_package(diffuse.select("object_name", "height", "width", "channels", "data")).mapInPandas(of, f"object_name string, height int, width int, leaves array<{LEAF}>, status string, reason string")


def _mask(leaf) -> np.ndarray:
    return np.frombuffer(zlib.decompress(leaf["mask"]), np.uint8).reshape(leaf["y1"] - leaf["y0"], leaf["x1"] - leaf["x0"])


def extracted(pictures: DataFrame, found: DataFrame) -> DataFrame:
    """Every leaf cut from every picture of its object, upright: `leaf_N_diffuse.png`, `leaf_N_mask.png` and `leaf_N_<stem>.png`.

    The diffuse picture gets the mask as alpha; others are white outside it, but for those with an alpha of their own. A picture
    of another size is brought to the diffuse one's first. Photos of all leaves together are left out; objects without leaves
    have a row that says so.
    """
    chosen = diffuse_of(pictures).select("object_name", F.col("name").alias("chosen"))
    own = found.where("status = 'ok'").select("object_name", "leaves", F.col("height").alias("to_h"), F.col("width").alias("to_w"))
    rows = pictures.where(C.is_part_photo(F.col("name"))).join(own, "object_name").join(chosen, "object_name")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                image, diffuse = as_array(row), row.name == row.chosen
                if image.shape[:2] != (row.to_h, row.to_w):
                    image = K.lanczos(image, row.to_h, row.to_w)
                if image.shape[2] != 4:
                    image = K.three_channels(image)
                for leaf in row.leaves:
                    mask, number = _mask(leaf), f"leaf_{leaf['ordinal']}"
                    crop = image[leaf["y0"] : leaf["y1"], leaf["x0"] : leaf["x1"]]
                    turned, crop = K.upright(mask, K.cut_out(crop, mask) if diffuse else crop)
                    if diffuse:
                        got = [_row(row.object_name, number, f"{number}_diffuse.png", crop), _row(row.object_name, number, f"{number}_mask.png", turned)]
                    else:
                        got = [_row(row.object_name, number, f"{number}_{row.name.rsplit('.', 1)[0]}.png", K.whitened(crop, turned))]
                    yield pd.DataFrame(got, columns=COLUMNS)

    done = with_package(rows.select("object_name", "name", "height", "width", "channels", "data", "to_h", "to_w", "leaves", "chosen")).mapInPandas(of, OUT)
    empty = found.where("status <> 'ok'").select("object_name", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OUT.split(", ")[1:7]), "status", "reason")
    return done.unionByName(empty)


def normal_maps(pictures: DataFrame, model: Callable = flat_normals, most: int = 512) -> DataFrame:
    """`leaf_N_normal.png` of each leaf (object_name, leaf, name, picture) with three companions or more and no normals yet.

    Companions and mask are capped at most x most, cropped to the mask's box (its last row and column not in it), brought into
    the square that a network of stages takes, and divided by their mean over the mask. What the model gives is made unit
    length, put back in its place, resized and clipped. Others have a row with the reason.
    """
    keys = ["object_name", "leaf"]
    pictures = pictures.where("data is not null")
    some = L.at_least(pictures.where(C.is_counted_companion(F.col("name"))).withColumn("k", F.struct(*keys)), "k", 3).select("k.*", F.lit(True).alias("enough"))
    done = pictures.where(F.col("name") == F.concat("leaf", F.lit("_normal.png"))).select(*keys).distinct()
    todo = pictures.join(done, keys, "left_anti")
    few = todo.select(*keys).distinct().join(some, keys, "left_anti")

    def of(part: pd.DataFrame) -> pd.DataFrame:
        name, leaf = part["object_name"].iloc[0], part["leaf"].iloc[0]
        out = lambda image, *why: pd.DataFrame([_row(name, leaf, f"{leaf}_normal.png", image, *why)], columns=COLUMNS)
        files = {row.name: as_array(row) for row in part.sort_values("name").itertuples()}
        loaded = [K.three_channels(files[n]) for n in part.sort_values("name").loc[lambda p: p["loaded"], "name"]]
        if len(loaded) < 3:
            return out(None, "skipped", "fewer than three companions")
        mask = next((x[..., 0] for n, x in files.items() if n.endswith("_mask.png")), np.full(loaded[0].shape[:2], 255, np.uint8))
        shape = mask.shape
        mask = K.capped(mask[..., None], most)[..., 0]
        box = K.mask_box(mask)
        if box is None or box[0] == box[1] or box[2] == box[3]:
            return out(None, "skipped", "no foreground")
        y0, y1, x0, x1 = box
        size = K.stage_size(y1 - y0, x1 - x0)
        own, padding = K.padded(mask[y0:y1, x0:x1, None], size)
        images = np.array([K.padded(K.capped(i, most)[y0:y1, x0:x1], size)[0] for i in loaded], np.float32)
        normals = K.depadded(model(K.normalised(images, own[..., 0] > 0), own[..., 0] > 0), padding)
        frame = np.zeros((*mask.shape, 3))
        frame[y0:y1, x0:x1] = K.linear(normals / np.maximum(np.linalg.norm(normals, axis=-1, keepdims=True), 1e-12), y1 - y0, x1 - x0)
        whole = np.clip(K.linear(frame, *shape), -1, 1)
        return out(((whole + 1) / 2 * 255).astype(np.uint8))

    rows = with_package(todo.join(some, keys)).select(*keys, "name", "height", "width", "channels", "data", C.is_loaded_companion(F.col("name")).alias("loaded"))
    made = rows.groupBy(*keys).applyInPandas(of, OUT)  # a leaf's folder: a few pictures
    none = few.select(*keys, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OUT.split(", ")[2:7]), F.lit("skipped").alias("status"), F.lit("fewer than three companions").alias("reason"))
    return made.unionByName(none)


def _each(pictures: DataFrame, f: Callable) -> DataFrame:
    """Rows of OUT that f(row, picture) gives for each picture."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                yield pd.DataFrame([_row(row.object_name, None, *x) for x in f(row, as_array(row))], columns=COLUMNS)

    return with_package(pictures.select("object_name", "name", "height", "width", "channels", "data")).mapInPandas(of, OUT)


def foreground_crops(pictures: DataFrame, segment: Callable = K.threshold_segmenter, size: int = 1024) -> DataFrame:
    """`<stem>_resized.png` and `<stem>_mask.png` of each picture's foreground in squares; a picture without any has a row that says so."""

    def of(row, image):
        stem = row.name.rsplit(".", 1)[0]
        got = K.foreground_crop(K.three_channels(image), segment(image), size)
        return [(f"{stem}_resized.png", None, "skipped", "no foreground")] if got is None else [(f"{stem}_resized.png", got[0]), (f"{stem}_mask.png", got[1])]

    return _each(pictures, of)


def mattes(pictures: DataFrame, segment: Callable = K.threshold_segmenter, size: int = 1024, keep_original: bool = False) -> DataFrame:
    """Each picture's foreground in a square, premultiplied, by its own alpha if that says anything; keep_original: alpha only."""
    return _each(pictures, lambda row, image: [(row.name, K.matte(image if image.shape[2] == 4 else K.three_channels(image), segment(image), size, keep_original))])


def binary_masks(pictures: DataFrame) -> DataFrame:
    """White where a picture's alpha is more than none."""
    return _each(pictures, lambda row, image: [(row.name, np.where(image[..., -1] > 0, 255, 0).astype(np.uint8))])


def without_background(pictures: DataFrame, segment: Callable = K.threshold_segmenter) -> DataFrame:
    """Each whole picture with its mask as alpha, and the mask: `all_leaves_no_bg.png`, `all_leaves_mask.png`."""

    def of(row, image):
        mask = segment(image)
        return [("all_leaves_no_bg.png", K.cut_out(K.three_channels(image), mask)), ("all_leaves_mask.png", mask)]

    return _each(pictures, of)


def on_canvases(diffuse: DataFrame, found: DataFrame, normals: DataFrame | None = None, size: int = 1024, min_area: int = 100) -> DataFrame:
    """Leaves of each diffuse picture on canvases of one size and one scale: `leaf_N_diffuse.png`, `_mask.png`, and `_normal.png` where normals (object_name, picture) has the object's.

    The scale is that of the longest box side among leaves of min_area pixels or more; without any, there is a row that says so.
    """
    extra = "normal_height int, normal_width int, normal_data binary".split(", ")
    rows = diffuse.join(found.where("status = 'ok'").select("object_name", "leaves"), "object_name")
    if normals is None:
        rows = rows.select("*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in extra))
    else:
        own = normals.select("object_name", *(F.col(c).alias(f"normal_{c}") for c in ("height", "width", "data")))
        rows = rows.join(own, "object_name", "left")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                image, masks = K.three_channels(as_array(row)), [_mask(x) for x in row.leaves]
                longest = max((max(m.shape) for m in masks if (m > 0).sum() >= min_area), default=0)
                if not longest:
                    yield pd.DataFrame([_row(row.object_name, None, None, None, "skipped", "no leaf is large enough for a scale")], columns=COLUMNS)
                    continue
                whole = None
                if row.normal_data is not None:
                    whole = np.frombuffer(row.normal_data, np.uint8).reshape(int(row.normal_height), int(row.normal_width), 3)
                    whole = whole if whole.shape[:2] == image.shape[:2] else K.lanczos(whole, *image.shape[:2])
                for leaf, mask in zip(row.leaves, masks):
                    number, box = f"leaf_{leaf['ordinal']}", (slice(leaf["y0"], leaf["y1"]), slice(leaf["x0"], leaf["x1"]))
                    turned, crop, *normal = K.upright(mask, K.cut_out(image[box], mask), *([whole[box]] if whole is not None else []))
                    canvas, own = K.on_canvas(crop, turned, longest, size)
                    got = [("diffuse", canvas), ("mask", own)] + [("normal", K.normals_on_canvas(n, turned, longest, size)) for n in normal]
                    yield pd.DataFrame([_row(row.object_name, number, f"{number}_{role}.png", x) for role, x in got], columns=COLUMNS)

    return with_package(rows.select("object_name", "height", "width", "channels", "data", "leaves", "normal_height", "normal_width", "normal_data")).mapInPandas(of, OUT)


def upright_sizes(found: DataFrame) -> DataFrame:
    """(object_name, ordinal, leaf, height_px, width_px, full_height, full_width, area) of every leaf after it is turned: first to last pixel, whole picture, and pixels."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                out = []
                for leaf in row.leaves:
                    (turned,) = K.upright(_mask(leaf))
                    box = K.mask_box(np.where(turned > 128, 255, 0))
                    if box is not None:
                        out.append((row.object_name, leaf["ordinal"], f"leaf_{leaf['ordinal']}", box[1] - box[0], box[3] - box[2], *turned.shape, int((turned > 128).sum())))
                yield pd.DataFrame(out, columns=["object_name", "ordinal", "leaf", "height_px", "width_px", "full_height", "full_width", "area"])

    return with_package(found.where("status = 'ok'").select("object_name", "leaves")).mapInPandas(of, "object_name string, ordinal int, leaf string, height_px int, width_px int, full_height int, full_width int, area long")
