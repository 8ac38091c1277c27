"""Scalar functions as Columns: paths and names, geometry of fitting and cropping, optics, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor of the camera in mm, distance to the subject in mm, focal length where a photo names none.
SENSOR_W_MM, SENSOR_H_MM, DISTANCE_MM, FOCAL_MM = 23.5, 15.6, 280.0, 85.0


# --- paths and names


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last extension; a name that only begins with dots has none."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")


def has_any_suffix(name: Column, suffixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: name.endswith(s))


def contains_any(name: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda s: F.contains(name, s))


def is_counted_companion(name: Column) -> Column:
    """Pictures that count towards the three a leaf needs: by suffix, without the diffuse and mask ones."""
    return has_any_suffix(name, [".png", ".jpg", ".jpeg"]) & ~has_any_suffix(name, ["_diffuse.png", "_mask.png"])


def is_loaded_companion(name: Column) -> Column:
    """Pictures that are loaded: types as substrings of the lower-cased name, and no part that names another role."""
    low = F.lower(name)
    return contains_any(low, [".png", ".jpg", ".jpeg", ".tif"]) & ~contains_any(name, ["_diffuse.png", "_mask.png"]) & ~contains_any(low, ["mask", "normal"])


def parse_asset_name(name: Column) -> Column:
    """Struct of category, subcategory, instance: three parts or more by `_`, else the whole name below `default`."""
    parts = F.split(name, "_")
    long = F.size(parts) >= 3
    return F.struct(
        F.element_at(parts, 1).alias("category"),
        F.when(long, F.try_element_at(parts, F.lit(2))).otherwise("default").alias("subcategory"),
        F.when(long, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "_")).otherwise(name).alias("instance"),
    )


def is_leaf_folder(name: Column) -> Column:
    return name.startswith("leaf_")


def leaf_number(name: Column) -> Column:
    return F.replace(name, F.lit("leaf_"), F.lit(""))


def is_part_photo(name: Column) -> Column:
    """Not the photo of all leaves together."""
    return ~name.endswith("full_photo.png")


# --- alpha


def is_solid(alpha: Column) -> Column:
    """Over 0.8 of full alpha."""
    return alpha > 204


def is_visible(alpha: Column) -> Column:
    return alpha > 0


def has_alpha(channels: Column, least_alpha: Column) -> Column:
    """Whether a picture's alpha says anything: four channels, not all of them opaque."""
    return (channels == 4) & (least_alpha < 255)


# --- geometry


def fit(w: Column, h: Column, t: int) -> tuple[Column, Column]:
    """Size that fits into t x t with the same aspect, larger or smaller; sides are cut to whole pixels in this order of operations."""
    scale = F.least(F.lit(float(t)) / w, F.lit(float(t)) / h)
    return (w * scale).cast("int"), (h * scale).cast("int")


def centred(side: Column, room: Column | int) -> Column:
    """Offset that centres, floored."""
    return F.floor((room - side) / 2).cast("int")


def capped_scale(longest: Column, most: int) -> Column:
    return F.least(F.lit(float(most)) / longest, F.lit(1.0))


def padded_box(y0: Column, y1: Column, x0: Column, x1: Column, h: Column, w: Column, pad: int) -> list[Column]:
    zero = F.lit(0)
    return [F.greatest(zero, y0 - pad), F.least(h, y1 + pad), F.greatest(zero, x0 - pad), F.least(w, x1 + pad)]


def square_box(y0: Column, y1: Column, x0: Column, x1: Column, h: Column, w: Column, grow: float = 1.2) -> list[Column]:
    """A square about the box's centre, `grow` times its longer side, clamped to the picture."""
    half = F.floor((F.greatest(y1 - y0, x1 - x0) * grow).cast("int") / 2).cast("int")
    cy, cx = F.floor((y0 + y1) / 2).cast("int"), F.floor((x0 + x1) / 2).cast("int")
    zero = F.lit(0)
    return [F.greatest(zero, cy - half), F.least(h, cy + half), F.greatest(zero, cx - half), F.least(w, cx + half)]


def aspect_fit(w: Column, h: Column, to_w: int, to_h: int) -> tuple[Column, Column]:
    """Size that fits into to_w x to_h with the same aspect: the side that the ratio says is filled, the other cut to whole pixels."""
    wide = w / h > F.lit(to_w / to_h)
    return F.when(wide, F.lit(to_w)).otherwise((F.lit(float(to_h)) * (w / h)).cast("int")), F.when(wide, (F.lit(float(to_w)) / (w / h)).cast("int")).otherwise(F.lit(to_h))


def stage_side(h: Column, w: Column) -> Column:
    """Side of the least square of 32 * 2**k that holds h x w."""
    n = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(h, w) / 32)).cast("int") + 1)
    return (F.lit(32) * F.pow(F.lit(2.0), n - 1)).cast("int")


def capped_size(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """most x most if either side is longer; the aspect is not kept."""
    over = (w > most) | (h > most)
    return F.when(over, F.lit(most)).otherwise(w).cast("int"), F.when(over, F.lit(most)).otherwise(h).cast("int")


def turned_size(h: Column, w: Column, degrees: Column) -> list[Column]:
    """height and width of the picture that holds an h x w one turned about its middle."""
    a = -F.radians(degrees - 360.0 * F.floor(degrees / 360.0))
    c, s = F.round(F.cos(a), 15), F.round(F.sin(a), 15)
    x, y = -c * w / 2 - s * h / 2 + w / F.lit(2.0), s * w / 2 - c * h / 2 + h / F.lit(2.0)
    xs, ys = [x, c * w + x, c * w + s * h + x, s * h + x], [y, -s * w + y, -s * w + c * h + y, c * h + y]
    side = lambda v: F.ceil(F.greatest(*v)) - F.floor(F.least(*v))
    return [side(ys).cast("long").alias("height"), side(xs).cast("long").alias("width")]


# --- arrays


def zero_padded(values: Column, before: int, after: int) -> Column:
    """An array with zeros put before and behind."""
    return F.concat(F.array_repeat(F.lit(0.0), before), values, F.array_repeat(F.lit(0.0), after))


def three_channels(values: Column) -> Column:
    """A grey row as an array of three equal channels a pixel."""
    return F.transform(values, lambda v: F.array(v, v, v))


# --- optics


def pixel_pitch(w: Column, h: Column) -> tuple[Column, Column]:
    """mm of sensor for a pixel, across and down. Landscape if wider than high, else portrait."""
    wide = w > h
    return F.when(wide, SENSOR_W_MM / w).otherwise(SENSOR_H_MM / w), F.when(wide, SENSOR_H_MM / h).otherwise(SENSOR_W_MM / h)


def mean_pitch(w: Column, h: Column) -> Column:
    """mm of sensor for a pixel, as the mean of both axes of a landscape picture."""
    return (SENSOR_W_MM / w + SENSOR_H_MM / h) / 2


def fixed_cm(pixels: Column, pixels_a_cm: float = 60.14) -> Column:
    """Length at a fixed scale, where nothing is known of the camera."""
    return pixels / F.lit(pixels_a_cm)


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "landscape").otherwise("portrait")


def pixels_per_cm(focal: Column, pitch: Column, distance: float = DISTANCE_MM) -> Column:
    """Thin lens; null where the focal length equals the distance."""
    return F.try_divide(focal * 10, (F.lit(distance) - focal) * pitch)


def focal_length(printed: Column) -> Column:
    """Struct of mm and ok: an absent value is the usual lens, one that isn't a plain number is an error."""
    got = printed.try_cast("double")
    return F.struct(F.when(printed.isNull(), FOCAL_MM).otherwise(got).alias("mm"), (printed.isNull() | got.isNotNull()).alias("ok"))


def rint3(x: Column) -> Column:
    """Three decimals, as array libraries round: scale, to the nearest even, scale back."""
    return F.rint(x * 1000) / 1000


def to_world(x: Column, y: Column, w: Column, h: Column, scale: float) -> tuple[Column, Column]:
    """Pixels to a plane centred on the picture, the longer side `scale` long."""
    sx = F.when(w > h, F.lit(scale)).otherwise(w / h * scale)
    sy = F.when(w > h, h / w * scale).otherwise(F.lit(scale))
    return (x / w - 0.5) * sx, (y / h - 0.5) * sy


def to_uv(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x / w, F.lit(1.0) - y / h


def arc_length(points: Column) -> Column:
    """Perimeter of a closed polygon, an array of structs x, y."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(1))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, after, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda s, x: s + x)


def unit(values: Column) -> Column:
    """L2-normalised array; the length counts as 1e-12 at least."""
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(values, lambda x: x / F.greatest(length, F.lit(1e-12)))


def clipped(values: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.transform(values, lambda x: F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
