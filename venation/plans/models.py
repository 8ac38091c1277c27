"""Slots for what isn't shipped: raw decoders, the segmentation network and the network of normals.

A slot is a function on arrays. Once(load) makes one that is loaded at its first call in each Python worker and kept there; a
file of weights is shipped by Spark and found by name on the worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from ..operators import kernels as K

#: How raw photographs are developed: options that a decoder is called with, in the words of common raw libraries.
# For pictures to look at; by the decoder's own defaults; for measurements.
RAW_OPTIONS = {
    "camera": {"use_camera_wb": True, "no_auto_bright": False, "output_bps": 8},
    "defaults": {},
    "linear": {"gamma": (1, 1), "no_auto_bright": True, "output_bps": 8, "use_camera_wb": True, "half_size": False},
}
# Means and deviations of colours that segmentation networks were trained with.
MEAN, DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])

_loaded: dict[str, Callable] = {}


def ship_weights(spark: SparkSession, path: str) -> str:
    """Sends a file to every worker; the name to load it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


class Once:
    """A function that `load` makes at its first call in each process. load takes the local path of the weights, if there are any."""

    def __init__(self, key: str, load: Callable, weights: str | None = None):
        self.key, self.load, self.weights = key, load, weights

    def __call__(self, *args, **kw):
        if self.key not in _loaded:
            _loaded[self.key] = self.load(SparkFiles.get(self.weights)) if self.weights else self.load()
        return _loaded[self.key](*args, **kw)


class NetworkSegmenter:
    """0/255 masks by a network: forward(1 x 3 x side x side) gives a list of outputs, the last of them logits of that size."""

    def __init__(self, forward: Callable, side: int = 1024):
        self.forward, self.side = forward, side

    def __call__(self, image: np.ndarray) -> np.ndarray:
        x = (K.linear(K.three_channels(image), self.side, self.side) / 255.0 - MEAN) / DEVIATION
        logits = np.asarray(self.forward(np.moveaxis(x, -1, 0)[None].astype(np.float32))[-1], np.float64).reshape(self.side, self.side)
        likely = np.floor(255 / (1 + np.exp(-logits))).astype(np.uint8)
        back = K.linear(likely[..., None], image.shape[0], image.shape[1])[..., 0]
        return np.where(back > 128, 255, 0).astype(np.uint8)


def flat_normals(images: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The model of normals where none is given: a flat surface towards the viewer. images: number x height x width x 3."""
    out = np.zeros((*mask.shape, 3))
    out[..., 2] = 1
    return out
