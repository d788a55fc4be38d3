"""Fitting decoded pictures into the square an image model expects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.images import letterbox_geometry


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures ``path, width, height, channels, data``; undecodable files are left out."""
    image = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    return image.filter("width > 0").select(
        F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def _weights(size: int, target: int) -> np.ndarray:
    """Lanczos weights ``(target, size)`` of a resampled side."""
    scale = size / target
    support = 3.0 * max(scale, 1.0)
    out = np.zeros((target, size))
    for i in range(target):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - support + 0.5)), min(size, int(centre + support + 0.5))
        x = (np.arange(lo, hi) + 0.5 - centre) / max(scale, 1.0)
        w = np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)
        out[i, lo:hi] = w / w.sum()
    return out


def _to_byte(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255)


def to_rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Pixels in red, green, blue order; grey is repeated, alpha is dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def letterbox_pixels(pixels: np.ndarray, width: int, height: int, x: int, y: int, max_size: int) -> np.ndarray:
    if pixels.shape[:2] != (height, width):
        wide = np.einsum("iw,hwc->hic", _weights(pixels.shape[1], width), pixels.astype(float))
        pixels = _to_byte(np.einsum("jh,hic->jic", _weights(pixels.shape[0], height), _to_byte(wide)))
    square = np.zeros((max_size, max_size, 3), np.uint8)
    square[y:y + height, x:x + width] = pixels
    return square


def letterbox(pictures: DataFrame, max_size: int = 224) -> DataFrame:
    """Replace ``data`` by the RGB bytes of the picture centred on a black square.

    The geometry is computed by plain expressions and kept as ``box``; Python
    only resamples the pixels, one picture at a time.
    """

    @F.pandas_udf("binary")
    def render(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series,
               box: pd.DataFrame) -> pd.Series:
        out = []
        for i in range(len(data)):
            b = box.iloc[i]
            rgb = to_rgb(data.iloc[i], int(width.iloc[i]), int(height.iloc[i]), int(channels.iloc[i]))
            out.append(letterbox_pixels(rgb, int(b.width), int(b.height), int(b.x_offset), int(b.y_offset),
                                        max_size).tobytes())
        return pd.Series(out, index=data.index, dtype=object)

    boxed = pictures.withColumn("box", letterbox_geometry(F.col("width"), F.col("height"), max_size))
    return boxed.withColumn("data", render("data", "width", "height", "channels", "box"))
