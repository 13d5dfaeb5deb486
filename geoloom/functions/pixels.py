"""Pixel arithmetic: matching, truncation, tensors, flips, resizing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from geoloom.config import CHANNEL_MEAN, CHANNEL_STD

EPSILON = 1e-6


def matched(value: Column, mean: Column, std: Column, to_mean: Column, to_std: Column) -> Column:
    """Affine moment match of one channel."""
    return (value - mean) / (std + F.lit(EPSILON)) * to_std + to_mean


def to_byte(value: Column) -> Column:
    """Clip to 0..255 and truncate; NaN gives 0, as in byte strips, and null gives null."""
    return F.when(F.isnan(value), 0).when(value.isNotNull(), F.least(F.lit(255.0), F.greatest(F.lit(0.0), value)).cast("int"))


def unit(pixels: Column) -> Column:
    """Bytes to [0, 1]."""
    return F.transform(pixels, lambda v: v / F.lit(255.0))


def normalised(channels: Column, mean: tuple[float, ...] = CHANNEL_MEAN, std: tuple[float, ...] = CHANNEL_STD) -> Column:
    """(v - mean) / std of an array with one value per channel."""
    scaled = F.zip_with(channels, F.lit(list(mean)), lambda v, m: v - m)
    return F.zip_with(scaled, F.lit(list(std)), lambda v, s: v / s)


def planar(pixels: Column, n_channels: int = 3) -> Column:
    """Interleaved (H*W*C) to planar (C*H*W) order."""
    per = F.size(pixels) / n_channels
    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), lambda i: F.get(pixels, ((i % per.cast("int")) * n_channels + F.floor(i / per).cast("int"))))


def coin(seed: int, epoch: Column, key: Column, salt: str) -> Column:
    """A fair coin that depends on seed, epoch and row only, so a rerun flips the same images."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), key.cast("string"), F.lit(salt))), 1, 1), 16, 10).cast("int") < 8


def flipped(position: Column, size: int | Column, flip: Column) -> Column:
    """Index remap of a mirror along one axis."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(flip, size - 1 - position).otherwise(position)


def transformed(
    pixels: Column, height: int, width: int, train: Column, seed: int, epoch: Column, key: Column,
    mean: tuple[float, ...] = CHANNEL_MEAN, std: tuple[float, ...] = CHANNEL_STD,
) -> Column:
    """The transform of a split in one expression: interleaved (H*W*C) bytes to a normalised (C*H*W)
    tensor, mirrored along both axes by a training row's own coins; other rows keep their place."""
    n, area = len(mean), height * width
    wide, tall = (train & coin(seed, epoch, key, salt) for salt in "hv")

    def value(i: Column) -> Column:
        c, y, x = F.floor(i / area).cast("int"), F.floor(i % area / width).cast("int"), i % width
        source = (flipped(y, height, tall) * width + flipped(x, width, wide)) * n + c
        return (F.get(pixels, source) / F.lit(255.0) - F.get(F.lit(list(mean)), c)) / F.get(F.lit(list(std)), c)

    return F.transform(F.sequence(F.lit(0), F.lit(area * n - 1)), value)


def _weights(n_in: int, n_out: int) -> np.ndarray:
    """Row-normalised triangle filter between pixel centres; widened when shrinking."""
    scale = n_in / n_out
    reach = max(1.0, scale)
    centre = (np.arange(n_out) + 0.5) * scale
    near = np.abs((np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / reach)
    w = np.maximum(0.0, 1.0 - near)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of an (H, W, C) uint8 image."""
    rows, cols = _weights(image.shape[0], height), _weights(image.shape[1], width)
    out = np.einsum("ij,jkc,lk->ilc", rows, image.astype(np.float64), cols)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize_udf(height: int, width: int, out_height: int, out_width: int, channels: int = 3):
    """Arrow-batched resize of a binary column of interleaved bytes."""

    @F.pandas_udf("binary")
    def run(blobs):
        import pandas as pd

        return pd.Series([None if b is None else resize(np.frombuffer(b, np.uint8).reshape(height, width, channels), out_height, out_width).tobytes() for b in blobs])

    return run


def resize_any(blob: str, height: str, width: str, size: int, channels: int = 3) -> Column:
    """Interleaved bytes of images of any size to (size, size); those of that size pass as they are."""

    @F.pandas_udf("binary")
    def run(blobs, heights, widths):
        import pandas as pd

        return pd.Series([b if (h, w) == (size, size) else resize(np.frombuffer(b, np.uint8).reshape(h, w, channels), size, size).tobytes() for b, h, w in zip(blobs, heights, widths, strict=True)])

    return run(blob, height, width)
