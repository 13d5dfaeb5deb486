"""Scene statistics, moment matching and temporal composites over long pixels
(scene_id, y, x, band, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.config import REFERENCE_MEAN, REFERENCE_STD
from geoloom.functions.pixels import matched, to_byte


def band_moments(pixels: DataFrame, mask: Column | None = None) -> DataFrame:
    """(scene_id, band, mean, std): population moments over all pixels (or those of ``mask``)."""
    use = pixels if mask is None else pixels.where(mask)
    value = F.col("value").cast("double")
    return use.groupBy("scene_id", "band").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def image_moments(images: DataFrame, pixels: str = "pixels", channels: int = 3) -> DataFrame:
    """(band, n, mean, std) over the bytes of all decoded images: the statistics that scenes are
    matched to.  Each Arrow batch gives one row of sums per channel, which a small aggregate adds."""

    def sums(frames):
        import pandas as pd

        for frame in frames:
            flat = [np.frombuffer(b, np.uint8).reshape(-1, channels) for b in frame[pixels] if b is not None]
            if flat:
                value = np.concatenate(flat).astype(np.float64)
                yield pd.DataFrame({"band": range(channels), "n": len(value), "s": value.sum(0), "q": (value * value).sum(0)})

    parts = images.select(pixels).mapInPandas(sums, "band int, n long, s double, q double")
    total = parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select("band", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def moment_match(pixels: DataFrame, to_mean: tuple[float, ...] = REFERENCE_MEAN, to_std: tuple[float, ...] = REFERENCE_STD, mask: Column | None = None) -> DataFrame:
    """Pixels with ``matched`` (double) and ``byte`` (0..255).

    One pass for the moments, one for the pixels; the moments have a row per (scene, band), and
    the planner broadcasts them while they are small."""
    joined = pixels.join(band_moments(pixels, mask), ["scene_id", "band"])
    to = [F.get(F.lit(list(x)), F.col("band").cast("int")) for x in (to_mean, to_std)]
    out = joined.withColumn("matched", matched(F.col("value").cast("double"), F.col("mean"), F.col("std"), *to))
    return out.withColumn("byte", to_byte(F.col("matched"))).drop("mean", "std")


def median_composite(cube: DataFrame, keys: tuple[str, ...] = ("y", "x", "band"), value: str = "value") -> DataFrame:
    """Exact median over time per key.  A group holds one pixel's dates, so its buffer is bounded by
    the number of acquisitions."""
    return cube.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n_dates"))
