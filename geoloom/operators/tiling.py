"""Spatial windows over a raster: tumbling, overlapping or gapped, partial windows dropped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.config import PATCH


def n_windows(extent: Column, size: int = PATCH, stride: int | Column = PATCH) -> Column:
    """Windows along an axis; 0 if the extent is smaller than one."""
    stride = stride if isinstance(stride, Column) else F.lit(stride)
    return F.greatest(F.lit(0), F.floor((extent - size) / stride) + 1).cast("int")


def window_indexes(position: Column, extent: Column, size: int = PATCH, stride: int = PATCH) -> Column:
    """Indexes of the windows that contain a position, as an array (empty where there is none)."""
    low = F.greatest(F.lit(0), F.ceil((position - (size - 1)) / F.lit(stride))).cast("int")
    high = F.least(n_windows(extent, size, stride) - 1, F.floor(position / F.lit(stride)).cast("int"))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def explode_windows(pixels: DataFrame, height: Column, width: Column, size: int = PATCH, stride: int = PATCH) -> DataFrame:
    """A row per (pixel, window): adds row and col.  A pixel is repeated ceil(size / stride) ** 2
    times, which is why full scenes go through ``patch_strips``."""
    rows = pixels.withColumn("row", F.explode(window_indexes(F.col("y"), height, size, stride)))
    return rows.withColumn("col", F.explode(window_indexes(F.col("x"), width, size, stride)))


def window_means(pixels: DataFrame, height: Column, width: Column, size: int = PATCH, stride: int = PATCH, value: str = "value", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """(keys, row, col, n_px, mean) per window; partial sums combine before the shuffle."""
    there = explode_windows(pixels, height, width, size, stride)
    return there.groupBy(*keys, "row", "col").agg(F.count("*").alias("n_px"), F.avg(F.col(value).cast("double")).alias("mean"))


def window_grid(scenes: DataFrame, size: int = PATCH, stride: int = PATCH) -> DataFrame:
    """(scene_id, row, col, y, x) of all windows of scenes(scene_id, height, width)."""
    n_rows, n_cols = (n_windows(F.col(c), size, stride) for c in ("height", "width"))
    some = scenes.withColumns({"n_rows": n_rows, "n_cols": n_cols}).where("n_rows > 0 AND n_cols > 0")
    cells = some.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return cells.withColumns({"y": F.col("row") * stride, "x": F.col("col") * stride})


def patch_strips(strips: DataFrame, size: int = PATCH, stride: int = PATCH, channels: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """(scene_id, carried columns, row, col, pixels): patches from strips(scene_id, height, width, y0, n_rows, data),
    data being n_rows * width interleaved byte pixels.

    A strip goes to the window rows that it touches; a group is one window row of one scene, that
    is size * width pixels at most, whatever the scene's height."""
    low = F.greatest(F.lit(0), F.ceil((F.col("y0") - (size - 1)) / F.lit(stride))).cast("int")
    high = F.least(n_windows(F.col("height"), size, stride) - 1, F.floor((F.col("y0") + F.col("n_rows") - 1) / F.lit(stride)).cast("int"))
    dealt = strips.withColumn("row", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))

    def assemble(key, group):
        row = key[-1]
        width = int(group["width"].iloc[0])
        slab = np.zeros((size, width, channels), np.uint8)
        for y0, n, data in zip(group["y0"], group["n_rows"], group["data"], strict=True):
            block = np.frombuffer(data, np.uint8).reshape(n, width, channels)
            a, b = max(row * stride, y0), min(row * stride + size, y0 + n)
            slab[a - row * stride : b - row * stride] = block[a - y0 : b - y0]
        starts = range(0, width - size + 1, stride)
        same = {c: [group[c].iloc[0]] * len(starts) for c in ("scene_id", *carried)}
        return pd.DataFrame(same | {"row": [int(row)] * len(starts), "col": range(len(starts)), "pixels": [slab[:, x : x + size].tobytes() for x in starts]})

    kinds = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in ("scene_id", *carried))
    return dealt.groupBy("scene_id", "row").applyInPandas(assemble, f"{kinds}, row int, col int, pixels binary")
