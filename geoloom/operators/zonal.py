"""A reference raster aggregated onto grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256


def loss_window(year_a: int, year_b: int) -> tuple[int, int]:
    """Encoded years (a, b] of a raster in which n means 2000 + n and 0 means none."""
    if year_a < 2000:
        raise ValueError("year_a must be 2000 or later: before that the code for no loss would count")
    return year_a - 2000, year_b - 2000


def in_window(lossyear: Column, year_a: int, year_b: int) -> Column:
    low, high = loss_window(year_a, year_b)
    return (lossyear > low) & (lossyear <= high)


def scene_extent(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"))


def raster_window(raster: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels of a window; the bounds reach the scan, so sorted Parquet skips row groups."""
    return raster.where((F.col("pr") >= r0) & (F.col("pr") < r1) & (F.col("pc") >= c0) & (F.col("pc") < c1))


def cell_pixels(cells: DataFrame, raster: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels inside each cell's half-open box (r0, r1, c0, c1); boxes may overlap.

    The range join is made an equi-join on square blocks of pixels: a cell goes to the blocks that
    its box touches (one to four if it is smaller than a block), a pixel has one block, and the
    exact test follows within the block.  Blocks that no cell touches are dropped from the raster first:
    there are few blocks beside pixels, so this join moves no raster while they fit a broadcast."""

    def blocks(low: str, high: str) -> Column:
        last = F.floor((F.col(high) - 1) / block)
        return F.when(F.col(low) < F.col(high), F.sequence(F.floor(F.col(low) / block), last)).otherwise(F.array().cast("array<bigint>"))

    dealt = cells.withColumn("_br", F.explode(blocks("r0", "r1"))).withColumn("_bc", F.explode(blocks("c0", "c1")))
    placed = raster.withColumns({"_br": F.floor(F.col("pr") / block), "_bc": F.floor(F.col("pc") / block)})
    inside = (F.col("pr") >= F.col("r0")) & (F.col("pr") < F.col("r1")) & (F.col("pc") >= F.col("c0")) & (F.col("pc") < F.col("c1"))
    placed = placed.join(dealt.select("_br", "_bc").distinct(), ["_br", "_bc"], "left_semi")
    return dealt.join(placed, ["_br", "_bc"]).where(inside).drop("_br", "_bc")


def loss_fraction(cells: DataFrame, raster: DataFrame, lost: Column, keys: tuple[str, ...] = ("row", "col"), block: int = BLOCK) -> DataFrame:
    """(keys, n_px, loss_frac) for every cell; loss_frac is null and n_px 0 where no pixel lies."""
    there = cell_pixels(cells.select(*keys, "r0", "r1", "c0", "c1"), raster, block)
    frac = there.groupBy(*keys).agg(F.count("*").alias("n_px"), F.avg(lost.cast("double")).alias("loss_frac"))
    return cells.select(*keys).join(frac, list(keys), "left").withColumn("n_px", F.coalesce("n_px", F.lit(0)))


def loss_fraction_by_key(pixels: DataFrame, lost: Column, keys: tuple[str, ...]) -> DataFrame:
    """The same where pixels already carry their cell."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("n_px"), F.avg(lost.cast("double")).alias("loss_frac"))


def reference_cells(fractions: DataFrame, min_loss_frac: float | Column = 0.0) -> DataFrame:
    """Adds ref: more than (strictly) the given fraction lost; cells without pixels are not lost."""
    least = min_loss_frac if isinstance(min_loss_frac, Column) else F.lit(min_loss_frac)
    return fractions.withColumn("ref", F.coalesce(F.col("loss_frac") > least, F.lit(False)))
