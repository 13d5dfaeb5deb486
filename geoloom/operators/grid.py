"""Land-cover grids: predictions to cells, dense grids, class histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.config import EMPTY_LABEL
from geoloom.functions.vectors import argmax, top_probability


def predicted(df: DataFrame, logits: Column) -> DataFrame:
    """Adds label (argmax, first on ties) and conf (its softmax probability)."""
    return df.withColumn("_x", logits).withColumns({"label": argmax(F.col("_x")), "conf": top_probability(F.col("_x"))}).drop("_x")


def densify(predictions: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("row", "col"), order: str | None = None) -> DataFrame:
    """All cells; those without a prediction get label -1 and confidence 0.  If a cell is predicted
    more than once the last one by ``order`` holds."""
    if order:
        predictions = predictions.groupBy(*keys).agg(F.max_by(F.struct("label", "conf"), order).alias("p")).select(*keys, "p.*")
    joined = cells.join(predictions.select(*keys, "label", "conf"), list(keys), "left")
    return joined.withColumns({"label": F.coalesce("label", F.lit(EMPTY_LABEL)).cast("long"), "conf": F.coalesce("conf", F.lit(0.0))})


def class_histogram(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, class_name, n), classes without cells included."""
    counts = predictions.groupBy("label").agg(F.count("*").alias("n"))
    return classes.join(counts, "label", "left").select("label", "class_name", F.coalesce("n", F.lit(0)).alias("n"))
