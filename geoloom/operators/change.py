"""Two-date comparison of grids, change events and the change map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.config import FOREST_LABELS, TARGET_LABELS
from geoloom.functions.geo import centroid

# Map colours (R, G, B); red stands over green, green over grey.
GREY, GREEN, RED = (0.85, 0.85, 0.85), (0.1, 0.5, 0.1), (0.85, 0.1, 0.1)


def was_forest(label: Column, conf: Column, min_conf: float | Column = 0.0, forest: tuple[int, ...] = FOREST_LABELS) -> Column:
    return label.isin(*forest) & (conf >= min_conf)


def became_target(label: Column, conf: Column, min_conf: float | Column = 0.0, target: tuple[int, ...] = TARGET_LABELS) -> Column:
    return label.isin(*target) & (conf >= min_conf)


def require_same_grid(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> None:
    """Raises ValueError unless both dates have the same cells, counted in one aggregate."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    odd = both.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a != _b")
    if not odd.isEmpty():
        raise ValueError("the two dates must cover the same cells")


def change_cells(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("row", "col"), min_conf: float = 0.0) -> DataFrame:
    """Cells with label_a, conf_a, label_b, conf_b, was_forest and change: one equi-join on the cell."""
    left = a.withColumnsRenamed({"label": "label_a", "conf": "conf_a"})
    right = b.select(*keys, F.col("label").alias("label_b"), F.col("conf").alias("conf_b"))
    forest = was_forest(F.col("label_a"), F.col("conf_a"), min_conf)
    return left.join(right, list(keys)).withColumns({"was_forest": forest, "change": forest & became_target(F.col("label_b"), F.col("conf_b"), min_conf)})


def gated(changed: DataFrame, min_conf: Column) -> DataFrame:
    """The same cells judged again at another gate, which may be a column."""
    forest = was_forest(F.col("label_a"), F.col("conf_a"), min_conf)
    return changed.withColumns({"was_forest": forest, "change": forest & became_target(F.col("label_b"), F.col("conf_b"), min_conf)})


def paired(b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The second date's cells under the names of the first date's scenes, by pairs(scene_a, scene_b).
    Scenes of two dates then meet on (scene_id, row, col), any number of them in one job."""
    return b.join(pairs, F.col("scene_id") == F.col("scene_b")).drop("scene_id", "scene_b").withColumnRenamed("scene_a", "scene_id")


def change_summary(changed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_forest, n_change, percent): percent of forest cells to one digit, 0 without forest."""
    counts = changed.groupBy(*keys).agg(F.count_if("was_forest").alias("n_forest"), F.count_if("change").alias("n_change"))
    return counts.withColumn("percent", F.round(100 * F.col("n_change") / F.greatest(F.col("n_forest"), F.lit(1)), 1))


def change_events(changed: DataFrame, bounds: DataFrame, classes: DataFrame, keys: tuple[str, ...] = ("row", "col"), crs: str = "") -> DataFrame:
    """A row per changed cell: keys, centroid, class names, crs.  Changed cells are few, so the filter
    stands below both joins; order them by the keys when writing."""
    x, y = centroid(*(F.col(c) for c in ("left", "bottom", "right", "top")))
    found = changed.where("change").select(*keys, "label_a", "label_b").join(bounds, list(keys))
    for side, name in (("label_a", "from_class"), ("label_b", "to_class")):  # Spark broadcasts a few classes by itself
        found = found.join(classes.select(F.col("label").alias(side), F.col("class_name").alias(name)), side)
    return found.select(*keys, x.alias("centroid_x"), y.alias("centroid_y"), "from_class", "to_class", F.lit(crs).alias("crs"))


def change_map(changed: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """(keys, r, g, b) of the map's cells."""

    def channel(i: int) -> Column:
        return F.when(F.col("change"), RED[i]).when(F.col("was_forest"), GREEN[i]).otherwise(GREY[i])

    return changed.select(*keys, *[channel(i).alias(c) for i, c in enumerate("rgb")])


def transitions(changed: DataFrame) -> DataFrame:
    """(label_a, label_b, n): how many cells went from which class to which."""
    return changed.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
