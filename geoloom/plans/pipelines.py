"""Scenes to patches, patches to land cover, two dates to change, change to scores; training and
evaluation of the head.  Every step takes and gives DataFrames and is lazy unless it says so."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom import config
from geoloom.functions.geo import box_from_utm, pixel_range, window_bounds
from geoloom.functions.pixels import resize_any
from geoloom.operators import change, grid, inference, metrics, sampling, tiling, zonal
from geoloom.sources import geotiff, images as images_of


def patchify(spark: SparkSession, path: str, stride: int = config.PATCH, size: int = config.PATCH) -> DataFrame:
    """(scene_id, row, col, left, bottom, right, top, crs, pixels) of the GeoTIFF scenes at a path,
    each matched to the reference radiometry and cut into windows.  Pixels are decoded twice: for the
    moments, of which a row per scene and band goes on, and for the patches."""
    strips = geotiff.read_strips(spark, path)
    matched = geotiff.matched_strips(strips, geotiff.strip_moments(strips), config.REFERENCE_MEAN, config.REFERENCE_STD)
    placed = tiling.patch_strips(matched, size, stride, carried=("crs", "transform"))
    bounds = window_bounds(F.col("col") * stride, F.col("row") * stride, size, F.col("transform"))
    return placed.withColumn("b", bounds).select("scene_id", "row", "col", "b.*", "crs", "pixels")


def classify(patches: DataFrame, features: str, make_model: Callable[[], Callable], n_features: int, batch_size: int = config.INFERENCE_BATCH) -> DataFrame:
    """Patches with label and conf.  The pixels are dropped; write the result before using it twice, or
    the model runs twice."""
    scored = inference.infer(patches, features, make_model, n_features, batch_size)
    return grid.predicted(scored, F.transform("logits", lambda v: v.cast("double"))).drop("logits", "pixels", features)


def classify_patches(patches: DataFrame, model) -> DataFrame:
    """Patches of pixels to a land-cover grid by a fitted head on the features of ``pixel_features``."""
    rows = patches if "features" in patches.columns else inference.pixel_features(patches)
    scored = inference.predict(model, inference.head_features(rows.withColumnRenamed("features", "_x").withColumn("label", F.lit(0)), "_x", "label"))
    return scored.withColumns({"label": F.col("pred").cast("long"), "conf": F.array_max("probability")}).drop("_x", "features", "pixels", "rawPrediction", "probability", "prediction", "pred")


def labelled_features(spark: SparkSession, root: str, size: int = config.PATCH) -> DataFrame:
    """(id, class_name, label, features) of an image folder: decoded, resized to patches where they have
    another size, and put through the same features as patches."""
    images = images_of.read_decoded(spark, root)
    pixels = images.withColumn("pixels", resize_any("pixels", "height", "width", size)).select("path", "pixels")
    return inference.pixel_features(images_of.labelled(pixels)).select(F.xxhash64("path").alias("id"), "class_name", "label", "features")


def detect(a: DataFrame, b: DataFrame, min_conf: float = 0.0, keys: tuple[str, ...] = ("row", "col"), check: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """Change cells of two dates.  ``pairs`` (scene_a, scene_b) says which scenes belong together, and
    puts scene_id among the keys.  With ``check`` the grids are compared first (one small job)."""
    if pairs is not None:
        b, keys = change.paired(b, pairs), ("scene_id", *[k for k in keys if k != "scene_id"])
    for cells in (a, b):
        if "scene_id" in cells.columns and "scene_id" not in keys and len(cells.select("scene_id").distinct().limit(2).collect()) > 1:
            raise ValueError("several scenes: name the pairs, or put scene_id among the keys")
    if check:
        change.require_same_grid(a, b, keys)
    return change.change_cells(a, b, keys, min_conf)


def pixel_boxes(cells: DataFrame, transform: dict[str, float], height: int, width: int, zone: int | None = None, south: bool = True) -> DataFrame:
    """Cells (left, bottom, right, top) with their raster rows and columns r0, r1, c0, c1.  A UTM zone
    says that the cells are projected and the raster is geographic."""
    box = [F.col(c) for c in ("left", "bottom", "right", "top")]
    there = box_from_utm(*box, zone, south) if zone else box
    affine = F.struct(*[F.lit(float(transform[k])).alias(k) for k in "abcdef"])
    return cells.withColumn("_p", pixel_range(*there, affine, F.lit(height), F.lit(width))).select("*", "_p.*").drop("_p")


def align_and_score(
    changed: DataFrame, raster: DataFrame, year_a: int, year_b: int, min_loss_frac: float = 0.0, keys: tuple[str, ...] = ("row", "col"), per: tuple[str, ...] = (),
) -> DataFrame:
    """One row of scores, or one for each value of ``per`` (some of the keys).  ``changed`` has change and
    the pixel boxes, ``raster`` has pr, pc, lossyear."""
    fractions = zonal.loss_fraction(changed, raster, zonal.in_window(F.col("lossyear"), year_a, year_b), keys)
    pairs = changed.select(*keys, "change").join(zonal.reference_cells(fractions, min_loss_frac).select(*keys, "ref"), list(keys))
    scores = metrics.detection_scores(metrics.detection_counts(pairs, per))
    given = {"year_a": F.lit(year_a), "year_b": F.lit(year_b), "min_loss_frac": F.lit(min_loss_frac)}
    names = {"detected_cells": "model_detected_cells", "reference_cells": "gfw_reference_cells"}
    return scores.withColumnsRenamed(names).withColumns(given).select(*per, *given, *names.values(), "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1", "iou")


def train(rows: DataFrame, key: str, embedding: str, label: str, n_features: int, n_classes: int, iterations: tuple[int, ...] = (5, 10, 20), tuned_iterations: tuple[int, ...] = (30,), seed: int = config.SEED, save_to: str | None = None):
    """(best model, history): the head is fitted, then a small network; a step of the history is a
    fit with so many iterations.  The best by validation accuracy, earliest on ties, is returned.
    With ``save_to`` each strictly better model is saved at once, so a run that breaks off leaves the
    best so far.  Eager: each fit is a Spark job of its own; history has the seconds of each."""
    spark = rows.sparkSession
    split = inference.head_features(sampling.exact_split(rows, key, seed=seed), embedding, label).select(key, "features", "label", "split").cache()
    parts = {s: split.where(F.col("split") == s) for s in ("train", "val")}
    history, models, top = [], [], 0.0
    steps = [("head", n) for n in iterations] + [("fine_tune", n) for n in tuned_iterations]
    for seq, (phase, n) in enumerate(steps):
        began = time.perf_counter()
        model = inference.fit_head(parts["train"], n) if phase == "head" else inference.fit_tuned(parts["train"], [n_features, 32, n_classes], n, seed)
        row = [seq, phase, n]
        for s in ("train", "val"):
            scored = inference.predict(model, parts[s])
            row += list(scored.agg(F.avg(inference.log_loss(F.col("probability"), F.col("label"))), F.avg((F.col("pred") == F.col("label")).cast("double"))).first())
        history.append((*row, time.perf_counter() - began))
        models.append(model)
        if row[-1] is not None and row[-1] > top:
            top = row[-1]
            if save_to:
                save_checkpoint(model, top, save_to, spark)
    split.unpersist()
    table = spark.createDataFrame(history, "seq int, phase string, epoch int, train_loss double, train_acc double, val_loss double, val_acc double, seconds double")
    best = sampling.best_epoch(table).first()
    return (models[best["seq"]] if best else models[-1]), sampling.running_best(table)


def save_checkpoint(model, val_acc: float, path: str, spark: SparkSession, classes: tuple[str, ...] = config.CLASS_NAMES) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(val_acc, list(classes), type(model).__name__)], "val_acc double, class_names array<string>, kind string").write.mode("overwrite").json(f"{path}/about")


def load_checkpoint(path: str, spark: SparkSession):
    """(model, val_acc, class_names)."""
    from pyspark.ml import classification

    about = spark.read.json(f"{path}/about").first()
    return getattr(classification, about["kind"]).load(f"{path}/model"), about["val_acc"], about["class_names"]


def evaluate(model, rows: DataFrame, key: str, embedding: str, label: str, classes: DataFrame, seed: int = config.SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy, report, confusion matrix) on the test rows, which the seed names anew."""
    test = inference.head_features(sampling.exact_split(rows, key, seed=seed), embedding, label).where(F.col("split") == "test")
    pairs = inference.predict(model, test).select(F.col("label").cast("int").alias("label"), "pred")
    return metrics.accuracy(pairs), metrics.classification_report(pairs, classes), metrics.confusion_matrix(pairs, classes, classes.count())
