"""Constants of the land-cover domain.  All of them are defaults of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Class names in label order, and the sets that define a change.
CLASS_NAMES = ("AnnualCrop", "Forest", "HerbaceousVegetation", "Highway", "Industrial", "Pasture", "PermanentCrop", "Residential", "River", "SeaLake")
FOREST_CLASSES = ("Forest",)
TARGET_CLASSES = ("AnnualCrop", "Industrial", "Pasture", "PermanentCrop", "Residential")

# Radiometry that scenes are matched to (R, G, B), and channel normalisation.
REFERENCE_MEAN = (86.4, 96.6, 103.2)
REFERENCE_STD = (49.7, 34.0, 29.2)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

PATCH = 64
INPUT_SIZE = 224
SEED = 42
TRAIN_SHARE, VAL_SHARE = 0.8, 0.1
INFERENCE_BATCH = 128
EXPECTED_IMAGES = 27_000
EMPTY_LABEL = -1

FOREST_LABELS = tuple(CLASS_NAMES.index(c) for c in FOREST_CLASSES)
TARGET_LABELS = tuple(sorted(CLASS_NAMES.index(c) for c in TARGET_CLASSES))


def class_dim(spark: SparkSession, names: tuple[str, ...] = CLASS_NAMES, forest: tuple[str, ...] = FOREST_CLASSES, target: tuple[str, ...] = TARGET_CLASSES) -> DataFrame:
    """The class dimension: one row per class (ten rows, safe to broadcast)."""
    rows = [(i, n, n in forest, n in target) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "label int, class_name string, is_forest boolean, is_target boolean")
