"""Labelled image folders."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom.config import CLASS_NAMES, EXPECTED_IMAGES

# File endings that count as images.
EXTENSIONS = ("jpg", "jpeg", "png", "ppm", "bmp", "pgm", "tif", "tiff", "webp")


MOST_CLASSES = 10_000


def class_of(path: Column) -> Column:
    """Name of the folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def labelled(files: DataFrame, path: str = "path", classes: tuple[str, ...] | None = None) -> DataFrame:
    """Adds class_name and label, the index of the class among the sorted folder names (or among
    ``classes``, which must then be what is found)."""
    named = files.withColumn("class_name", class_of(F.col(path)))
    found = sorted(r[0] for r in named.select("class_name").distinct().limit(MOST_CLASSES + 1).collect())
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} class folders")
    if classes is not None and found != sorted(classes):
        raise ValueError(f"class folders {found} are not {sorted(classes)}")
    return named.withColumn("label", F.array_position(F.lit(found), F.col("class_name")).cast("int") - 1) if found else named.withColumn("label", F.lit(0))


def read_image_folder(spark: SparkSession, root: str, classes: tuple[str, ...] | None = CLASS_NAMES) -> DataFrame:
    """(path, class_name, label, content): files root/<class>/<file> with an image ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    images = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*EXTENSIONS)).select("path", "content")
    return labelled(images, classes=classes).select("path", "class_name", "label", "content")


def read_decoded(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, pixels): decoded RGB, interleaved.  The decoder gives BGR (or one
    channel), which is put right here."""
    images = spark.read.format("image").option("dropInvalid", "true").load(f"{root}/*").select("image.*")

    @F.pandas_udf("binary")
    def rgb(data, channels):
        import numpy as np
        import pandas as pd

        out = []
        for blob, n in zip(data, channels, strict=True):
            flat = np.frombuffer(blob, np.uint8).reshape(-1, n)
            out.append((np.repeat(flat, 3, 1) if n == 1 else flat[:, 2::-1]).tobytes())
        return pd.Series(out)

    return images.select(F.col("origin").alias("path"), "height", "width", rgb("data", "nChannels").alias("pixels"))


def class_counts(files: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_name, n) for all classes, files of any ending counted."""
    counts = files.groupBy("class_name").agg(F.count("*").alias("n"))
    return classes.join(counts, "class_name", "left").select("label", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


def count_warning(total: int, expected: int = EXPECTED_IMAGES) -> str | None:
    return None if total == expected else f"expected {expected} images, found {total}"


def class_root(folders: DataFrame, classes: tuple[str, ...] = CLASS_NAMES) -> DataFrame:
    """(parent) of folders(path) whose subfolders include every class, shortest first."""
    split = folders.select(F.regexp_extract("path", r"^(.*)/[^/]+/?$", 1).alias("parent"), F.regexp_extract("path", r"([^/]+)/?$", 1).alias("name"))
    held = split.where(F.col("name").isin(*classes)).groupBy("parent").agg(F.count_distinct("name").alias("n"))
    return held.where(F.col("n") == len(classes)).select("parent").orderBy(F.length("parent"), "parent")


def find_class_root(start: str, classes: tuple[str, ...] = CLASS_NAMES) -> Path:
    """The first local folder, ``start`` or below, that has a folder for every class."""
    for folder in [Path(start), *sorted(p for p in Path(start).rglob("*") if p.is_dir())]:
        if set(classes) <= {p.name for p in folder.iterdir() if p.is_dir()}:
            return folder
    raise RuntimeError(f"no folder under {start} holds all classes")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def relocate(root: str, target: str, classes: tuple[str, ...] = CLASS_NAMES, scratch: str | None = None) -> None:
    """Move class folders to ``target`` unless they are there already.  A ``scratch`` folder is deleted
    afterwards if no file is left in it and ``target`` is not below it."""
    Path(target).mkdir(parents=True, exist_ok=True)
    for name in classes:
        if (Path(root) / name).is_dir() and not (Path(target) / name).exists():
            shutil.move(str(Path(root) / name), str(Path(target) / name))
    if scratch and Path(scratch).is_dir() and not Path(target).resolve().is_relative_to(Path(scratch).resolve()) and not any(p.is_file() for p in Path(scratch).rglob("*")):
        shutil.rmtree(scratch)
