"""One query per operator, on deterministic derivations of the standard tables.

``embeddings`` gives logits (ten numbers for each of two dates), features and a raster; a cell is a
vector, 25 to a grid row.  ``orders`` gives loss pixels and a training history, ``events`` a cube.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom import config
from geoloom.functions import geo, pixels, vectors
from geoloom.operators import change, grid, inference, metrics, radiometry, sampling, tiling, zonal
from geoloom.sources import images, tables

YEAR_A, YEAR_B = 1997, 2000
THRESHOLDS = (0.0, 0.25, 0.5, 0.75)
SHARP = 20.0
WEIGHTS = [[((k * 7 + j * 3) % 11 - 5) / 10 for j in range(8)] for k in range(10)]
BIAS = [k / 10 for k in range(10)]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _logits(start: int, scale: float = 1.0) -> Column:
    return F.transform(F.slice("embedding", start + 1, 10), lambda v: v.cast("double") * scale)


def _cell(df: DataFrame) -> DataFrame:
    return df.withColumns({"row": F.floor(F.col("vec_id") / 25).cast("int"), "col": (F.col("vec_id") % 25).cast("int")})


def _dates(spark: SparkSession, d: str, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    vec = _read(spark, d, "embeddings").select("vec_id", "embedding")
    return tuple(_cell(grid.predicted(vec, _logits(s, scale)).select("vec_id", "label", "conf")).drop("vec_id") for s in (0, 10))


def _changed(spark: SparkSession, d: str, min_conf: float = 0.0, scale: float = 1.0) -> DataFrame:
    return change.change_cells(*_dates(spark, d, scale), min_conf=min_conf)


def _bounds(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"left": F.col("col") * 640.0, "bottom": 9000000.0 - (F.col("row") + 1) * 640, "right": (F.col("col") + 1) * 640.0, "top": 9000000.0 - F.col("row") * 640})


def _loss_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Orders below 8 * cells, dealt to cells by remainder; the number of cells is a one-row table."""
    n = _read(spark, d, "embeddings").agg(F.count("*").alias("n"))
    placed = _read(spark, d, "orders").select("o_orderkey", "o_orderdate").crossJoin(F.broadcast(n)).where(F.col("o_orderkey") < 8 * F.col("n"))
    cell = (F.col("o_orderkey") % F.col("n")).alias("vec_id")
    return _cell(placed.select(cell, F.year("o_orderdate").alias("year"))).drop("vec_id")


def _fractions(spark: SparkSession, d: str) -> DataFrame:
    lost = (F.col("year") > YEAR_A) & (F.col("year") <= YEAR_B)
    return zonal.loss_fraction_by_key(_loss_pixels(spark, d), lost, ("row", "col"))


def _raster(spark: SparkSession, d: str) -> DataFrame:
    vec = _read(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode(F.slice("embedding", 1, 63)).alias("p", "value"))
    return vec.select(F.lit("scene").alias("scene_id"), "y", F.floor(F.col("p") / 3).cast("int").alias("x"), (F.col("p") % 3).alias("band"), "value")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("scene_id"), (F.col("s_suppkey") * 37 % 500 + 40).cast("int").alias("height"), (F.col("s_suppkey") * 53 % 400 + 30).cast("int").alias("width"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    vec = _read(spark, d, "embeddings")
    return grid.predicted(vec.select("vec_id", "embedding", F.col("label").alias("actual")), _logits(0)).select("vec_id", F.col("actual").alias("label"), F.col("label").alias("pred"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    seq = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("seq")
    return _read(spark, d, "orders").groupBy(seq).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("val_acc"))


def _cube(spark: SparkSession, d: str) -> DataFrame:
    period = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "A").otherwise("B").alias("period")
    return _read(spark, d, "events").select("event_id", F.to_date("ts").alias("acq_date"), period, F.col("user_id").alias("x"), F.col("event_type").alias("band"), "value", (F.col("event_id") % 100).cast("double").alias("cloud_pct"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a made-up image folder, one per customer; two classes stay empty."""
    name = F.element_at(F.lit(list(config.CLASS_NAMES)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return _read(spark, d, "customer").select(F.concat(F.lit("file:/data/"), name, F.lit("/"), F.col("c_name"), F.lit(".jpg")).alias("path"))


def change_sweep(s, d):
    thresholds = s.createDataFrame([(t,) for t in THRESHOLDS], "min_loss_frac double")
    return metrics.threshold_sweep(_changed(s, d), _fractions(s, d), thresholds, ("row", "col"))


def band_moments(s, d):
    out = radiometry.band_moments(_raster(s, d))
    return out.select("band", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def moment_match(s, d):
    out = radiometry.moment_match(_raster(s, d))
    return out.select("y", "x", "band", F.round("matched", 4).alias("matched"), "byte")


def _windows(s, d, stride):
    height = _read(s, d, "embeddings").agg(F.count("*").cast("int").alias("height"))
    placed = _raster(s, d).crossJoin(F.broadcast(height))
    out = tiling.window_means(placed, F.col("height"), F.lit(21), 8, stride, keys=("scene_id", "band"))
    return out.select("band", "row", "col", "n_px", F.round("mean", 6).alias("mean"))


def window_counts(s, d):
    strides = _scenes(s, d).withColumn("stride", F.explode(F.lit([32, 64, 96])))
    return strides.select("scene_id", "stride", tiling.n_windows(F.col("height"), 64, F.col("stride")).alias("n_rows"), tiling.n_windows(F.col("width"), 64, F.col("stride")).alias("n_cols"))


def window_bounds(s, d):
    cells = tiling.window_grid(_scenes(s, d), 64, 32)
    affine = F.struct(F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), (F.col("scene_id") * 1000).cast("double").alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), F.lit(9000000.0).alias("f"))
    return cells.withColumn("w", geo.window_bounds(F.col("x"), F.col("y"), 64, affine)).select("scene_id", "row", "col", "w.*")


def softmax_argmax(s, d):
    vec = _read(s, d, "embeddings").select("vec_id", _logits(0).alias("logits"))
    p = vectors.softmax(F.col("logits"))
    out = vec.withColumn("p", p)
    return out.select("vec_id", vectors.argmax(F.col("logits")).alias("label"), F.round(F.array_max("p"), 6).alias("conf"), F.round(F.get("p", F.lit(3)), 6).alias("p3"))


def grid_densify(s, d):
    """All predictions on a grid that is a column wider, so that every row has an empty cell."""
    predictions = _dates(s, d)[0]
    cells = predictions.select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(25))))
    return grid.densify(predictions, cells).select("row", "col", "label", F.round("conf", 6).alias("conf"))


def class_histogram(s, d):
    return grid.class_histogram(_dates(s, d)[0], config.class_dim(s))


def change_cells(s, d):
    return _changed(s, d).select("row", "col", "label_a", "label_b", "was_forest", "change")


def change_events(s, d):
    changed = _changed(s, d)
    return change.change_events(changed, _bounds(_dates(s, d)[0].select("row", "col")), config.class_dim(s), crs="EPSG:32720")


def change_map_rgb(s, d):
    return change.change_map(_changed(s, d))


def change_gated(s, d):
    """Three confidence gates over one join of the dates."""
    gates = _changed(s, d, 0.0, SHARP).withColumn("min_conf", F.explode(F.lit([0.0, 0.5, 0.7])))
    return change.change_summary(change.gated(gates, F.col("min_conf")), ("min_conf",))


def land_cover_transition(s, d):
    return change.transitions(_changed(s, d))


def zonal_loss_fraction(s, d):
    return _fractions(s, d).select("row", "col", "n_px", F.round("loss_frac", 6).alias("loss_frac"))


def zonal_box_join(s, d):
    """Overlapping boxes of 12 x 12 pixels at a step of 8 over a raster of orders."""
    raster = _read(s, d, "orders").select(F.floor(F.col("o_orderkey") / 300).cast("int").alias("pr"), (F.col("o_orderkey") % 300).cast("int").alias("pc"), F.year("o_orderdate").alias("year"))
    cells = _cell(_read(s, d, "embeddings").select("vec_id")).select("row", "col", (F.col("row") * 8 - 2).alias("r0"), (F.col("row") * 8 + 10).alias("r1"), (F.col("col") * 8 - 2).alias("c0"), (F.col("col") * 8 + 10).alias("c1"))
    out = zonal.loss_fraction(cells, raster, (F.col("year") > YEAR_A) & (F.col("year") <= YEAR_B), block=16)
    return out.select("row", "col", "n_px", F.round("loss_frac", 6).alias("loss_frac"))


def reference_cells(s, d):
    return zonal.reference_cells(_fractions(s, d), 0.25).select("row", "col", "ref")


def score_metrics(s, d):
    pairs = _changed(s, d).select("row", "col", "change").join(zonal.reference_cells(_fractions(s, d), 0.5).select("row", "col", "ref"), ["row", "col"], "left").fillna(False, ["ref"])
    return metrics.detection_scores(metrics.detection_counts(pairs))


def score_json(s, d):
    return tables.as_json(score_metrics(s, d))


def change_by_scene(s, d):
    """Three scenes in one job, each date under names of its own, paired by a table."""
    pairs = s.createDataFrame([(f"a{k}", f"b{k}") for k in range(3)], "scene_a string, scene_b string")
    a, b = (x.withColumn("scene_id", F.concat(F.lit(n), ((F.col("row") * 25 + F.col("col")) % 3).cast("string"))) for n, x in zip("ab", _dates(s, d), strict=True))
    keys = ("scene_id", "row", "col")
    return change.change_summary(change.change_cells(a, change.paired(b, pairs), keys), ("scene_id",))


def confusion_long(s, d):
    return metrics.confusion_long(_pairs(s, d))


def confusion_matrix(s, d):
    return metrics.confusion_matrix(_pairs(s, d), config.class_dim(s), 10)


def classification_report(s, d):
    return metrics.classification_report(_pairs(s, d), config.class_dim(s))


def accuracy(s, d):
    out = metrics.accuracy(_pairs(s, d))
    return out.select(F.round("accuracy", 6).alias("accuracy"), "n")


def cross_entropy(s, d):
    rows = _read(s, d, "embeddings").select(_logits(0).alias("logits"), "label")
    out = metrics.mean_cross_entropy(rows, F.col("logits"), F.col("label"))
    return out.select(F.round("loss", 6).alias("loss"), "n")


def weighted_loss(s, d):
    batches = _read(s, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_discount").alias("loss"), F.count("*").alias("n"))
    return metrics.weighted_mean_loss(batches, ("l_returnflag",)).select("l_returnflag", F.round("loss", 6).alias("loss"), "n")


def trainable_parameters(s, d):
    return metrics.trainable_parameters(_read(s, d, "part").select(F.col("p_size").cast("long").alias("numel"), (F.col("p_partkey") % 3 == 0).alias("requires_grad")))


def seeded_split(s, d):
    return sampling.exact_split(_read(s, d, "embeddings").select("vec_id"), "vec_id")


def split_class_balance(s, d):
    return sampling.exact_split(_read(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("split", "label").agg(F.count("*").alias("n"))


def mini_batches(s, d):
    rows = sampling.epoch_order(_read(s, d, "embeddings").select("vec_id"), "vec_id", 3)
    return sampling.batches(rows, "place", "vec_id", 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("vec_id").alias("last_id"))


def epoch_shuffle(s, d):
    return sampling.epoch_order(_read(s, d, "embeddings").select("vec_id"), "vec_id", 3)


def best_epoch(s, d):
    return sampling.best_epoch(_history(s, d)).select("seq", F.round("val_acc", 6).alias("val_acc"))


def running_best(s, d):
    return sampling.running_best(_history(s, d)).select("seq", F.round("val_acc", 6).alias("val_acc"), "is_best")


def median_composite(s, d):
    out = radiometry.median_composite(_cube(s, d), ("period", "x", "band"))
    return out.select("period", "x", "band", F.round("median", 6).alias("median"), "n_dates")


def bbox_time_filter(s, d):
    return tables.cube_filter(_cube(s, d).withColumn("y", F.col("x") % 50), "2024-01-05", "2024-01-20", ("click", "view", "purchase"), 20.0, (10, 5, 120, 40)).select("event_id", "x", "band")


def scene_extent(s, d):
    return zonal.scene_extent(_bounds(_dates(s, d)[0]))


def normalize_channels(s, d):
    """Each vector as 21 pixels of three channels."""
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("embedding", i * 3 + 1, 3), lambda v: v.cast("double")))).alias("x", "v")
    out = _read(s, d, "embeddings").select("vec_id", cut).withColumn("z", pixels.normalised(F.col("v")))
    return out.select("vec_id", "x", *[F.round(F.get("z", F.lit(i)), 6).alias(c) for i, c in enumerate("rgb")])


def to_tensor(s, d):
    raw = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("vec_id") * 7 + i * 31) % 256).cast("double"))
    rows = _read(s, d, "embeddings").select("vec_id", raw.alias("v")).withColumn("t", pixels.planar(F.col("v"))).withColumn("u", pixels.unit(F.col("t")))
    return rows.select("vec_id", *[F.round(F.get("u", F.lit(i)), 6).alias(f"t{i}") for i in (0, 3, 4, 7, 11)])


def flip_augment(s, d):
    """The raster cut into patches of 64 rows, each mirrored by coins of its own; the last one may be lower."""
    height = _read(s, d, "embeddings").agg(F.count("*").cast("int").alias("height"))
    pix = _raster(s, d).crossJoin(F.broadcast(height)).withColumns({"patch": F.floor(F.col("y") / 64).cast("int"), "py": F.col("y") % 64})
    size = F.least(F.lit(64), F.col("height") - F.col("patch") * 64)
    wide, tall = (pixels.coin(42, F.lit(1), F.col("patch"), c) for c in "hv")
    return pix.select("y", "x", "band", (F.col("patch") * 64 + pixels.flipped(F.col("py"), size, tall)).alias("to_y"), pixels.flipped(F.col("x"), 21, wide).alias("to_x"))


def split_transform(s, d):
    """The composed transform of rows of 21 pixels: training rows are mirrored by coins of their own, all
    become unit tensors and are normalised."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: ((F.col("vec_id") * 7 + i * 31) % 256).cast("double"))
    rows = sampling.exact_split(_read(s, d, "embeddings").select("vec_id"), "vec_id").withColumn("v", raw)
    made = rows.withColumn("t", pixels.transformed(F.col("v"), 1, 21, F.col("split") == "train", 42, F.lit(2), F.col("vec_id")))
    return made.select("vec_id", "split", F.posexplode("t").alias("i", "t")).withColumn("t", F.round("t", 6))


def resize_bilinear(s, d):
    """Ramps of 8 x 8 pixels to 16 x 16, as hexadecimal bytes."""
    ramp = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: (F.col("vec_id") % 50 + F.floor(i / 24) * 8 + F.floor(i % 24 / 3) * 3 + i % 3 * 20))
    hexed = F.unhex(F.array_join(F.transform(ramp, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    made = _read(s, d, "embeddings").select("vec_id", hexed.alias("p")).withColumn("q", pixels.resize_udf(8, 8, 16, 16)("p"))
    return made.select("vec_id", F.hex("q").alias("q"))


def predict_batch(s, d):
    vec = _read(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("x"))
    out = inference.infer(vec, "x", inference.linear_model(np.array(WEIGHTS), np.array(BIAS)), 8)
    return out.select("vec_id", vectors.argmax(F.col("logits")).alias("pred"), F.round(F.get("logits", F.lit(9)).cast("double"), 3).alias("logit9"))


def softmax_head_fit(s, d):
    rows = inference.head_features(sampling.exact_split(_read(s, d, "embeddings"), "vec_id"), "embedding", "label")
    model = inference.fit_head(rows.where("split = 'train'"), 20)
    return inference.predict(model, rows).groupBy("split").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def labelled_folder(s, d):
    return images.labelled(_files(s, d)).select("path", "class_name", "label")


def folder_class_counts(s, d):
    return images.class_counts(images.labelled(_files(s, d)), config.class_dim(s))


def folder_class_root(s, d):
    """Folders of nations; a root is one whose subfolders include the five regions."""
    regions = _read(s, d, "region").select("r_regionkey", "r_name")
    nations = _read(s, d, "nation").select("n_nationkey")
    made = nations.crossJoin(F.broadcast(regions)).where("n_nationkey % 4 = 0 OR r_regionkey < 4")
    names = tuple(r["r_name"] for r in regions.collect())  # five rows
    return images.class_root(made.select(F.concat(F.lit("/data/n"), F.col("n_nationkey"), F.lit("/"), F.col("r_name")).alias("path")), names)


def loss_year_window(s, d):
    years = _read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).cast("int").alias("lossyear"))
    return years.select("o_orderkey", zonal.in_window(F.col("lossyear"), 2001, 2016).alias("lost"))


def pixel_index_ranges(s, d):
    cells = _bounds(_cell(_read(s, d, "embeddings").select("vec_id")))
    affine = F.struct(F.lit(30.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1000.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-30.0).alias("e"), F.lit(8999000.0).alias("f"))
    box = [F.col(c) for c in ("left", "bottom", "right", "top")]
    return cells.withColumn("p", geo.pixel_range(*box, affine, F.lit(300), F.lit(400))).select("row", "col", "p.*")


def raster_window(s, d):
    raster = _read(s, d, "orders").select(F.floor(F.col("o_orderkey") / 300).cast("int").alias("pr"), (F.col("o_orderkey") % 300).cast("int").alias("pc"))
    return zonal.raster_window(raster, 2, 4, 50, 200)


def utm_project(s, d):
    places = _read(s, d, "embeddings").select("vec_id", (F.lit(-66.0) + (F.col("vec_id") % 61) / 10).alias("lon"), (F.lit(-12.0) + (F.col("vec_id") % 97) / 8).alias("lat"))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 20, True)
    back = places.withColumns({"x": x, "y": y})
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), 20, True)
    return back.select("vec_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def head_history(s, d):
    """Two phases of training on the smallest split; the flag follows the running best."""
    from geoloom.plans.pipelines import train

    rows = _read(s, d, "embeddings")
    _, history = train(rows, "vec_id", "embedding", "label", 64, 10, (2, 5), (10,))
    return history.select("seq", "phase", "epoch", "val_acc", "is_best")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        change_sweep, band_moments, moment_match, window_counts, window_bounds, softmax_argmax, grid_densify, class_histogram, change_cells, change_events,
        change_map_rgb, change_gated, land_cover_transition, zonal_loss_fraction, zonal_box_join, reference_cells, score_metrics, score_json, change_by_scene, confusion_long,
        confusion_matrix, classification_report, accuracy, cross_entropy, weighted_loss, trainable_parameters, seeded_split, split_class_balance, mini_batches,
        epoch_shuffle, best_epoch, running_best, median_composite, bbox_time_filter, scene_extent, normalize_channels, to_tensor, flip_augment, split_transform,
        resize_bilinear, predict_batch, softmax_head_fit, labelled_folder, folder_class_counts, folder_class_root, loss_year_window, pixel_index_ranges,
        raster_window, utm_project, head_history,
    ]
    found = {f.__name__: f for f in plain}
    found["tile_windows_tumbling"] = lambda s, d: _windows(s, d, 8)
    found["tile_windows_sliding"] = lambda s, d: _windows(s, d, 4)
    found["tile_windows_gapped"] = lambda s, d: _windows(s, d, 11)
    return found
