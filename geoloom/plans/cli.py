"""Command line of the pipelines: python -m geoloom.plans.cli <step> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from geoloom import config
from geoloom.operators import change, radiometry
from geoloom.plans import pipelines
from geoloom.sources import arrays, geotiff, images, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="geoloom")
    steps = top.add_subparsers(dest="step", required=True)
    p = steps.add_parser("patchify", help="GeoTIFF scenes to matched patches")
    p.add_argument("tif")
    p.add_argument("out")
    p.add_argument("--stride", type=int, default=config.PATCH)
    p = steps.add_parser("layout", help="move the class folders found under a folder to their place and count their images")
    p.add_argument("found")
    p.add_argument("out")
    p = steps.add_parser("composite", help="median composite of a stored cube (Parquet), one GeoTIFF or folder per period")
    p.add_argument("cube")
    p.add_argument("out")
    p.add_argument("--start", required=True)
    p.add_argument("--end", required=True)
    p.add_argument("--bands", nargs="+")
    p.add_argument("--max-cloud", type=float, default=tables.MAX_CLOUD)
    p.add_argument("--box", type=float, nargs=4, metavar=("LEFT", "BOTTOM", "RIGHT", "TOP"))
    p.add_argument("--tif", type=float, nargs=3, metavar=("LEFT", "TOP", "SIZE"), help="write GeoTIFF with this corner and pixel size")
    p.add_argument("--epsg", type=int, default=0)
    p = steps.add_parser("features", help="an image folder to a table (id, features, label)")
    p.add_argument("root")
    p.add_argument("out")
    p = steps.add_parser("train", help="fit the head on a table (id, features, label) and save the best model")
    p.add_argument("table")
    p.add_argument("out")
    p.add_argument("--seed", type=int, default=config.SEED)
    p = steps.add_parser("evaluate", help="report of a saved model on the test rows")
    p.add_argument("table")
    p.add_argument("model")
    p.add_argument("out")
    p.add_argument("--seed", type=int, default=config.SEED)
    p = steps.add_parser("classify", help="patches of pixels (or with features) to a land-cover grid")
    p.add_argument("patches")
    p.add_argument("model")
    p.add_argument("out")
    p = steps.add_parser("detect", help="two land-cover grids to change cells and events")
    p.add_argument("grid_a")
    p.add_argument("grid_b")
    p.add_argument("out")
    p.add_argument("--min-conf", type=float, default=0.0)
    p.add_argument("--pair", nargs=2, action="append", metavar=("SCENE_A", "SCENE_B"), help="scenes that belong together; once for each pair")
    p = steps.add_parser("score", help="change cells against a loss-year raster")
    p.add_argument("mask")
    p.add_argument("raster")
    p.add_argument("--year-a", type=int, required=True)
    p.add_argument("--year-b", type=int, required=True)
    p.add_argument("--zone", type=int, help="UTM zone of the cells, if the raster is geographic")
    p.add_argument("--north", action="store_true")
    p.add_argument("--min-loss-frac", type=float, default=0.0)
    p.add_argument("--out-json")
    p.add_argument("--per-scene", action="store_true", help="a row of scores for each scene")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.step == "patchify":
        pipelines.patchify(spark, a.tif, a.stride).write.mode("overwrite").parquet(a.out)
    elif a.step == "layout":
        root = images.find_class_root(a.found)
        images.relocate(str(root), a.out, scratch=a.found)
        counts = images.class_counts(images.labelled(images.list_files(spark, a.out)), config.class_dim(spark))
        counts.orderBy("label").show()
        if warning := images.count_warning(counts.agg(F.sum("n")).first()[0]):
            print(warning)
    elif a.step == "composite":
        cube = tables.read_cube(spark, a.cube, a.start, a.end, bands=a.bands, max_cloud=a.max_cloud, box=a.box)
        made = radiometry.median_composite(cube, ("period", "y", "x", "band"))
        if a.tif:
            left, top, size = a.tif
            names = a.bands or sorted(r[0] for r in made.select("band").distinct().collect())  # a few bands
            numbered = made.withColumns({"band": F.array_position(F.lit(names), F.col("band")).cast("int") - 1, "value": F.col("median")})
            geotiff.write_scene_files(geotiff.scene_files(numbered, (size, 0.0, left, 0.0, -size, top), a.epsg, ("period",)), a.out, "period")
        else:
            tables.write_composite(made, a.out, "period")
    elif a.step == "features":
        pipelines.labelled_features(spark, a.root).write.mode("overwrite").parquet(a.out)
    elif a.step == "train":
        rows = spark.read.parquet(a.table)
        size = rows.select(F.size("features")).first()[0]
        classes = rows.agg(F.max("label")).first()[0] + 1
        model, history = pipelines.train(rows, "id", "features", "label", size, classes, seed=a.seed, save_to=a.out)
        if not history.where("is_best").count():  # nothing was better than 0, so nothing is saved yet
            pipelines.save_checkpoint(model, 0.0, a.out, spark)
        tables.write_json(history, f"{a.out}/history")
    elif a.step == "evaluate":
        model, _, names = pipelines.load_checkpoint(a.model, spark)
        _, report, matrix = pipelines.evaluate(model, spark.read.parquet(a.table), "id", "features", "label", config.class_dim(spark, tuple(names)), a.seed)
        tables.write_report(report, f"{a.out}/report")
        tables.write_json(matrix, f"{a.out}/confusion")
    elif a.step == "classify":
        model, _, _ = pipelines.load_checkpoint(a.model, spark)
        pipelines.classify_patches(spark.read.parquet(a.patches), model).write.mode("overwrite").parquet(a.out)
    elif a.step == "detect":
        read = [arrays.read_grid(spark, p) if p.endswith(".npz") else spark.read.parquet(p) for p in (a.grid_a, a.grid_b)]
        read = [r.withColumn("conf", F.col("conf").cast("double")) for r in read]
        pairs = spark.createDataFrame(a.pair, "scene_a string, scene_b string") if a.pair else None
        keys = ("scene_id", "row", "col") if a.pair else ("row", "col")
        pipelines.detect(*read, a.min_conf, keys, pairs=pairs).write.mode("overwrite").parquet(f"{a.out}/cells")
        changed = spark.read.parquet(f"{a.out}/cells")
        bounds = read[0].select(*keys, "left", "bottom", "right", "top")
        crs = read[0].select("crs").first()
        events = change.change_events(changed.select(*keys, "change", "label_a", "label_b"), bounds, config.class_dim(spark), keys, crs["crs"] if crs else "")
        tables.write_events(events, f"{a.out}/events", keys)
        change.change_summary(changed, keys[:-2]).show()
    else:
        cells = arrays.read_mask(spark, a.mask) if a.mask.endswith(".npz") else spark.read.parquet(a.mask)
        about = geotiff.read_scenes(spark, a.raster).first()
        boxed = pipelines.pixel_boxes(cells, about["transform"].asDict(), about["height"], about["width"], a.zone, not a.north)
        hull = boxed.agg(F.min("r0"), F.max("r1"), F.min("c0"), F.max("c1")).first()
        raster = geotiff.read_raster(spark, a.raster, tuple(hull)).withColumnRenamed("value", "lossyear")
        several = "scene_id" in boxed.columns
        scores = pipelines.align_and_score(boxed, raster, a.year_a, a.year_b, a.min_loss_frac, *((("scene_id", "row", "col"), ("scene_id",)) if several and a.per_scene else ()))
        scores.show()
        if a.out_json:
            tables.write_json(scores, a.out_json)


if __name__ == "__main__":
    main()
