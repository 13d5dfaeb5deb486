"""Hand-made cases of grids, change, zones and scores."""

import pytest
from pyspark.sql import functions as F

from geoloom import config
from geoloom.operators import change, grid, metrics, zonal
from geoloom.plans import pipelines

GRID = "row int, col int, label int, conf double"


def cells(spark, *rows):
    return spark.createDataFrame(rows, GRID)


def changed(spark, a, b, min_conf=0.0):
    out = change.change_cells(cells(spark, *a), cells(spark, *b), min_conf=min_conf)
    return {(r.row, r.col): (r.was_forest, r.change) for r in out.collect()}


def test_empty_label_is_never_forest_or_target(spark):
    got = changed(spark, [(0, 0, -1, 0.0), (0, 1, 1, 0.9)], [(0, 0, 0, 0.9), (0, 1, -1, 0.0)])
    assert got == {(0, 0): (False, False), (0, 1): (True, False)}


def test_confidence_equal_to_the_gate_passes(spark):
    assert changed(spark, [(0, 0, 1, 0.7)], [(0, 0, 0, 0.7)], 0.7) == {(0, 0): (True, True)}
    assert changed(spark, [(0, 0, 1, 0.6999)], [(0, 0, 0, 0.9)], 0.7) == {(0, 0): (False, False)}


@pytest.mark.parametrize("label", range(10))
def test_only_target_classes_are_change(spark, label):
    name = config.CLASS_NAMES[label]
    assert changed(spark, [(0, 0, 1, 1.0)], [(0, 0, label, 1.0)])[0, 0][1] == (name in config.TARGET_CLASSES)


def test_different_grids_are_refused(spark):
    with pytest.raises(ValueError):
        pipelines.detect(cells(spark, (0, 0, 1, 1.0)), cells(spark, (0, 1, 1, 1.0)))


def test_map_paints_change_over_forest(spark):
    made = change.change_cells(cells(spark, (0, 0, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 9, 1.0)), cells(spark, (0, 0, 0, 1.0), (0, 1, 1, 1.0), (0, 2, 9, 1.0)))
    got = {r.col: (r.r, r.g, r.b) for r in change.change_map(made).collect()}
    assert got == {0: change.RED, 1: change.GREEN, 2: change.GREY}


def test_percent_without_forest_is_zero(spark):
    made = change.change_cells(cells(spark, (0, 0, 9, 1.0)), cells(spark, (0, 0, 0, 1.0)))
    assert change.change_summary(made).first().asDict() == {"n_forest": 0, "n_change": 0, "percent": 0.0}


def test_densify_fills_and_last_write_wins(spark):
    predictions = spark.createDataFrame([(0, 0, 3, 0.5, 1), (0, 0, 4, 0.6, 2)], f"{GRID}, at int")
    got = grid.densify(predictions, spark.createDataFrame([(0, 0), (0, 1)], "row int, col int"), order="at")
    assert {(r.row, r.col): (r.label, r.conf) for r in got.collect()} == {(0, 0): (4, 0.6), (0, 1): (-1, 0.0)}


def test_loss_years_exclude_the_first_and_include_the_last(spark):
    years = spark.createDataFrame([(n,) for n in (0, 16, 17, 24, 25)], "n int")
    got = [r[0] for r in years.select(zonal.in_window(F.col("n"), 2016, 2024)).collect()]
    assert got == [False, False, True, True, False]
    with pytest.raises(ValueError):
        zonal.loss_window(1999, 2010)


def test_threshold_is_strict_and_empty_cells_are_not_lost(spark):
    fractions = spark.createDataFrame([(0, 0, 4, 0.25), (0, 1, 4, 0.26), (0, 2, 0, None)], "row int, col int, n_px long, loss_frac double")
    assert [r.ref for r in zonal.reference_cells(fractions, 0.25).orderBy("col").collect()] == [False, True, False]


def test_overlapping_boxes_share_pixels_and_off_raster_boxes_are_empty(spark):
    raster = spark.createDataFrame([(r, c, 5 if r < 2 else 0) for r in range(4) for c in range(4)], "pr int, pc int, lossyear int")
    boxes = spark.createDataFrame([(0, 0, 0, 2, 0, 2), (0, 1, 1, 3, 1, 3), (0, 2, 9, 9, 0, 4), (0, 3, 3, 9, 0, 9)], "row int, col int, r0 int, r1 int, c0 int, c1 int")
    got = {r.col: (r.n_px, r.loss_frac) for r in zonal.loss_fraction(boxes, raster, F.col("lossyear") > 0, block=2).collect()}
    assert got == {0: (4, 1.0), 1: (4, 0.5), 2: (0, None), 3: (4, 0.0)}


def test_scores_without_any_cell_are_zero(spark):
    pairs = spark.createDataFrame([(False, False)], "change boolean, ref boolean")
    got = metrics.detection_scores(metrics.detection_counts(pairs)).first()
    assert (got.precision, got.recall, got.f1, got.iou) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(("tp", "detected", "reference", "want"), [(30, 34, 907, (0.8824, 0.0331, 0.0638, 0.0329)), (15, 34, 116, (0.4412, 0.1293, 0.2, 0.1111)), (8, 34, 35, (0.2353, 0.2286, 0.2319, 0.1311)), (5, 34, 7, (0.1471, 0.7143, 0.2439, 0.1389))])
def test_published_scores(spark, tp, detected, reference, want):
    counts = spark.createDataFrame([(detected, reference, tp, detected - tp, reference - tp)], "detected_cells long, reference_cells long, true_positives long, false_positives long, false_negatives long")
    got = metrics.detection_scores(counts).first()
    assert (got.precision, got.recall, got.f1, got.iou) == want


def test_align_and_score_gives_one_row(spark):
    made = spark.createDataFrame([(0, 0, True, 0, 2, 0, 2), (0, 1, False, 0, 2, 2, 4)], "row int, col int, change boolean, r0 int, r1 int, c0 int, c1 int")
    raster = spark.createDataFrame([(r, c, 18 if c == 0 else 0) for r in range(2) for c in range(4)], "pr int, pc int, lossyear int")
    got = pipelines.align_and_score(made, raster, 2016, 2024, 0.25).first()
    assert (got.model_detected_cells, got.gfw_reference_cells, got.true_positives, got.precision, got.iou) == (1, 1, 1, 1.0, 1.0)
    assert len(got) == 12


def test_report_has_absent_classes(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, class_name string")
    got = {r.name: (r.precision, r.recall, r.f1, r.support) for r in metrics.classification_report(pairs, classes).collect()}
    assert got["c"] == (0.0, 0.0, 0.0, 0)
    assert got["a"] == (1.0, 0.5, 0.6667, 2)
    assert got["accuracy"][0] == 0.6667
    assert got["macro avg"][0] == 0.5
