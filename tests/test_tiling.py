"""Windows, radiometry, splits, history, pixels and projection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, pixels, vectors
from geoloom.operators import radiometry, sampling, tiling


@pytest.mark.parametrize(("height", "width", "stride", "want"), [(2743, 2433, 64, 1596), (2743, 2433, 32, 6300), (64, 64, 64, 1), (63, 64, 64, 0), (100, 70, 7, 6), (300, 300, 96, 9)])
def test_window_counts(spark, height, width, stride, want):
    n = spark.range(1).select(tiling.n_windows(F.lit(height), 64, stride).alias("r"), tiling.n_windows(F.lit(width), 64, stride).alias("c")).first()
    assert n.r * n.c == want == len(range(0, height - 63, stride)) * len(range(0, width - 63, stride))


def test_positions_between_gapped_windows_have_none(spark):
    got = spark.range(20).select("id", tiling.window_indexes(F.col("id"), F.lit(20), 4, 7).alias("w")).collect()
    assert {r.id: r.w for r in got if r.w} == {**{i: [0] for i in range(4)}, **{i: [1] for i in range(7, 11)}, **{i: [2] for i in range(14, 18)}}


@pytest.mark.parametrize("stride", [8, 4, 11])
def test_strips_and_long_pixels_agree(spark, stride):
    rng = np.random.default_rng(1)
    scene = rng.integers(0, 256, (37, 29, 3)).astype(np.uint8)
    strips = spark.createDataFrame([("s", 37, 29, y, len(scene[y : y + 5]), bytearray(scene[y : y + 5].tobytes())) for y in range(0, 37, 5)], "scene_id string, height int, width int, y0 int, n_rows int, data binary")
    patches = {(r.row, r.col): np.frombuffer(bytes(r.pixels), np.uint8).reshape(8, 8, 3) for r in tiling.patch_strips(strips, 8, stride).collect()}
    want = {(i, j): scene[y : y + 8, x : x + 8] for i, y in enumerate(range(0, 30, stride)) for j, x in enumerate(range(0, 22, stride))}
    assert patches.keys() == want.keys()
    assert all((patches[k] == want[k]).all() for k in want)
    long = spark.createDataFrame([("s", y, x, int(scene[y, x, 0])) for y in range(37) for x in range(29)], "scene_id string, y int, x int, value int")
    means = {(r.row, r.col): (r.n_px, r.mean) for r in tiling.window_means(long, F.lit(37), F.lit(29), 8, stride).collect()}
    assert {k: (64, pytest.approx(float(v[..., 0].mean()))) for k, v in want.items()} == means


def test_constant_band_maps_to_the_target_mean(spark):
    rows = [("s", y, x, b, 512.0) for y in range(4) for x in range(4) for b in range(3)]
    got = radiometry.moment_match(spark.createDataFrame(rows, "scene_id string, y int, x int, band int, value float")).select("band", "byte").distinct().collect()
    assert sorted((r.band, r.byte) for r in got) == [(0, 86), (1, 96), (2, 103)]


def test_matching_equals_numpy(spark):
    rng = np.random.default_rng(0)
    value = rng.gamma(2.0, 400.0, 900).astype(np.float32)
    rows = [("s", i // 30, i % 30, 0, float(v)) for i, v in enumerate(value)]
    got = radiometry.moment_match(spark.createDataFrame(rows, "scene_id string, y int, x int, band int, value float")).orderBy("y", "x").collect()
    scaled = (value.astype(np.float64) - value.mean(dtype=np.float64)) / (value.std(dtype=np.float64) + 1e-6) * 49.7 + 86.4
    assert [r.byte for r in got] == np.clip(scaled, 0, 255).astype(np.uint8).tolist()


def test_bytes_are_clipped_truncated_and_nan_is_zero(spark):
    got = spark.createDataFrame([(-3.0,), (0.9,), (254.99,), (300.0,), (float("nan"),), (None,)], "v double").select(pixels.to_byte(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 254, 255, 0, None]


def test_softmax_survives_large_logits_and_ties_go_first(spark):
    row = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "x array<double>").select(vectors.softmax(F.col("x")).alias("p"), vectors.argmax(F.col("x")).alias("k"), vectors.top_probability(F.col("x")).alias("t")).first()
    assert row.p == [0.5, 0.5, 0.0]
    assert (row.k, row.t) == (0, 0.5)


@pytest.mark.parametrize(("n", "want"), [(27_000, (21_600, 2_700, 2_700)), (7, (5, 0, 2)), (1, (0, 0, 1)), (0, (0, 0, 0))])
def test_split_sizes(spark, n, want):
    counts = {r.split: r["count"] for r in sampling.exact_split(spark.range(n), "id").groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == want


def test_split_does_not_depend_on_partitions(spark):
    a, b = (dict(sampling.exact_split(spark.range(500).repartition(k), "id").collect()) for k in (1, 7))
    assert a == b
    assert a != dict(sampling.exact_split(spark.range(500), "id", seed=7).collect())


def test_best_epoch_is_the_earliest_of_equals(spark):
    history = spark.createDataFrame([(0, "head", 0.5), (1, "head", 0.9), (2, "fine", 0.9), (3, "fine", 0.7)], "seq int, phase string, val_acc double")
    assert sampling.best_epoch(history).first().seq == 1
    assert [r.is_best for r in sampling.running_best(history).orderBy("seq").collect()] == [True, True, False, False]
    assert sampling.best_epoch(history.withColumn("val_acc", F.lit(0.0))).count() == 0


def test_batches_keep_the_last_one(spark):
    got = sampling.batches(sampling.epoch_order(spark.range(10), "id", 1), "place", "id", 4).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [4, 4, 2]


def test_flips_are_a_reversal(spark):
    got = spark.range(5).select(pixels.flipped(F.col("id"), 5, F.lit(True)).alias("a"), pixels.flipped(F.col("id"), 5, F.lit(False)).alias("b")).collect()
    assert [r.a for r in got] == [4, 3, 2, 1, 0]
    assert [r.b for r in got] == [0, 1, 2, 3, 4]


def test_resize_keeps_constants_and_ramps():
    assert (pixels.resize(np.full((64, 64, 3), 77, np.uint8), 224, 224) == 77).all()
    ramp = np.repeat(np.arange(0, 256, 4, dtype=np.uint8)[None, :, None], 64, 0)
    out = pixels.resize(ramp, 224, 224)
    assert out.shape == (224, 224, 1)
    assert (np.diff(out[0, :, 0].astype(int)) >= 0).all()
    assert out[0, 0, 0] == 0
    assert out[0, -1, 0] == 252
    centre = (np.arange(224) + 0.5) * 64 / 224 - 0.5
    assert np.abs(out[0, :, 0] - np.clip(centre, 0, 63) * 4).max() <= 0.5


@pytest.mark.parametrize("south", [True, False])
def test_projection_round_trip(spark, south):
    places = spark.createDataFrame([(-63.0, 0.0), (-61.2, -9.7), (-65.9, 5.5), (-63.0, 60.0)], "lon double, lat double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 20, south)
    there = places.withColumns({"x": x, "y": y})
    lon, lat = geo.from_utm(F.col("x"), F.col("y"), 20, south)
    for r in there.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert math.isclose(r.lon, r.lon2, abs_tol=1e-8)
        assert math.isclose(r.lat, r.lat2, abs_tol=1e-8)
        if r.lon == -63.0:
            assert math.isclose(r.x, 500_000.0, abs_tol=1e-6)


def test_meridian_arc(spark):
    """Along the central meridian the northing is the scaled arc of the ellipse."""
    _, y = geo.to_utm(F.lit(-63.0), F.lit(45.0), 20)
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(45), 200_001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    assert math.isclose(spark.range(1).select(y.alias("y")).first().y, 0.9996 * arc, abs_tol=1e-3)


def test_pixel_range_is_clamped(spark):
    affine = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (10.0, 0.0, 0.0, 0.0, -10.0, 100.0), strict=True)])
    boxes = spark.createDataFrame([(-25.0, 85.0, 15.0, 200.0), (500.0, 0.0, 600.0, 50.0)], "l double, b double, r double, t double")
    got = [tuple(r.p) for r in boxes.select(geo.pixel_range(F.col("l"), F.col("b"), F.col("r"), F.col("t"), affine, F.lit(10), F.lit(10)).alias("p")).collect()]
    assert got[0] == (0, 1, 0, 1)
    assert got[1][:2] == (5, 10)
