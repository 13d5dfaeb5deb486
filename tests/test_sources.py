"""Files: images, GeoTIFF, archives, sinks, checkpoints, the command line."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import config
from geoloom.plans import cli, pipelines
from geoloom.sources import arrays, geotiff, images, tables


def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    pictures = {}
    for i, name in enumerate(config.CLASS_NAMES):
        (tmp_path / "in" / name).mkdir(parents=True)
        for k in range(1 + i % 3):
            pictures[name, k] = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
            (tmp_path / "in" / name / f"{k}.png").write_bytes(png(pictures[name, k]))
    (tmp_path / "in" / "Forest" / "note.txt").write_text("x")
    return tmp_path / "in", pictures


def test_image_folder(spark, folder):
    root, pictures = folder
    read = images.read_image_folder(spark, str(root))
    got = {r.path.rsplit("/", 2)[-2]: r.label for r in read.select("path", "label").collect()}
    assert got == {n: i for i, n in enumerate(config.CLASS_NAMES)}
    assert read.count() == len(pictures)
    with pytest.raises(ValueError):
        images.read_image_folder(spark, str(root), ("Forest",))
    decoded = {tuple(r.path.rsplit("/", 2)[-2:]): np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width, 3) for r in images.read_decoded(spark, str(root)).collect()}
    assert all((decoded[n, f"{k}.png"] == p).all() for (n, k), p in pictures.items())


def test_class_root_and_layout(folder, tmp_path):
    root, _ = folder
    assert images.find_class_root(str(tmp_path)) == root
    images.relocate(str(root), str(tmp_path / "out"))
    images.relocate(str(root), str(tmp_path / "out"))
    assert images.find_class_root(str(tmp_path / "out")) == tmp_path / "out"
    with pytest.raises(RuntimeError):
        images.find_class_root(str(tmp_path / "out" / "Forest"))
    assert images.count_warning(27_000) is None
    assert images.count_warning(3)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32"])
@pytest.mark.parametrize("deflate", [True, False])
def test_geotiff_round_trip(dtype, deflate):
    bands = (np.random.default_rng(2).random((3, 70, 41)) * 100).astype(dtype)
    array, affine, crs = geotiff.decode(geotiff.encode(bands, (10.0, 0.0, 5.0, 0.0, -10.0, 9.0), 32720, deflate=deflate))
    assert (array == bands).all()
    assert affine == (10.0, 0.0, 5.0, 0.0, -10.0, 9.0)
    assert crs == "EPSG:32720"


def packed_lzw(data):
    """The format's own encoder, for the reader."""
    codes, table, width, out, omega = [], {}, 9, [], b""

    def reset():
        nonlocal width
        table.clear()
        table.update({bytes([i]): i for i in range(256)})
        width = 9

    def emit(code):
        out.append((code, width))

    emit(256)
    reset()
    n = 258
    for byte in data:
        more = omega + bytes([byte])
        if more in table:
            omega = more
            continue
        emit(table[omega])
        table[more] = n
        n += 1
        width = 9 if n <= 511 else 10 if n <= 1023 else 11 if n <= 2047 else 12
        omega = bytes([byte])
        if n == 4095:
            emit(table[omega])
            emit(256)
            reset()
            n, omega = 258, b""
    if omega:
        emit(table[omega])
        n += 1
        width = 9 if n <= 511 else 10 if n <= 1023 else 11 if n <= 2047 else 12
    emit(257)
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def rewritten(raw, pack, compression=None, predictor=None, tile=None):
    """A file of ``encode`` (no compression) with its strips predicted and packed anew."""
    h = geotiff.header(raw)
    _, tag = geotiff._tags(raw)
    blocks = []
    for y in range(0, h.height, h.block_h):
        block = np.frombuffer(raw, h.dtype, min(h.block_h, h.height - y) * h.width * h.n_bands, h.offsets[y // h.block_h]).reshape(-1, h.width, h.n_bands)
        if predictor == 2:
            block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
        data = block.tobytes()
        if predictor == 3:
            size = h.dtype.itemsize
            planes = np.frombuffer(block.astype(h.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(block), -1, size).transpose(0, 2, 1).reshape(len(block), -1)
            line = planes.astype(np.int16)
            line[:, h.n_bands :] -= planes[:, : -h.n_bands].astype(np.int16)
            data = (line & 255).astype(np.uint8).tobytes()
        blocks.append(pack(data))
    tags = {k: v for k, v in tag.items()} | {geotiff.COMPRESSION: (compression,), geotiff.PREDICTOR: (predictor or 1,), geotiff.COUNTS: tuple(map(len, blocks))}
    at, offsets = 8, []
    for x in blocks:
        offsets.append(at)
        at += len(x)
    tags[geotiff.OFFSETS] = tuple(offsets)
    form = {geotiff.WIDTH: "I", geotiff.HEIGHT: "I", geotiff.OFFSETS: "I", geotiff.COUNTS: "I", geotiff.ROWS_PER_STRIP: "I", geotiff.PIXEL_SCALE: "d", geotiff.TIE_POINT: "d"}
    entries, extra, after = b"", b"", at + 2 + 12 * len(tags) + 4
    for k in sorted(tags):
        f = form.get(k, "H")
        data = struct.pack("<" + f * len(tags[k]), *tags[k])
        code = {"H": 3, "I": 4, "d": 12}[f]
        if len(data) > 4:
            entries += struct.pack("<HHII", k, code, len(tags[k]), after + len(extra))
            extra += data
        else:
            entries += struct.pack("<HHI", k, code, len(tags[k])) + data.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(blocks) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


@pytest.mark.parametrize(("dtype", "predictor"), [("uint8", 1), ("uint8", 2), ("int16", 2), ("float32", 1), ("float32", 3), ("float64", 3)])
@pytest.mark.parametrize(("name", "compression", "pack"), [("lzw", 5, packed_lzw), ("deflate", 8, zlib.compress), ("plain", 1, bytes)])
def test_geotiff_of_other_writers(dtype, predictor, name, compression, pack):
    rng = np.random.default_rng(5)
    bands = (np.cumsum(rng.random((3, 130, 41)), 2) * 3 + rng.random((3, 130, 41))).astype(dtype)
    raw = rewritten(geotiff.encode(bands, (10.0, 0.0, 5.0, 0.0, -10.0, 9.0), 32720, deflate=False), pack, compression, predictor)
    h = geotiff.header(raw)
    assert (geotiff.decode(raw)[0] == bands).all()
    assert (geotiff.read_window(raw, h, 60, 70, 3, 17, 2) == bands[:2, 60:70, 3:17]).all()
    assert geotiff.read_window(raw, h, 60, 60, 3, 17).size == 0
    strips = list(geotiff.rows_of(raw, h, 10, 3))
    assert [y for y, _ in strips] == [0, 64, 128]
    assert (np.concatenate([x for _, x in strips], 1) == bands).all()


def test_lzw_of_long_and_repeated_data():
    for data in (b"a" * 30_000, bytes(range(256)) * 60, np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8).tobytes(), b""):
        assert geotiff.unpacked_lzw(packed_lzw(data)) == data


def test_only_touched_blocks_are_unpacked(monkeypatch):
    bands = np.zeros((1, 640, 8), np.uint8)
    raw = geotiff.encode(bands, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    seen, real = [], geotiff._block
    monkeypatch.setattr(geotiff, "_block", lambda raw, h, i, rows, per: (seen.append(i), real(raw, h, i, rows, per))[1])
    geotiff.read_window(raw, geotiff.header(raw), 130, 200, 0, 8)
    assert seen == [2, 3]


@pytest.mark.parametrize(("change", "match"), [({"predictor": 3}, "predictor"), ({"compression": 7}, "compression")])
def test_what_is_not_known_is_refused(change, match):
    raw = geotiff.encode(np.zeros((1, 70, 8), np.uint8), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), deflate=False)
    with pytest.raises(ValueError, match=match):
        geotiff.header(rewritten(raw, bytes, **({"compression": 1} | change)))
    with pytest.raises(ValueError, match="predictor"):
        geotiff.header(rewritten(geotiff.encode(np.zeros((1, 70, 8), np.float32), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), deflate=False), bytes, 1, 2))


@pytest.fixture
def scene(tmp_path):
    bands = np.random.default_rng(4).gamma(2.0, 300.0, (3, 150, 140)).astype(np.float32)
    (tmp_path / "s.tif").write_bytes(geotiff.encode(bands, (10.0, 0.0, 600000.0, 0.0, -10.0, 9000000.0), 32720))
    return str(tmp_path / "s.tif"), bands


def test_patchify_equals_numpy(spark, scene):
    path, bands = scene
    got = {(r.row, r.col): r for r in pipelines.patchify(spark, path, 32).collect()}
    flat = bands.astype(np.float64).reshape(3, -1)
    to = [np.array(x)[:, None, None] for x in (config.REFERENCE_MEAN, config.REFERENCE_STD)]
    matched = (bands - flat.mean(1)[:, None, None]) / (flat.std(1)[:, None, None] + 1e-6) * to[1] + to[0]
    image = np.clip(matched, 0, 255).astype(np.uint8).transpose(1, 2, 0).astype(int)
    starts = [(i, j, y, x) for i, y in enumerate(range(0, 87, 32)) for j, x in enumerate(range(0, 77, 32))]
    assert got.keys() == {(i, j) for i, j, _, _ in starts}
    for i, j, y, x in starts:
        patch = np.frombuffer(bytes(got[i, j].pixels), np.uint8).reshape(64, 64, 3)
        assert np.abs(patch - image[y : y + 64, x : x + 64]).max() <= 1
        assert (got[i, j].left, got[i, j].top) == (600000.0 + 10 * x, 9000000.0 - 10 * y)


def test_too_few_bands_are_refused(spark, tmp_path):
    (tmp_path / "one.tif").write_bytes(geotiff.encode(np.zeros((1, 70, 70), np.uint8), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)))
    with pytest.raises(Exception, match="at least 3 bands"):
        geotiff.read_strips(spark, str(tmp_path / "one.tif")).count()


def test_raster_window(spark, tmp_path):
    band = np.arange(100, dtype=np.uint8).reshape(1, 10, 10)
    (tmp_path / "loss.tif").write_bytes(geotiff.encode(band, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)))
    got = geotiff.read_raster(spark, str(tmp_path / "loss.tif"), (2, 4, 3, 99)).collect()
    assert {(r.pr, r.pc): r.value for r in got} == {(r, c): 10 * r + c for r in (2, 3) for c in range(3, 10)}


def archive(path, **layers):
    rc = np.array([(r, c) for r in range(2) for c in range(3)], np.int32)
    bounds = np.stack([rc[:, 1] * 640.0, -(rc[:, 0] + 1) * 640.0, (rc[:, 1] + 1) * 640.0, rc[:, 0] * -640.0], 1)
    np.savez_compressed(path, grid_rc=rc, geo_bounds=bounds, grid_shape=np.array([2, 3], np.int32), crs=np.array("EPSG:32720"), **layers)


def test_archives_and_command_line(spark, tmp_path):
    a, b = np.ones((2, 3), np.int64), np.array([[0, 1, 2], [5, 4, -1]])
    for name, labels in (("a", a), ("b", b)):
        archive(tmp_path / f"{name}.npz", label_grid=labels, conf_grid=np.full((2, 3), 0.9, np.float32))
    cli.main(["detect", f"{tmp_path}/a.npz", f"{tmp_path}/b.npz", f"{tmp_path}/out", "--min-conf", "0.5"])
    events = spark.read.option("header", True).csv(f"{tmp_path}/out/events").collect()
    assert [(r.row, r.col, r.to_class) for r in events] == [("0", "0", "AnnualCrop"), ("1", "0", "Pasture"), ("1", "1", "Industrial")]
    assert events[0].crs == "EPSG:32720"
    cells = spark.read.parquet(f"{tmp_path}/out/cells")
    path = arrays.save_archives(arrays.mask_archives(cells, "EPSG:32720"), str(tmp_path))
    with np.load(path[0]) as z:
        assert (z["change"] == np.array([[True, False, False], [True, True, False]])).all()
        assert z["geo_bounds"].shape == (6, 4)
    assert arrays.read_mask(spark, path[0]).where("change").count() == 3
    loss = np.zeros((1, 128, 192), np.uint8)
    loss[0, :64, :64] = 18
    (tmp_path / "loss.tif").write_bytes(geotiff.encode(loss, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0)))
    cli.main(["score", path[0], f"{tmp_path}/loss.tif", "--year-a", "2016", "--year-b", "2024", "--out-json", f"{tmp_path}/score"])
    score = spark.read.json(f"{tmp_path}/score").first()
    assert (score.true_positives, score.false_positives, score.false_negatives) == (1, 2, 0)


def test_grid_archive_round_trip(spark):
    rows = [("s", r, c, r * 3 + c, 0.5, 0.0, 0.0, 1.0, 1.0) for r in range(2) for c in range(3)]
    cells = spark.createDataFrame(rows, "scene_id string, `row` int, col int, label long, conf float, left double, bottom double, right double, top double")
    blob = arrays.grid_archives(cells).first().content
    with np.load(io.BytesIO(bytes(blob))) as z:
        assert z["label_grid"].tolist() == [[0, 1, 2], [3, 4, 5]]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Forest", 0.5, 1.0, 0.6667, 3)], "name string, precision double, recall double, f1 double, support long")
    tables.write_json(rows, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().f1 == 0.6667
    tables.write_report(rows, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").first()[0] == "Forest precision 0.5000 recall 1.0000 f1 0.6667 support 3"
    assert json.loads(tables.as_json(rows).first()[0])["support"] == 3
    with pytest.raises(Exception, match="no rows"):
        tables.require(rows, F.lit(False), "no rows").count()


def test_training_and_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=4) + 4 * np.eye(4)[i % 3]], i % 3) for i in range(240)]
    data = spark.createDataFrame(rows, "id long, x array<float>, y int")
    model, history = pipelines.train(data, "id", "x", "y", 4, 3, (1, 8), (20,))
    assert history.count() == 3
    assert history.where("is_best").count() >= 1
    pipelines.save_checkpoint(model, 0.9, str(tmp_path), spark)
    again, val_acc, names = pipelines.load_checkpoint(str(tmp_path), spark)
    assert (val_acc, tuple(names)) == (0.9, config.CLASS_NAMES)
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, class_name string")
    accuracy, report, matrix = pipelines.evaluate(again, data, "id", "x", "y", classes)
    assert accuracy.first().accuracy > 0.8
    assert accuracy.first().n == 24
    assert report.count() == 6
    assert sum(sum(r[1:]) for r in matrix.collect()) == 24


def test_classify_runs_the_model_in_batches(spark):
    from geoloom.operators import inference

    patches = spark.createDataFrame([(i // 2, i % 2, [float(i), 1.0], b"") for i in range(4)], "row int, col int, x array<float>, pixels binary")
    made = pipelines.classify(patches, "x", inference.linear_model(np.array([[1.0, 0.0], [0.0, 1.5]]), np.zeros(2)), 2, 3)
    assert [r.label for r in made.orderBy("row", "col").collect()] == [1, 1, 0, 0]


def test_patch_archive_round_trip(spark, scene):
    path, _ = scene
    patches = pipelines.patchify(spark, path)
    with np.load(io.BytesIO(bytes(arrays.patch_archives(patches).first().content))) as z:
        assert z["patches"].shape == (4, 64, 64, 3)
        assert z["grid_rc"].tolist() == [[0, 0], [0, 1], [1, 0], [1, 1]]
        want = {(r.row, r.col): bytes(r.pixels) for r in patches.collect()}
        assert [p.tobytes() for p in z["patches"]] == [want[tuple(rc)] for rc in z["grid_rc"].tolist()]


def test_image_moments(spark, folder):
    from geoloom.operators import radiometry

    root, pictures = folder
    every = np.concatenate([p.reshape(-1, 3) for p in pictures.values()]).astype(float)
    got = radiometry.image_moments(images.read_decoded(spark, str(root))).orderBy("band").collect()
    assert [r.n for r in got] == [len(every)] * 3
    assert np.allclose([r.mean for r in got], every.mean(0))
    assert np.allclose([r["std"] for r in got], every.std(0))


def test_train_evaluate_classify_by_command_line(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=4) + 5 * np.eye(4)[i % 3]], i % 3, i // 20, i % 20) for i in range(240)]
    spark.createDataFrame(rows, "id long, features array<float>, label int, `row` int, col int").write.parquet(f"{tmp_path}/t")
    cli.main(["train", f"{tmp_path}/t", f"{tmp_path}/m"])
    cli.main(["evaluate", f"{tmp_path}/t", f"{tmp_path}/m", f"{tmp_path}/e"])
    assert spark.read.text(f"{tmp_path}/e/report").count() == len(config.CLASS_NAMES) + 3
    cli.main(["classify", f"{tmp_path}/t", f"{tmp_path}/m", f"{tmp_path}/g"])
    got = spark.read.parquet(f"{tmp_path}/g")
    assert {"row", "col", "label", "conf"} <= set(got.columns)
    assert got.where("id % 3 = label").count() > 220


def test_pixel_features_in_one_step(spark):
    from geoloom.operators import inference

    rng = np.random.default_rng(3)
    patches = [rng.integers(0, 256, (8, 8, 3)).astype(np.uint8) for _ in range(5)]
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(patches)] + [(9, None)], "id int, pixels binary")
    flat = {r.id: r.features for r in inference.pixel_features(df, size=8, backbone=lambda: lambda t: t.reshape(len(t), -1), batch_size=2).collect()}
    assert flat[9] is None
    for i, p in enumerate(patches):
        want = (p.transpose(2, 0, 1) / 255 - np.array(config.CHANNEL_MEAN)[:, None, None]) / np.array(config.CHANNEL_STD)[:, None, None]
        assert np.allclose(flat[i], want.reshape(-1), atol=1e-5)
    assert {len(r.features) for r in inference.pixel_features(df.where("id < 9"), size=8).collect()} == {2 * 3 * 16 + 6}


def test_from_images_and_scenes_to_scores_by_command_line(spark, tmp_path):
    """Layout, features, training, two dates of two scenes, patches, grids, change, scores."""
    rng = np.random.default_rng(7)
    tones = {n: rng.integers(30, 220, 3) for n in config.CLASS_NAMES}
    tones |= {"Forest": np.array([20, 90, 20]), "Pasture": np.array([200, 180, 60])}

    def patch(name):
        return np.clip(tones[name] + rng.integers(-9, 10, (64, 64, 3)), 0, 255).astype(np.uint8)

    for name in config.CLASS_NAMES:
        (tmp_path / "zip" / "inner" / name).mkdir(parents=True)
        for k in range(12):
            (tmp_path / "zip" / "inner" / name / f"{k}.png").write_bytes(png(patch(name)))
    cli.main(["layout", f"{tmp_path}/zip", f"{tmp_path}/images"])
    assert not (tmp_path / "zip").exists()
    cli.main(["features", f"{tmp_path}/images", f"{tmp_path}/table"])
    assert spark.read.parquet(f"{tmp_path}/table").count() == 120
    cli.main(["train", f"{tmp_path}/table", f"{tmp_path}/model"])
    history = spark.read.json(f"{tmp_path}/model/history")
    assert history.where("seconds > 0").count() == history.count()
    plans = {"north_a": "FFP", "south_a": "FPF", "north_b": "PFP", "south_b": "FPP"}
    for name, letters in plans.items():
        row = [patch({"F": "Forest", "P": "Pasture"}[c]) for c in letters]
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(np.concatenate(row, 1).transpose(2, 0, 1).astype(np.float32), (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), 32720))
    for date in "ab":
        # every scene already has the reference's own radiometry here, so its patches go unmatched
        parts = []
        for place in ("north", "south"):
            strips = geotiff.read_strips(spark, f"{tmp_path}/{place}_{date}.tif")
            same = strips.withColumn("data", F.udf(lambda b: np.frombuffer(b, "<f4").astype(np.uint8).tobytes(), "binary")("data"))
            from geoloom.functions.geo import window_bounds
            from geoloom.operators import tiling

            cut = tiling.patch_strips(same, carried=("crs", "transform")).withColumn("b", window_bounds(F.col("col") * 64, F.col("row") * 64, 64, F.col("transform")))
            parts.append(cut.select("scene_id", "row", "col", "b.*", "crs", "pixels"))
        parts[0].unionByName(parts[1]).write.parquet(f"{tmp_path}/patches_{date}")
        cli.main(["classify", f"{tmp_path}/patches_{date}", f"{tmp_path}/model", f"{tmp_path}/grid_{date}"])
        labels = {(r.scene_id[:5], r.col): config.CLASS_NAMES[r.label][0] for r in spark.read.parquet(f"{tmp_path}/grid_{date}").collect()}
        assert labels == {(p, i): c for p in ("north", "south") for i, c in enumerate(plans[f"{p}_{date}"])}
    with pytest.raises(ValueError, match="several scenes"):
        cli.main(["detect", f"{tmp_path}/grid_a", f"{tmp_path}/grid_b", f"{tmp_path}/none"])
    cli.main(["detect", f"{tmp_path}/grid_a", f"{tmp_path}/grid_b", f"{tmp_path}/out", "--pair", "north_a", "north_b", "--pair", "south_a", "south_b"])
    cells = spark.read.parquet(f"{tmp_path}/out/cells")
    assert sorted((r.scene_id, r.col) for r in cells.where("change").collect()) == [("north_a", 0), ("south_a", 2)]
    loss = np.zeros((1, 64, 192), np.uint8)
    loss[0, :, :64] = 18
    (tmp_path / "loss.tif").write_bytes(geotiff.encode(loss, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0)))
    first = spark.read.parquet(f"{tmp_path}/grid_a").select("scene_id", "row", "col", "left", "bottom", "right", "top")
    cells.drop("left", "bottom", "right", "top").join(first, ["scene_id", "row", "col"]).write.parquet(f"{tmp_path}/mask")
    cli.main(["score", f"{tmp_path}/mask", f"{tmp_path}/loss.tif", "--year-a", "2016", "--year-b", "2024", "--out-json", f"{tmp_path}/score", "--per-scene"])
    got = {r.scene_id: (r.true_positives, r.false_positives, r.false_negatives) for r in spark.read.json(f"{tmp_path}/score").collect()}
    assert got == {"north_a": (1, 0, 0), "south_a": (0, 1, 1)}


def test_composite_of_a_cube_to_files(spark, tmp_path):
    rows = [(f"2024-01-{d:02d}", p, y, x, b, float(10 * y + x + d + 100 * k), 5.0) for p in "ab" for d in (1, 2, 9) for y in range(3) for x in range(4) for k, b in enumerate(("red", "nir"))]
    spark.createDataFrame(rows, "acq_date string, period string, y int, x int, band string, value double, cloud_pct double").write.parquet(f"{tmp_path}/cube")
    (tmp_path / "out").mkdir()
    cli.main(["composite", f"{tmp_path}/cube", f"{tmp_path}/out", "--start", "2024-01-01", "--end", "2024-01-31", "--bands", "red", "nir", "--tif", "0", "0", "10", "--epsg", "32720"])
    array, affine, crs = geotiff.decode((tmp_path / "out" / "a.tif").read_bytes())
    assert array.shape == (2, 3, 4)
    assert array[1, 2, 3] == 10 * 2 + 3 + 2 + 100
    assert (affine, crs) == ((10.0, 0.0, 0.0, 0.0, -10.0, 0.0), "EPSG:32720")
    cli.main(["composite", f"{tmp_path}/cube", f"{tmp_path}/table", "--start", "2024-01-01", "--end", "2024-01-02"])
    assert spark.read.parquet(f"{tmp_path}/table").where("period = 'a' AND y = 0 AND x = 0 AND band = 'red'").first()["median"] == 1.5
