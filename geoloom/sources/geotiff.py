"""GeoTIFF without a native library: strips or tiles; uncompressed, LZW or deflate; integer and
floating-point prediction; the tags that place a raster.  What it doesn't know it refuses.

Only the blocks that a window or a strip touches are decompressed.  Spark hands a file over whole, so
a task holds one file's compressed bytes and a few rows of its pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the format: tag numbers and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PHOTOMETRIC, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 262, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS = 33550, 33922, 34264, 34735
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)
CLEAR, END = 256, 257
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack(end + "H", raw[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(end + "I", raw[4:8])[0]
    out = {}
    for i in range(struct.unpack(end + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(end + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in TYPES:
            continue
        form = TYPES[kind]
        size = struct.calcsize("=" + form) * n
        place = at + 10 + 12 * i
        if size > 4:
            place = struct.unpack(end + "I", raw[place : place + 4])[0]
        out[tag] = struct.unpack(end + form * n, raw[place : place + size])
    return end, out


@dataclass(frozen=True)
class Header:
    """Where a file's blocks are, how they are packed, and where its raster lies."""

    height: int
    width: int
    n_bands: int
    dtype: np.dtype
    packed: int
    predictor: int
    planar: bool
    tiled: bool
    block_h: int
    block_w: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    affine: tuple[float, ...]
    crs: str


def header(raw: bytes) -> Header:
    end, tag = _tags(raw)
    height, width = tag[HEIGHT][0], tag[WIDTH][0]
    kind = {1: "u", 2: "i", 3: "f"}.get(tag.get(SAMPLE_FORMAT, (1,))[0])
    bits = set(tag.get(BITS, (1,)))
    packed, predictor = tag.get(COMPRESSION, (PLAIN,))[0], tag.get(PREDICTOR, (1,))[0]
    if kind is None or len(bits) > 1 or not bits <= {8, 16, 32, 64}:
        raise ValueError(f"samples of format {tag.get(SAMPLE_FORMAT)} and {sorted(bits)} bits are not supported")
    if packed not in (PLAIN, LZW, *DEFLATE):
        raise ValueError(f"compression {packed} is not supported")
    if predictor not in ((1, 3) if kind == "f" else (1, 2)):
        raise ValueError(f"predictor {predictor} is not supported for samples of kind {kind}")
    tiled = TILE_WIDTH in tag
    block_w, block_h = (tag[TILE_WIDTH][0], tag[TILE_HEIGHT][0]) if tiled else (width, min(height, tag.get(ROWS_PER_STRIP, (height,))[0]))
    if TRANSFORMATION in tag:
        m = tag[TRANSFORMATION]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tag:
        sx, sy, (i, j, _, x, y, _) = tag[PIXEL_SCALE][0], tag[PIXEL_SCALE][1], tag[TIE_POINT][:6]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        affine = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    keys = tag.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    code = codes.get(PROJECTED_KEY) or codes.get(GEOGRAPHIC_KEY)
    return Header(
        height, width, tag.get(SAMPLES, (1,))[0], np.dtype(f"{end}{kind}{bits.pop() // 8}"), packed, predictor, tag.get(PLANAR, (1,))[0] == 2, tiled, block_h, block_w,
        *((tag[TILE_OFFSETS], tag[TILE_COUNTS]) if tiled else (tag[OFFSETS], tag[COUNTS])), affine, f"EPSG:{code}" if code else "",
    )


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code grows one entry before its table is full."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, n_held, before, out = list(single), 9, 0, 0, b"", []
    for byte in data:
        held, n_held = held << 8 | byte, n_held + 8
        if n_held < width:
            continue
        n_held -= width
        code, held = held >> n_held, held & (1 << n_held) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, before = list(single), 9, b""
            continue
        if code > len(table) or code == len(table) and not before:
            raise ValueError("a broken LZW block")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _block(raw: bytes, h: Header, i: int, rows: int, per: int) -> np.ndarray:
    """(rows, block width, samples) of the i-th block, prediction undone."""
    data = raw[h.offsets[i] : h.offsets[i] + h.counts[i]]
    data = data if h.packed == PLAIN else unpacked_lzw(data) if h.packed == LZW else zlib.decompress(data)
    n = rows * h.block_w * per
    if h.predictor == 3:  # bytes of a row: differences, all highest bytes first
        planes = np.frombuffer(data, np.uint8, n * h.dtype.itemsize).reshape(rows, h.block_w * h.dtype.itemsize, per)
        planes = np.cumsum(planes, 1, dtype=np.uint8).reshape(rows, h.dtype.itemsize, h.block_w * per)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(-1).view(h.dtype.newbyteorder(">")).reshape(rows, h.block_w, per)
    block = np.frombuffer(data, h.dtype, n).reshape(rows, h.block_w, per)
    return np.cumsum(block, 1, dtype=h.dtype.newbyteorder("=")) if h.predictor == 2 else block


def read_window(raw: bytes, h: Header, r0: int, r1: int, c0: int, c1: int, bands: int | None = None) -> np.ndarray:
    """(bands, r1 - r0, c1 - c0): pixels of a window inside the raster, from the blocks it touches."""
    n = min(bands or h.n_bands, h.n_bands)
    out = np.zeros((n, max(0, r1 - r0), max(0, c1 - c0)), h.dtype.newbyteorder("="))
    if not out.size:
        return out
    across, down = -(-h.width // h.block_w), -(-h.height // h.block_h)
    per = 1 if h.planar else h.n_bands
    for band in range(n if h.planar else 1):
        for by in range(r0 // h.block_h, -(-r1 // h.block_h)):
            for bx in range(c0 // h.block_w, -(-c1 // h.block_w)):
                y, x = by * h.block_h, bx * h.block_w
                block = _block(raw, h, (band * down + by) * across + bx, h.block_h if h.tiled else min(h.block_h, h.height - y), per)
                a, b, c, d = max(r0, y), min(r1, y + block.shape[0]), max(c0, x), min(c1, x + h.block_w)
                part = block[a - y : b - y, c - x : d - x].transpose(2, 0, 1)
                out[band : band + 1 if h.planar else n, a - r0 : b - r0, c - c0 : d - c0] = part[: 1 if h.planar else n]
    return out


def decode(raw: bytes) -> tuple[np.ndarray, tuple[float, ...], str]:
    """((bands, H, W) array, affine (a, b, c, d, e, f), crs) of a file's bytes."""
    h = header(raw)
    return read_window(raw, h, 0, h.height, 0, h.width), h.affine, h.crs


def rows_of(raw: bytes, h: Header, rows: int, bands: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, pixels) of strips of whole block rows, ``rows`` high at least; each block is
    decompressed once."""
    step = -(-rows // h.block_h) * h.block_h
    for y in range(0, h.height, step):
        yield y, read_window(raw, h, y, min(h.height, y + step), 0, h.width, bands)


def encode(bands: np.ndarray, affine: tuple[float, ...], epsg: int = 0, projected: bool = True, deflate: bool = True) -> bytes:
    """A file's bytes: one strip per 64 rows, interleaved samples."""
    n, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    little = np.ascontiguousarray(bands.transpose(1, 2, 0)).astype(bands.dtype.newbyteorder("<"))
    strips = [little[y : y + 64].tobytes() for y in range(0, height, 64)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    a, _, c, _, e, f = affine
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bands.dtype.itemsize * 8] * n), (COMPRESSION, "H", [8 if deflate else 1]), (PHOTOMETRIC, "H", [1]),
        (OFFSETS, "I", offsets), (SAMPLES, "H", [n]), (ROWS_PER_STRIP, "I", [64]), (COUNTS, "I", [len(s) for s in strips]), (PLANAR, "H", [1]),
        (SAMPLE_FORMAT, "H", [kind] * n), (PIXEL_SCALE, "d", [a, -e, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, c, f, 0.0]),
    ]
    if epsg:
        fields.append((GEO_KEYS, "H", [1, 1, 0, 1, PROJECTED_KEY if projected else GEOGRAPHIC_KEY, 0, 1, epsg]))
    codes = {v: k for k, v in TYPES.items()}
    after = at + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for tag, form, values in fields:
        data = struct.pack("<" + form * len(values), *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, codes[form], len(values), after + len(extra))
            extra += data
        else:
            entries += struct.pack("<HHI", tag, codes[form], len(values)) + data.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


_SCENE = "path string, scene_id string, height int, width int, n_bands int, crs string, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: size, bands, crs, transform; no pixel is decoded."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                h = header(raw)
                rows.append((p, _name(p), h.height, h.width, h.n_bands, h.crs, dict(zip("abcdef", h.affine, strict=True))))
            yield pd.DataFrame(rows, columns=["path", "scene_id", "height", "width", "n_bands", "crs", "transform"])

    return _files(spark, path).mapInPandas(run, _SCENE)


def read_strips(spark: SparkSession, path: str, rows: int = 64, bands: int = 3) -> DataFrame:
    """(scene_id, height, width, n_bands, crs, transform, y0, n_rows, data): float32 strips, interleaved;
    the layout for whole scenes.  Fewer than ``bands`` bands raise an error."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                h = header(raw)
                if h.n_bands < bands:
                    raise ValueError(f"expected at least {bands} bands, {p} has {h.n_bands}")
                place = dict(zip("abcdef", h.affine, strict=True))
                for y, array in rows_of(raw, h, rows, bands):
                    data = np.ascontiguousarray(array.transpose(1, 2, 0)).astype("<f4").tobytes()
                    yield pd.DataFrame(
                        [(_name(p), h.height, h.width, bands, h.crs, place, y, array.shape[1], data)],
                        columns=["scene_id", "height", "width", "n_bands", "crs", "transform", "y0", "n_rows", "data"],
                    )

    place = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    return _files(spark, path).mapInPandas(run, f"scene_id string, height int, width int, n_bands int, crs string, transform {place}, y0 int, n_rows int, data binary")


def strip_moments(strips: DataFrame) -> DataFrame:
    """(scene_id, band, mean, std) over all pixels of strips: each gives a count, a mean and a sum of
    squares about it per band, which add up."""

    def sums(frames):
        import pandas as pd

        for frame in frames:
            for scene, n, data in zip(frame["scene_id"], frame["n_bands"], frame["data"], strict=True):
                value = np.frombuffer(data, "<f4").reshape(-1, n).astype(np.float64)
                mean = value.mean(0)
                yield pd.DataFrame({"scene_id": scene, "band": np.arange(n, dtype=np.int32), "n": len(value), "m": mean, "q": ((value - mean) ** 2).sum(0)})

    parts = strips.select("scene_id", "n_bands", "data").mapInPandas(sums, "scene_id string, band int, n long, m double, q double")
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    total = parts.groupBy("scene_id", "band").agg(F.sum("n").alias("n"), mean.alias("mean"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s"))
    between = F.greatest(F.lit(0.0), F.col("s") - F.col("n") * F.col("mean") * F.col("mean"))
    return total.select("scene_id", "band", "mean", F.sqrt((F.col("q") + between) / F.col("n")).alias("std"))


def read_pixels(spark: SparkSession, path: str, bands: int = 3) -> DataFrame:
    """(scene_id, y, x, band, value float): the long layout."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for scene, w, n, y0, rows, data in zip(*(frame[c] for c in ("scene_id", "width", "n_bands", "y0", "n_rows", "data")), strict=True):
                value = np.frombuffer(data, "<f4")
                y, x, band = (i.reshape(-1) for i in np.indices((rows, w, n), dtype=np.int32))
                yield pd.DataFrame({"scene_id": scene, "y": y + np.int32(y0), "x": x, "band": band, "value": value})

    return read_strips(spark, path, bands=bands).mapInPandas(run, "scene_id string, y int, x int, band int, value float")


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, rows: int = 64) -> DataFrame:
    """(pr, pc, value int) of the first band; only blocks that touch the window (r0, r1, c0, c1) are
    decompressed."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for raw in frame["content"]:
                h = header(raw)
                r0, r1, c0, c1 = window or (0, h.height, 0, h.width)
                r0, r1, c0, c1 = max(0, r0), min(h.height, r1), max(0, c0), min(h.width, c1)
                step = -(-rows // h.block_h) * h.block_h
                for y in range(r0 // step * step, r1, step):
                    top = max(r0, y)
                    block = read_window(raw, h, top, min(r1, y + step), c0, c1, 1)[0]
                    pr, pc = (i.reshape(-1) for i in np.indices(block.shape, dtype=np.int32))
                    yield pd.DataFrame({"pr": pr + np.int32(top), "pc": pc + np.int32(c0), "value": block.reshape(-1).astype(np.int32)})

    return _files(spark, path).mapInPandas(run, "pr int, pc int, value int")


def scene_files(pixels: DataFrame, affine: tuple[float, ...], epsg: int = 0, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """(keys, content): a GeoTIFF per scene or period from long pixels (y, x, band number, value); cells
    without a pixel are NaN.  A file is one group, so it suits rasters that a worker can hold."""

    def pack(group):
        import pandas as pd

        y, x, band = (group[c].to_numpy(np.int64) for c in ("y", "x", "band"))
        raster = np.full((band.max() + 1, y.max() + 1, x.max() + 1), np.nan, np.float32)
        raster[band, y, x] = group["value"].to_numpy(np.float32)
        return pd.DataFrame({k: group[k].iloc[:1] for k in keys} | {"content": [encode(raster, affine, epsg)]})

    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return pixels.groupBy(*keys).applyInPandas(pack, f"{kinds}, content binary")


def write_scene_files(made: DataFrame, folder: str, name: str = "scene_id") -> list[str]:
    """Local files folder/<name>.tif, one at a time."""
    out = []
    for row in made.select(F.col(name).cast("string").alias("name"), "content").toLocalIterator():
        out.append(f"{folder}/{row['name']}.tif")
        with open(out[-1], "wb") as file:
            file.write(row["content"])
    return out


def matched_strips(strips: DataFrame, moments: DataFrame, to_mean: tuple[float, ...], to_std: tuple[float, ...]) -> DataFrame:
    """Float strips to byte strips by moment match; moments(scene_id, band, mean, std) are joined as
    one row per scene."""
    per_scene = moments.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("band", "mean", "std"))).alias("m"))

    @F.pandas_udf("binary")
    def match(data, means, stds, n_bands):
        import pandas as pd

        out = []
        for blob, mean, std, n in zip(data, means, stds, n_bands, strict=True):
            value = np.frombuffer(blob, "<f4").reshape(-1, n).astype(np.float64)
            scaled = (value - np.asarray(mean)) / (np.asarray(std) + 1e-6) * np.asarray(to_std) + np.asarray(to_mean)
            out.append(np.clip(np.nan_to_num(scaled, nan=0.0), 0, 255).astype(np.uint8).tobytes())
        return pd.Series(out)

    joined = strips.join(per_scene, "scene_id")
    return joined.withColumn("data", match("data", "m.mean", "m.std", "n_bands")).drop("m")
