"""Compressed numpy archives: patch sets, label grids and change masks, read and written for exchange.
Parquet is the native form of all of them."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def _read(spark: SparkSession, path: str, schema: str, rows):
    """One group of rows per archive, made by ``rows(scene_id, arrays)``."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(rows(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], _arrays(raw)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _geometry(scene: str, z: dict[str, np.ndarray]) -> dict:
    rc, bounds = z["grid_rc"].astype(np.int32), z["geo_bounds"].astype(np.float64)
    return {"scene_id": scene, "row": rc[:, 0], "col": rc[:, 1]} | {k: bounds[:, i] for i, k in enumerate(("left", "bottom", "right", "top"))} | {"crs": str(z["crs"])}


_CELL = 'scene_id string, "row" int, col int, left double, bottom double, right double, top double, crs string'.replace('"', "`")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, f"{_CELL}, pixels binary", lambda s, z: _geometry(s, z) | {"pixels": [p.tobytes() for p in z["patches"]]})


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(cell, label, conf)."""

    def rows(scene, z):
        out = _geometry(scene, z)
        at = (out["row"], out["col"])
        return out | {"label": z["label_grid"][at].astype(np.int64), "conf": z["conf_grid"][at].astype(np.float32)}

    return _read(spark, path, f"{_CELL}, label long, conf float", rows)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(cell, change, was_forest)."""

    def rows(scene, z):
        out = _geometry(scene, z)
        at = (out["row"], out["col"])
        return out | {"change": z["change"][at].astype(bool), "was_forest": z["was_forest"][at].astype(bool)}

    return _read(spark, path, f"{_CELL}, change boolean, was_forest boolean", rows)


def archives(cells: DataFrame, layers: dict[str, tuple[str, object]], crs: str = "") -> DataFrame:
    """(scene_id, content): an archive per scene with dense layers {name: (dtype, fill)} of the columns
    of that name.  A scene's grid is one group; pixels stay out of it."""
    kind = cells.schema["scene_id"].dataType.simpleString()

    def pack(group):
        import pandas as pd

        group = group.sort_values(["row", "col"])
        r, c = group["row"].to_numpy(), group["col"].to_numpy()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        out = {}
        for name, (dtype, fill) in layers.items():
            dense = np.full(shape, fill, dtype)
            dense[r, c] = group[name].to_numpy()
            out[name] = dense
        buffer = io.BytesIO()
        np.savez_compressed(
            buffer, **out, grid_rc=np.stack([r, c], 1).astype(np.int32), geo_bounds=group[["left", "bottom", "right", "top"]].to_numpy(np.float64),
            grid_shape=np.array(shape, np.int32), crs=np.array(crs),
        )
        return pd.DataFrame({"scene_id": group["scene_id"].iloc[:1], "content": [buffer.getvalue()]})

    return cells.groupBy("scene_id").applyInPandas(pack, f"scene_id {kind}, content binary")


#: Layers of a land-cover grid and of a change mask.
GRID_LAYERS = {"label_grid": ("int64", -1), "conf_grid": ("float32", 0.0)}
MASK_LAYERS = {"change": ("bool", False), "was_forest": ("bool", False)}


def grid_archives(cells: DataFrame, crs: str = "") -> DataFrame:
    return archives(cells.withColumnsRenamed({"label": "label_grid", "conf": "conf_grid"}), GRID_LAYERS, crs)


def mask_archives(cells: DataFrame, crs: str = "") -> DataFrame:
    return archives(cells, MASK_LAYERS, crs)


def patch_archives(patches: DataFrame, size: int = 64, channels: int = 3) -> DataFrame:
    """(scene_id, content): a patch set per scene, in row-major order.  The exchange form holds a whole
    scene, so it suits scenes that a worker can hold; Parquet has no such limit."""
    kind = patches.schema["scene_id"].dataType.simpleString()

    def pack(group):
        import pandas as pd

        group = group.sort_values(["row", "col"])
        rc = group[["row", "col"]].to_numpy(np.int32)
        buffer = io.BytesIO()
        np.savez_compressed(
            buffer, patches=np.stack([np.frombuffer(p, np.uint8).reshape(size, size, channels) for p in group["pixels"]]), grid_rc=rc,
            geo_bounds=group[["left", "bottom", "right", "top"]].to_numpy(np.float64), grid_shape=(rc.max(0) + 1).astype(np.int32), crs=np.array(group["crs"].iloc[0]),
        )
        return pd.DataFrame({"scene_id": group["scene_id"].iloc[:1], "content": [buffer.getvalue()]})

    return patches.groupBy("scene_id").applyInPandas(pack, f"scene_id {kind}, content binary")


def save_archives(made: DataFrame, folder: str) -> list[str]:
    """Write archives to local files, one scene at a time; for exchange with programs that want them."""
    out = []
    for row in made.withColumn("scene_id", F.col("scene_id").cast("string")).toLocalIterator():
        out.append(f"{folder}/{row['scene_id']}.npz")
        with open(out[-1], "wb") as file:
            file.write(row["content"])
    return out
