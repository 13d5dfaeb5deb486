"""DuckDB SQL for the queries of ``queries``."""

from __future__ import annotations

import math

from geoloom import config
from geoloom.functions import geo
from geoloom.plans.queries import BIAS, SHARP, THRESHOLDS, WEIGHTS

_NAMES = "[" + ", ".join(f"'{n}'" for n in config.CLASS_NAMES) + "]"
_FOREST = "(" + ", ".join(map(str, config.FOREST_LABELS)) + ")"
_TARGET = "(" + ", ".join(map(str, config.TARGET_LABELS)) + ")"
_CLASSES = f"classes AS (SELECT i::INTEGER AS label, {_NAMES}[i + 1] AS class_name FROM range(10) t(i))"


def _logits(start: int, scale: float = 1.0) -> str:
    return f"list_transform(embedding[{start + 1}:{start + 10}], lambda v: v::DOUBLE * {scale}::DOUBLE)"


def _predicted(name: str, start: int, scale: float = 1.0, where: str = "true") -> str:
    return f"""{name} AS (
  SELECT (vec_id // 25)::INTEGER AS row, (vec_id % 25)::INTEGER AS col, (list_position(x, list_max(x)) - 1)::INTEGER AS label,
         1.0::DOUBLE / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS conf, vec_id, actual
  FROM (SELECT vec_id, label AS actual, {_logits(start, scale)} AS x FROM embeddings WHERE {where}))"""


def _changed(min_conf: float = 0.0, scale: float = 1.0) -> str:
    return f"""{_predicted("a", 0, scale)}, {_predicted("b", 10, scale)},
changed AS (
  SELECT a.row, a.col, a.label AS label_a, b.label AS label_b, a.label IN {_FOREST} AND a.conf >= {min_conf} AS was_forest,
         a.label IN {_FOREST} AND a.conf >= {min_conf} AND b.label IN {_TARGET} AND b.conf >= {min_conf} AS change
  FROM a JOIN b USING (row, col))"""


_FRACTIONS = """n AS (SELECT count(*) AS n FROM embeddings),
fractions AS (
  SELECT ((o_orderkey % n) // 25)::INTEGER AS row, ((o_orderkey % n) % 25)::INTEGER AS col, count(*)::BIGINT AS n_px,
         avg((year(o_orderdate) > 1997 AND year(o_orderdate) <= 2000)::INTEGER) AS loss_frac
  FROM orders, n WHERE o_orderkey < 8 * n GROUP BY 1, 2)"""

_SCORES = """
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) ELSE 0 END, 4) AS f1,
  round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE ELSE 0 END, 4) AS iou"""
_COUNTS = """count(*) FILTER (change)::BIGINT AS detected_cells, count(*) FILTER (ref)::BIGINT AS reference_cells, count(*) FILTER (change AND ref)::BIGINT AS tp,
  count(*) FILTER (change AND NOT ref)::BIGINT AS fp, count(*) FILTER (NOT change AND ref)::BIGINT AS fn"""
_COUNT_NAMES = "detected_cells, reference_cells, tp AS true_positives, fp AS false_positives, fn AS false_negatives"

_RASTER = "raster AS (SELECT vec_id::INTEGER AS y, (p // 3)::INTEGER AS x, (p % 3)::INTEGER AS band, embedding[p + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(63))::INTEGER AS p))"
_MOMENTS = "moments AS (SELECT band, avg(value) AS mean, stddev_pop(value) AS std FROM raster GROUP BY band)"
_SCENES = "scenes AS (SELECT s_suppkey AS scene_id, (s_suppkey * 37 % 500 + 40)::INTEGER AS height, (s_suppkey * 53 % 400 + 30)::INTEGER AS width FROM supplier)"
_PAIRS = f"{_predicted('a', 0)}, pairs AS (SELECT actual AS label, label AS pred FROM a)"
_HISTORY = "history AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS seq, avg((o_orderstatus = 'F')::INTEGER) AS val_acc FROM orders GROUP BY 1)"
_CUBE = """cube AS (SELECT event_id, ts::DATE AS acq_date, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'A' ELSE 'B' END AS period, user_id AS x, event_type AS band, value,
  (event_id % 100)::DOUBLE AS cloud_pct FROM events)"""
_SPLIT = """ranked AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('42-' || vec_id), vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings),
split AS (SELECT vec_id, label, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ranked)"""
_BOUNDS = '(col * 640.0)::DOUBLE AS "left", (9000000.0 - (row + 1) * 640)::DOUBLE AS bottom, ((col + 1) * 640.0)::DOUBLE AS "right", (9000000.0 - row * 640)::DOUBLE AS top'
_CELLS = "cells AS (SELECT (vec_id // 25)::INTEGER AS row, (vec_id % 25)::INTEGER AS col FROM embeddings)"
_FILES = f"files AS (SELECT 'file:/data/' || {_NAMES}[(c_custkey % 8 + 1)::INTEGER] || '/' || c_name || '.jpg' AS path, {_NAMES}[(c_custkey % 8 + 1)::INTEGER] AS class_name FROM customer)"


def _windows(stride: int) -> str:
    return f"""WITH {_RASTER}, h AS (SELECT count(*) AS h FROM embeddings),
r AS (SELECT i AS row FROM h, unnest(range(0, greatest(0, (h - 8) // {stride} + 1))) t(i)),
c AS (SELECT i AS col FROM unnest(range(0, (21 - 8) // {stride} + 1)) t(i))
SELECT band, row::INTEGER AS row, col::INTEGER AS col, count(*)::BIGINT AS n_px, round(avg(value), 6) AS mean
FROM r, c, raster WHERE y >= row * {stride} AND y < row * {stride} + 8 AND x >= col * {stride} AND x < col * {stride} + 8 GROUP BY 1, 2, 3"""


def _linear(k: int) -> str:
    return " + ".join(f"(embedding[{j + 1}]::DOUBLE * {w}::DOUBLE)" for j, w in enumerate(WEIGHTS[k])) + f" + {BIAS[k]}::DOUBLE"


def _coin(key: str, epoch: int, salt: str) -> str:
    return f"('0x' || substr(md5('42-{epoch}-' || {key} || '-{salt}'), 1, 1))::BIGINT < 8"


def _utm() -> str:
    e = 2 * math.sqrt(geo._N) / (1 + geo._N)
    x = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    y = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    k = geo.SCALE * geo._A
    return f"""WITH p AS (SELECT vec_id, -66.0::DOUBLE + (vec_id % 61) / 10::DOUBLE AS lon, -12.0::DOUBLE + (vec_id % 97) / 8::DOUBLE AS lat FROM embeddings),
q AS (SELECT *, radians(lat) AS phi, radians(lon - {geo.central_meridian(20)}) AS lam FROM p),
s AS (SELECT *, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM q),
u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM s)
SELECT vec_id, round(500000::DOUBLE + {k!r}::DOUBLE * ({x}), 2) AS x, round(10000000::DOUBLE + {k!r}::DOUBLE * ({y}), 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM u"""


def _measure(name: str) -> str:
    p = "CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END"
    r = "CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END"
    return {"precision": p, "recall": r, "f1": f"CASE WHEN tp > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END"}[name]


_REPORT = f"""WITH {_PAIRS}, {_CLASSES},
counts AS (SELECT c.label, class_name AS name, count(*) FILTER (p.label = c.label) AS support, count(*) FILTER (p.pred = c.label) AS predicted,
  count(*) FILTER (p.label = c.label AND p.pred = c.label) AS tp FROM classes c, pairs p GROUP BY 1, 2),
per AS (SELECT name, {_measure("precision")} AS precision, {_measure("recall")} AS recall, {_measure("f1")} AS f1, support, tp FROM counts),
lines AS (
  SELECT name, precision, recall, f1, support FROM per UNION ALL
  SELECT 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(support) FROM per UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per)
SELECT name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support::BIGINT AS support FROM lines"""

_SCORED = f"""{_changed()}, {_FRACTIONS}, pairs AS (SELECT change, coalesce(loss_frac > 0.5, false) AS ref FROM changed LEFT JOIN fractions USING (row, col)),
counts AS (SELECT {_COUNTS} FROM pairs)"""


def _gated(g: float) -> str:
    return f"""SELECT * FROM (WITH {_changed(g, SHARP)} SELECT count(*) FILTER (was_forest)::BIGINT AS n_forest, count(*) FILTER (change)::BIGINT AS n_change,
  round(100 * count(*) FILTER (change) / greatest(count(*) FILTER (was_forest), 1)::DOUBLE, 1) AS percent, {g}::DOUBLE AS min_conf FROM changed)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "change_sweep": f"""WITH {_changed()}, {_FRACTIONS},
swept AS (SELECT change, f::DOUBLE AS min_loss_frac, coalesce(loss_frac > f, false) AS ref FROM changed LEFT JOIN fractions USING (row, col), unnest({list(THRESHOLDS)}::DOUBLE[]) t(f)),
counts AS (SELECT min_loss_frac, {_COUNTS} FROM swept GROUP BY 1)
SELECT min_loss_frac, {_COUNT_NAMES}, {_SCORES} FROM counts""",
        "band_moments": f"WITH {_RASTER}, {_MOMENTS} SELECT band, round(mean, 6) AS mean, round(std, 6) AS std FROM moments",
        "moment_match": f"""WITH {_RASTER}, {_MOMENTS},
m AS (SELECT y, x, band, (value - mean) / (std + 0.000001::DOUBLE) * ({list(config.REFERENCE_STD)}::DOUBLE[])[band + 1] + ({list(config.REFERENCE_MEAN)}::DOUBLE[])[band + 1] AS v FROM raster JOIN moments USING (band))
SELECT y, x, band, round(v, 4) AS matched, trunc(least(255, greatest(0, v)))::INTEGER AS byte FROM m""",
        "tile_windows_tumbling": _windows(8),
        "tile_windows_sliding": _windows(4),
        "tile_windows_gapped": _windows(11),
        "window_counts": f"""WITH {_SCENES} SELECT scene_id, s::INTEGER AS stride, greatest(0, floor((height - 64) / s::DOUBLE) + 1)::INTEGER AS n_rows,
  greatest(0, floor((width - 64) / s::DOUBLE) + 1)::INTEGER AS n_cols FROM scenes, unnest([32, 64, 96]) t(s)""",
        "window_bounds": f"""WITH {_SCENES}, r AS (SELECT scene_id, width, unnest(range(0, height - 64 + 1, 32)) AS y FROM scenes WHERE height >= 64),
w AS (SELECT scene_id, y, unnest(range(0, width - 64 + 1, 32)) AS x FROM r WHERE width >= 64)
SELECT scene_id, (y // 32)::INTEGER AS row, (x // 32)::INTEGER AS col, (scene_id * 1000 + 10 * x)::DOUBLE AS "left", (9000000 - 10 * (y + 64))::DOUBLE AS bottom,
  (scene_id * 1000 + 10 * (x + 64))::DOUBLE AS "right", (9000000 - 10 * y)::DOUBLE AS top FROM w""",
        "softmax_argmax": f"""WITH x AS (SELECT vec_id, {_logits(0)} AS x FROM embeddings), e AS (SELECT *, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM x)
SELECT vec_id, (list_position(x, list_max(x)) - 1)::INTEGER AS label, round(list_max(e) / list_sum(e), 6) AS conf, round(e[4] / list_sum(e), 6) AS p3 FROM e""",
        "grid_densify": f"""WITH {_predicted("a", 0)}, cells AS (SELECT row, c::INTEGER AS col FROM (SELECT DISTINCT row FROM a), unnest(range(26)) t(c))
SELECT row, col, coalesce(label, -1)::BIGINT AS label, round(coalesce(conf, 0), 6) AS conf FROM cells LEFT JOIN a USING (row, col)""",
        "class_histogram": f"""WITH {_CLASSES}, {_predicted("a", 0)}
SELECT c.label, class_name, count(a.label)::BIGINT AS n FROM classes c LEFT JOIN a ON a.label = c.label GROUP BY 1, 2""",
        "change_cells": f"WITH {_changed()} SELECT row, col, label_a, label_b, was_forest, change FROM changed",
        "change_events": f"""WITH {_changed()}, bounds AS (SELECT row, col, label_a, label_b, {_BOUNDS} FROM changed WHERE change)
SELECT row, col, ("left" + "right") / 2 AS centroid_x, (bottom + top) / 2 AS centroid_y, {_NAMES}[label_a + 1] AS from_class, {_NAMES}[label_b + 1] AS to_class, 'EPSG:32720' AS crs FROM bounds""",
        "change_map_rgb": f"""WITH {_changed()} SELECT row, col, (CASE WHEN change THEN 0.85 WHEN was_forest THEN 0.1 ELSE 0.85 END)::DOUBLE AS r,
  (CASE WHEN change THEN 0.1 WHEN was_forest THEN 0.5 ELSE 0.85 END)::DOUBLE AS g, (CASE WHEN change THEN 0.1 WHEN was_forest THEN 0.1 ELSE 0.85 END)::DOUBLE AS b FROM changed""",
        "change_gated": " UNION ALL ".join(_gated(g) for g in (0.0, 0.5, 0.7)),
        "land_cover_transition": f"WITH {_changed()} SELECT label_a, label_b, count(*)::BIGINT AS n FROM changed GROUP BY 1, 2",
        "zonal_loss_fraction": f"WITH {_FRACTIONS} SELECT row, col, n_px, round(loss_frac, 6) AS loss_frac FROM fractions",
        "zonal_box_join": f"""WITH {_CELLS}, px AS (SELECT o_orderkey // 300 AS pr, o_orderkey % 300 AS pc, year(o_orderdate) AS y FROM orders),
j AS (SELECT row, col, count(*)::BIGINT AS n_px, avg((y > 1997 AND y <= 2000)::INTEGER) AS loss_frac FROM cells, px
      WHERE pr >= row * 8 - 2 AND pr < row * 8 + 10 AND pc >= col * 8 - 2 AND pc < col * 8 + 10 GROUP BY 1, 2)
SELECT row, col, coalesce(n_px, 0)::BIGINT AS n_px, round(loss_frac, 6) AS loss_frac FROM cells LEFT JOIN j USING (row, col)""",
        "reference_cells": f"WITH {_FRACTIONS} SELECT row, col, loss_frac > 0.25 AS ref FROM fractions",
        "score_metrics": f"WITH {_SCORED} SELECT {_COUNT_NAMES}, {_SCORES} FROM counts",
        "score_json": f"""WITH {_SCORED}, scores AS (SELECT {_COUNT_NAMES}, {_SCORES} FROM counts)
SELECT '{{' || concat_ws(',', {", ".join(f"""'"{c}":' || {c}""" for c in ("detected_cells", "reference_cells", "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1", "iou"))}) || '}}' AS json FROM scores""",
        "change_by_scene": f"""WITH {_changed()}
SELECT 'a' || (row * 25 + col) % 3 AS scene_id, count(*) FILTER (was_forest)::BIGINT AS n_forest, count(*) FILTER (change)::BIGINT AS n_change,
  round(100 * count(*) FILTER (change) / greatest(count(*) FILTER (was_forest), 1)::DOUBLE, 1) AS percent FROM changed GROUP BY 1""",
        "confusion_long": f"WITH {_PAIRS} SELECT label, pred, count(*)::BIGINT AS n FROM pairs GROUP BY 1, 2",
        "confusion_matrix": f"WITH {_PAIRS}, {_CLASSES} SELECT c.label, "
        + ", ".join(f"count(*) FILTER (pred = {k})::BIGINT AS p{k}" for k in range(10))
        + " FROM classes c LEFT JOIN pairs p ON p.label = c.label GROUP BY 1",
        "classification_report": _REPORT,
        "accuracy": f"WITH {_PAIRS} SELECT round(avg((label = pred)::INTEGER), 6) AS accuracy, count(*)::BIGINT AS n FROM pairs",
        "cross_entropy": f"""WITH x AS (SELECT label, {_logits(0)} AS x FROM embeddings)
SELECT round(avg(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1]), 6) AS loss, count(*)::BIGINT AS n FROM x""",
        "weighted_loss": """WITH b AS (SELECT l_returnflag, avg(l_discount) AS loss, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_orderkey)
SELECT l_returnflag, round(sum(loss * n) / sum(n), 6) AS loss, sum(n)::BIGINT AS n FROM b GROUP BY 1""",
        "trainable_parameters": "SELECT coalesce(sum(p_size) FILTER (p_partkey % 3 = 0), 0)::BIGINT AS n_trainable FROM part",
        "seeded_split": f"WITH {_SPLIT} SELECT vec_id, split FROM split",
        "split_class_balance": f"WITH {_SPLIT} SELECT split, label, count(*)::BIGINT AS n FROM split GROUP BY 1, 2",
        "mini_batches": """SELECT ((r - 1) // 64)::INTEGER AS batch, count(*)::BIGINT AS n, min(place) AS first_place, max(vec_id) AS last_id
FROM (SELECT vec_id, md5('42-3-' || vec_id) AS place, row_number() OVER (ORDER BY md5('42-3-' || vec_id), vec_id) AS r FROM embeddings) GROUP BY 1""",
        "epoch_shuffle": "SELECT vec_id, md5('42-3-' || vec_id) AS place FROM embeddings",
        "best_epoch": f"WITH {_HISTORY} SELECT seq, round(val_acc, 6) AS val_acc FROM history WHERE val_acc > 0 ORDER BY history.val_acc DESC, seq LIMIT 1",
        "running_best": f"""WITH {_HISTORY} SELECT seq, round(val_acc, 6) AS val_acc,
  h.val_acc > coalesce(greatest(max(h.val_acc) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS is_best FROM history h""",
        "median_composite": f"WITH {_CUBE} SELECT period, x, band, round(median(value), 6) AS median, count(*)::BIGINT AS n_dates FROM cube GROUP BY 1, 2, 3",
        "bbox_time_filter": f"""WITH {_CUBE} SELECT event_id, x, band FROM cube WHERE acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND band IN ('click', 'view', 'purchase')
  AND cloud_pct <= 20 AND x BETWEEN 10 AND 120 AND x % 50 BETWEEN 5 AND 40""",
        "scene_extent": f"""WITH {_CELLS}, b AS (SELECT {_BOUNDS} FROM cells) SELECT min("left") AS "left", min(bottom) AS bottom, max("right") AS "right", max(top) AS top FROM b""",
        "normalize_channels": "SELECT vec_id, x::INTEGER AS x, "
        + ", ".join(f"round((embedding[x * 3 + {i + 1}]::DOUBLE - {config.CHANNEL_MEAN[i]}::DOUBLE) / {config.CHANNEL_STD[i]}::DOUBLE, 6) AS {c}" for i, c in enumerate("rgb"))
        + " FROM embeddings, unnest(range(21)) t(x)",
        "to_tensor": "SELECT vec_id, " + ", ".join(f"round((vec_id * 7 + {i % 4 * 3 + i // 4} * 31) % 256 / 255.0::DOUBLE, 6) AS t{i}" for i in (0, 3, 4, 7, 11)) + " FROM embeddings",
        "flip_augment": f"""WITH {_RASTER}, h AS (SELECT count(*) AS h FROM embeddings), p AS (SELECT *, y // 64 AS patch, least(64, h - y // 64 * 64) AS size FROM raster, h)
SELECT y, x, band, (patch * 64 + CASE WHEN {_coin("patch", 1, "v")} THEN size - 1 - y % 64 ELSE y % 64 END)::INTEGER AS to_y,
  (CASE WHEN {_coin("patch", 1, "h")} THEN 20 - x ELSE x END)::INTEGER AS to_x FROM p""",
        "split_transform": f"""WITH {_SPLIT}, t AS (SELECT *, i // 21 AS c, i % 21 AS x FROM split, unnest(range(63)) u(i)),
f AS (SELECT *, CASE WHEN split = 'train' AND {_coin('vec_id', 2, 'h')} THEN 20 - x ELSE x END AS from_x FROM t)
SELECT vec_id, split, i::INTEGER AS i, round(((vec_id * 7 + (from_x * 3 + c) * 31) % 256 / 255.0::DOUBLE - ({list(config.CHANNEL_MEAN)}::DOUBLE[])[c + 1]) / ({list(config.CHANNEL_STD)}::DOUBLE[])[c + 1], 6) AS t FROM f""",
        "resize_bilinear": """WITH o AS (SELECT i, least(7, greatest(0, (i // 48 + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) AS y, least(7, greatest(0, (i % 48 // 3 + 0.5::DOUBLE) / 2 - 0.5::DOUBLE)) AS x, i % 3 AS c FROM unnest(range(768)) t(i))
SELECT vec_id, string_agg(upper(printf('%02x', floor(vec_id % 50 + 8 * y + 3 * x + 20 * c + 0.5::DOUBLE)::INTEGER)), '' ORDER BY i) AS q FROM embeddings, o GROUP BY 1""",
        "predict_batch": "WITH l AS (SELECT vec_id, [" + ", ".join(f"({_linear(k)})::FLOAT" for k in range(10)) + "] AS l FROM embeddings) "
        "SELECT vec_id, (list_position(l, list_max(l)) - 1)::INTEGER AS pred, round(l[10]::DOUBLE, 3) AS logit9 FROM l",
        "labelled_folder": f"WITH {_FILES}, ranks AS (SELECT class_name, (row_number() OVER (ORDER BY class_name) - 1)::INTEGER AS label FROM (SELECT DISTINCT class_name FROM files)) "
        "SELECT path, class_name, label FROM files JOIN ranks USING (class_name)",
        "folder_class_counts": f"WITH {_FILES}, {_CLASSES} SELECT c.label, c.class_name, count(path)::BIGINT AS n FROM classes c LEFT JOIN files f ON f.class_name = c.class_name GROUP BY 1, 2",
        "folder_class_root": "SELECT '/data/n' || n_nationkey AS parent FROM nation WHERE n_nationkey % 4 = 0",
        "loss_year_window": "SELECT o_orderkey, o_orderkey % 25 > 1 AND o_orderkey % 25 <= 16 AS lost FROM orders",
        "pixel_index_ranges": f"""WITH {_CELLS}, b AS (SELECT row, col, {_BOUNDS} FROM cells),
i AS (SELECT row, col, greatest(0, floor((top - 8999000) / -30.0::DOUBLE)) AS a, least(300, floor((bottom - 8999000) / -30.0::DOUBLE)) AS b,
  greatest(0, floor(("left" - 1000) / 30.0::DOUBLE)) AS c, least(400, floor(("right" - 1000) / 30.0::DOUBLE)) AS d FROM b)
SELECT row, col, least(a, b)::INTEGER AS r0, greatest(a, b)::INTEGER AS r1, least(c, d)::INTEGER AS c0, greatest(c, d)::INTEGER AS c1 FROM i""",
        "raster_window": """SELECT (o_orderkey // 300)::INTEGER AS pr, (o_orderkey % 300)::INTEGER AS pc FROM orders
WHERE o_orderkey // 300 BETWEEN 2 AND 3 AND o_orderkey % 300 BETWEEN 50 AND 199""",
        "utm_project": _utm(),
    }
    return sql
