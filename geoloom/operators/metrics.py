"""Scores of detections and of classifiers, each from one aggregation over long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.vectors import cross_entropy


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def detection_counts(pairs: DataFrame, keys: tuple[str, ...] = (), detected: str = "change", reference: str = "ref") -> DataFrame:
    """detected and reference cells, true and false positives, false negatives; one pass."""
    d, r = F.col(detected), F.col(reference)
    return pairs.groupBy(*keys).agg(
        F.count_if(d).alias("detected_cells"), F.count_if(r).alias("reference_cells"), F.count_if(d & r).alias("true_positives"),
        F.count_if(d & ~r).alias("false_positives"), F.count_if(~d & r).alias("false_negatives"),
    )


def detection_scores(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Adds precision, recall, f1 and iou; f1 is taken before rounding."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    scores = {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "iou": ratio(tp, tp + fp + fn)}
    return counts.withColumns({k: F.round(v, digits) for k, v in scores.items()})


def threshold_sweep(changed: DataFrame, fractions: DataFrame, thresholds: DataFrame, keys: tuple[str, ...], digits: int = 4, most: int = 10_000) -> DataFrame:
    """Scores at each min_loss_frac of a table of thresholds.  They are collected and sent along as one
    array, so more than ``most`` are refused."""
    swept_at = [r[0] for r in thresholds.select("min_loss_frac").limit(most + 1).collect()]
    if len(swept_at) > most:
        raise ValueError(f"more than {most} thresholds")
    cells = changed.select(*keys, "change").join(fractions.select(*keys, "loss_frac"), list(keys), "left")
    swept = cells.withColumn("min_loss_frac", F.explode(F.lit(swept_at))).withColumn("ref", F.coalesce(F.col("loss_frac") > F.col("min_loss_frac"), F.lit(False)))
    return detection_scores(detection_counts(swept, ("min_loss_frac",)), digits)


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def confusion_long(pairs: DataFrame) -> DataFrame:
    """(label, pred, n)."""
    return pairs.groupBy("label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, classes: DataFrame, n_classes: int) -> DataFrame:
    """(label, p0, p1, ...): rows are actual classes, all of them; absent pairs are 0."""
    wide = pairs.groupBy("label").agg(*[F.count_if(F.col("pred") == k).alias(f"p{k}") for k in range(n_classes)])
    return classes.select("label").join(wide, "label", "left").fillna(0)


def classification_report(pairs: DataFrame, classes: DataFrame, digits: int = 4) -> DataFrame:
    """(name, precision, recall, f1, support) per class, then accuracy, macro avg, weighted avg."""
    sides = confusion_long(pairs)
    per = sides.select(F.explode(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select("s.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    all_classes = classes.select("label", "class_name").join(per, "label", "left").fillna(0, ["support", "predicted", "tp"])
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    scored = all_classes.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})
    measures = ("precision", "recall", "f1")
    total = scored.agg(
        F.sum("support").alias("support"), ratio(F.sum("tp"), F.sum("support")).alias("acc"), *[F.avg(m).alias(f"m_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"w_{m}") for m in measures],
    )

    def line(name: str, columns: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("name"), *[c.alias(m) for c, m in zip(columns, measures, strict=True)], F.col("support").alias("support"))

    summary = total.select(F.explode(F.array(
        line("accuracy", [F.col("acc")] * 3), line("macro avg", [F.col(f"m_{m}") for m in measures]), line("weighted avg", [F.col(f"w_{m}") for m in measures]),
    )).alias("s")).select("s.*")
    lines = scored.select(F.col("class_name").alias("name"), *measures, "support").unionByName(summary)
    return lines.withColumns({m: F.round(m, digits) for m in measures})


def mean_cross_entropy(rows: DataFrame, logits: Column, label: Column) -> DataFrame:
    return rows.select(cross_entropy(logits, label).alias("l")).agg(F.avg("l").alias("loss"), F.count("*").alias("n"))


def weighted_mean_loss(batches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum(loss * n) / sum(n) over batches(loss, n)."""
    return batches.groupBy(*keys).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def trainable_parameters(parameters: DataFrame) -> DataFrame:
    """Sum of numel over parameters(numel, requires_grad) that are trained."""
    return parameters.agg(F.coalesce(F.sum(F.when(F.col("requires_grad"), F.col("numel"))), F.lit(0)).alias("n_trainable"))
