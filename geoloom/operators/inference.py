"""Batched model inference and the model head."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from geoloom.config import CHANNEL_MEAN, CHANNEL_STD, INFERENCE_BATCH, PATCH
from geoloom.functions.vectors import doubles


def linear_model(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable]:
    """Maker of a predict function x -> x @ weights.T + bias."""

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return (x.astype(np.float64) @ weights.T.astype(np.float64) + bias).astype(np.float32)

        return predict

    return make


def infer(df: DataFrame, features: str, make: Callable[[], Callable], size: int, batch_size: int = INFERENCE_BATCH) -> DataFrame:
    """Adds logits.  ``make`` runs once per Python worker; batches travel by Arrow.  The result is
    marked nondeterministic so that a gate on it does not run the model twice; filter by other
    columns before this operator."""
    udf = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[size]])
    return df.withColumn("logits", udf.asNondeterministic()(features) if hasattr(udf, "asNondeterministic") else udf(features))


def pooled(tensor: np.ndarray, parts: int = 4) -> np.ndarray:
    """(batch, channels, H, W) normalised tensors to features: mean and spread of each channel in parts x
    parts fields, and the mean size of its steps across and down."""
    b, c, h, w = tensor.shape
    fields = tensor[:, :, : h // parts * parts, : w // parts * parts].reshape(b, c, parts, h // parts, parts, w // parts)
    steps = [np.abs(np.diff(tensor, axis=k)).mean((2, 3)) for k in (2, 3)]
    return np.concatenate([fields.mean((3, 5)).reshape(b, -1), fields.std((3, 5)).reshape(b, -1), *steps], 1)


def pixel_features(
    patches: DataFrame, pixels: str = "pixels", size: int = PATCH, backbone: Callable[[], Callable] | None = None, batch_size: int = INFERENCE_BATCH,
    mean: tuple[float, ...] = CHANNEL_MEAN, std: tuple[float, ...] = CHANNEL_STD,
) -> DataFrame:
    """Adds features: interleaved bytes become unit tensors, are normalised and go through a backbone, all
    in one batched step.  ``backbone`` makes a function of (batch, channels, size, size) float arrays, once
    per worker; by default ``pooled`` stands for it.  A patch without pixels has no features."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = backbone() if backbone else pooled
        centre, spread = (np.array(x, np.float32)[None, :, None, None] for x in (mean, std))
        for series in blobs:
            out = [None] * len(series)
            there = [i for i, b in enumerate(series) if b is not None]
            for at in range(0, len(there), batch_size):
                some = there[at : at + batch_size]
                raw = np.stack([np.frombuffer(series.iloc[i], np.uint8).reshape(size, size, len(mean)) for i in some])
                made = net((raw.transpose(0, 3, 1, 2).astype(np.float32) / np.float32(255) - centre) / spread)
                for i, row in zip(some, np.asarray(made, np.float32), strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return patches.withColumn("features", run(pixels))


def head_features(df: DataFrame, embedding: str, label: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(doubles(F.col(embedding)))).withColumn("label", F.col(label).cast("double"))


def fit_head(train: DataFrame, max_iter: int = 50, reg: float = 1e-3) -> LogisticRegressionModel:
    """Ten-way linear head on frozen features, fitted by L-BFGS with distributed gradients."""
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(train)


def fit_tuned(train: DataFrame, layers: list[int], max_iter: int = 60, seed: int = 42):
    """The second phase: all weights of a small network."""
    return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed, stepSize=0.03).fit(train)


def predict(model: Transformer, df: DataFrame) -> DataFrame:
    """Adds pred and probability."""
    return model.transform(df).withColumns({"pred": F.col("prediction").cast("int"), "probability": vector_to_array("probability")})


def log_loss(probability: Column, label: Column) -> Column:
    return -F.ln(F.greatest(F.lit(1e-12), F.get(probability, label.cast("int"))))


def parameter_table(spark: SparkSession, model: LogisticRegressionModel, frozen: int = 0) -> DataFrame:
    """(name, numel, requires_grad) of the head, and of a frozen backbone of ``frozen`` numbers."""
    rows = [("backbone", frozen, False), ("head.weight", model.numClasses * model.numFeatures, True), ("head.bias", model.numClasses, True)]
    return spark.createDataFrame(rows, "name string, numel long, requires_grad boolean")
