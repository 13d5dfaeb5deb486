"""Intermediate tables in the cluster's shared folder, and small frame helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir.  Where that is unset a temporary
    folder serves a local master, whose executors see it; any other master is an error, since each
    executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='geoloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """For the actions inside: shuffle files go as soon as an action has ended, and Arrow batches
    are small, which bounds what JVM and Python hold of long texts."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost
    executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoloom/{name}-{uuid.uuid4().hex}"
    with lean(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renewed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (matched as Spark does, any case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def per_batch(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def shielded(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its own columns of these names set aside, and what gives it back its shape."""
    low, columns = {n.lower() for n in names}, docs.columns
    aside = {c: f"_own_{i}" for i, c in enumerate(columns) if c.lower() in low}

    def restore(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in columns])

    return docs.withColumnsRenamed(aside), restore


def discarded(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what this application's operators have left in the shared folder; call it once results
    are out."""
    discarded(spark, f"{shared_folder(spark)}/geoloom")
