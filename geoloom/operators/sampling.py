"""Seeded exact-count splits, mini-batches, epoch order, training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.config import SEED, TRAIN_SHARE, VAL_SHARE


def order_key(key: Column, seed: int | str = SEED) -> Column:
    """A hash that orders rows as if shuffled: md5 of "seed-key"."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def _ranked(rows: DataFrame, place: str, key: str, bits: int) -> DataFrame:
    """Adds _rank, from 0 by (place, key), and _total; place is a hexadecimal hash."""
    hashed = rows.withColumn("_b", F.conv(F.substring(place, 1, bits // 4), 16, 10).cast("int"))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))  # 2**bits rows at most
    sizes = sizes.withColumns({
        "_first": F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_n").over(Window.partitionBy()),
    })
    ranked = hashed.join(F.broadcast(sizes), "_b").withColumn("_rank", F.col("_first") + F.row_number().over(Window.partitionBy("_b").orderBy(place, key)) - 1)
    return ranked.drop("_b", "_n", "_first")


def exact_split(rows: DataFrame, key: str, train: float = TRAIN_SHARE, val: float = VAL_SHARE, seed: int = SEED, bits: int = 12) -> DataFrame:
    """Adds split: int(train * n) rows "train", int(val * n) "val", the rest "test", by rank of a
    seeded hash; membership depends on key and seed only.

    No global sort: rows are counted per leading hash bits (a bounded table), which gives each
    bucket its first rank, and ranked within the bucket."""
    ranked = _ranked(rows.withColumn("_h", order_key(F.col(key), seed)), "_h", key, bits)
    n_train, n_val = F.floor(F.col("_total") * train), F.floor(F.col("_total") * val)
    split = F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_h", "_total", "_rank")


def batches(rows: DataFrame, place: str, key: str, size: int, bits: int = 12) -> DataFrame:
    """Adds batch: consecutive rows by ``place`` (a hexadecimal hash, as of ``epoch_order``) and key, ``size``
    to a batch, the last one kept.  Ranked as in ``exact_split``, without a global sort."""
    ranked = _ranked(rows, place, key, bits)
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size).cast("int")).drop("_total", "_rank")


def epoch_order(rows: DataFrame, key: str, epoch: int, seed: int = SEED) -> DataFrame:
    """Rows with ``place``, a hash that orders this epoch's pass; sort by it to read them shuffled."""
    return rows.withColumn("place", order_key(F.col(key), f"{seed}-{epoch}"))


def best_epoch(history: DataFrame, key: str = "seq", measure: str = "val_acc") -> DataFrame:
    """The row of the highest measure above 0, the earliest on ties; an aggregate, not a sort."""
    top = history.where(F.col(measure) > 0).agg(F.max_by(F.struct(*history.columns), F.struct(F.col(measure), -F.col(key))).alias("r"))
    return top.where("r IS NOT NULL").select("r.*")


def running_best(history: DataFrame, key: str = "seq", measure: str = "val_acc", partition: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_best: strictly above every earlier measure and above 0."""
    before = Window.partitionBy(*partition).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("is_best", F.col(measure) > F.coalesce(F.greatest(F.max(measure).over(before), F.lit(0.0)), F.lit(0.0)))
