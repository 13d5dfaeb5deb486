"""Operator 10: mixing sources to target weights.

Tokens (words) are summed per source; a source's target is its weight's share of the total,
stopped at ``max_rate`` times what it has, the excess going to the others by weight until none is
above.  That fixed point is a water level L with target = min(cap, L * weight): it starts as if
none were stopped and is raised by what those over their cap leave, until no more go over.  The rate is target / size; a document is taken
floor(rate) times, plus once more if a uniform hash of (seed, doc_id) lies below the fraction.

Scale: one map-side-combined aggregate over the documents, then work on one row per source.  The
rates are joined back by broadcast only while the sources number at most ``broadcast_sources``;
beyond that it is an ordinary join whose skewed source AQE splits.  Sources may be as many as hosts:
their ranks come from ranges (a row per range is summed in order) and the water level from a few
aggregates, exact sums of whole numbers, so no task holds them all.

Defined results: a null source is a source of its own, last in order; null or wordless text has
size 0 and is taken 0 words; a source without words has target 0; an empty table gives no rows;
rows of one doc_id share one coin, and reruns agree, since only the id is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.workspace import renewed, stored

WEIGHTS = (1, 2, 3)
MAX_RATE = 3.0
SEED = 20240501
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """MD5 of the seed and a key (null: "null") as a number in [0, 1)."""
    name = F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point with null last: places within ranges, and where each range begins."""
    key = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranged = stored(sizes.repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1
    return ranged.withColumn("place", place).join(first, "range").withColumn("rank", F.col("first") + F.col("place")).drop("range", "place", "first")


def water_level(table: DataFrame, max_rate: float) -> float:
    """L for which the sum of min(max_rate * size, L * weight) is the sum of sizes; (source_size, weight)."""
    total, weights = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = total / weights if weights else float("inf")
    while True:
        over = F.col("source_size") * F.lit(float(max_rate)) / F.col("weight") < F.lit(level)
        full, free = table.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        higher = (total - max_rate * full) / free if free else float("inf")
        if higher <= level:
            return level
        level = higher


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """From (source, source_size): _source, source_size, weight, target and rate of each source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(_ranked(sizes).select("source", "source_size", weight.alias("weight")), "mix-weights")
    target = F.least(F.col("source_size") * F.lit(float(max_rate)), F.lit(water_level(table, max_rate)) * F.col("weight"))
    return table.withColumn("target", target).select(
        F.col("source").alias("_source"), "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"),
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    max_rate: float = MAX_RATE, seed: int = SEED, broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, weight, target, rate, copies and taken; one
    row per document.  ``emitted`` repeats the rows."""
    docs = renewed(docs, "size", "source_size", "weight", "target", "rate", "copies", "taken")
    sized = docs.withColumn("size", n_words(F.col(text_col)))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    rates = source_rates(sizes, weights, max_rate)
    few = rates.count() <= broadcast_sources
    joined = sized.join(F.broadcast(rates) if few else rates, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
    coin = (uniform(seed, F.col(id_col)) < F.col("rate") - F.floor("rate")).cast("int")
    return joined.withColumn("copies", (F.floor("rate") + coin).cast("int")).withColumn("taken", F.col("size") * F.col("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row ``copies`` times."""
    return mixed.withColumn("_copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))).drop("_copy")
