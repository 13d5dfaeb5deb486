"""The corpus pipeline: classify, deduplicate, decontaminate, mix, and write token records.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of
documents, also where a column has the name of one that an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.decontaminate import decontaminate
from geoloom.llm.mixing import emitted, mix_sources
from geoloom.llm.ngram_join import keep_one
from geoloom.llm.quality import resample
from geoloom.llm.queries import VOCABULARY
from geoloom.llm.token_output import training_order
from geoloom.llm.workspace import shielded, stored
from geoloom.shipping import shipping


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the importance resampling rejects go."""
    own, restore = shielded(docs, ("log_weight", "gumbel_key", "kept"))
    return restore(resample(own, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each component of near duplicates stays."""
    own, restore = shielded(docs, ("_class", "_n", "_id", "_keeper", "_place"))
    return restore(keep_one(own))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a passage of the benchmark go."""
    own, restore = shielded(docs, ("n_words", "n_hit", "n_items", "items", "hits", "items_sha256", "contaminated"))
    return restore(decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents are repeated or left out so that sources meet their targets."""
    own, restore = shielded(docs, ("size", "source_size", "weight", "target", "rate", "copies", "taken", "_source", "_copy"))
    return restore(emitted(mix_sources(own)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token records in training order."""
    return training_order(docs, VOCABULARY).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", shipping(classify)),
    ("n-gram Jaccard join", shipping(deduplicate)),
    ("benchmark decontamination", shipping(decontaminated)),
    ("mixing sources to target weights", shipping(mix)),
    ("token-ID / binary output", shipping(tokens)),
]

#: Components, Gumbel draws and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
