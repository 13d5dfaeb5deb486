"""Connected components of a distributed edge table by alternating large and small stars.

First each task puts the links it has read into trees of its own, a bounded number at a time, so only
a link per node goes on.  Then each round is two map-side-combined aggregates and two equi-joins on the
edge table, which is written to the shared folder between rounds; rounds grow with the logarithm of
the longest chain, and there is none if the trees of the tasks do not touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.workspace import stored

FLUSH = 1_000_000


def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of links (a, b), without roots themselves; the root is the
    smallest node.  Roots are hooked to smaller ones and paths halved until nothing moves."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        u, v = up[x], up[y]
        apart = u != v
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while not (up[up] == up).all():
            up = up[up]
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[below], nodes[up[below]]


def _planted(batches):
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FLUSH:
            yield _grown(held)
            held, size = [], 0
    if held:
        yield _grown(held)


def _grown(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    node, root = trees(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("u", "v")))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has one."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(1).alias("above")))
    seen = ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("above").alias("above"))
    return seen.where("lo IS NOT NULL AND (lo != hi OR above = 1)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) from links (a, b) of 64-bit nodes: root is the smallest node reachable.  Only nodes
    that have a link appear; each root appears with itself.  Loops and repeated links do no harm; no
    links give an empty table."""
    pairs = links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u != v").distinct()
    edges = stored(pairs.mapInArrow(_planted, "u long, v long"), name)
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")  # so that the join can split a hub
        large = stored(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u != v").distinct(), name)
    return edges.distinct().select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
