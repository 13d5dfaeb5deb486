"""Operator 9: quality classification by importance resampling.

Two generative models over hashed word unigrams and bigrams (a table of 2**bits buckets for each of
the two) are counted: t over target text (labelled good and not toxic), r over the whole corpus.  With
E = r * T / R what the target would show if it were like the corpus, q = (E + c) / (t + c) is how much
likelier an n-gram is in the corpus than in target text; c holds buckets with little data near one.
What the corpus has beyond ``margin`` times the target (the margin allows for copies, which come in
clusters) is other text: other(w) = target(w) * (q - margin)+ / Z, with Z its share.  The corpus's
model of a document draws each n-gram from other text with probability ``rate`` and from the target
model else, so a document's log weight is

    log p_target - log p_corpus = - sum over its n-grams of log(1 - rate + rate * (q - margin)+ / Z)

Every ordinary n-gram speaks for a document by a little and every strange one against it by a lot,
whatever the length.  Documents are drawn without replacement by Gumbel top-k: key = log weight /
``temperature`` + Gumbel(hash of the id), the k largest keys stay.  k is the number of documents whose
weight reaches the floor that all but ``clean_loss`` of held-out clean labelled documents reach.

Scale: three passes over the texts and no shuffle of any text.  Counts of all documents are
packed sparsely and summed in slices over a tree.  Buckets grow as the square root of the corpus, as
vocabularies do, up to 2**24, which bounds what is broadcast (2 * 2**bits floats, 128 MB at most).
The fit uses at most ``label_limit`` labelled rows, the smallest by a hash of the id (the bound of what
is collected and broadcast); of these every fifth is held out for the floor.  The k-th key is found by
refining a histogram of keys, never by collecting them.

Defined results: null, empty and wordless texts have log weight 0, which always reaches the floor; a
null id hashes as "null"; rows of one id share their Gumbel draw, and count for the floor by the least
of their weights; ties at the k-th key stay; without labels, or without clean held-out ones,
everything stays; an empty table gives an empty result.  Labels repeated for one id count once, the
worst of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.mixing import uniform
from geoloom.llm.textkernel import NON_SPACE, U64, inner, pieces, windows, words_of
from geoloom.llm.workspace import renewed, stored

LEAST_BITS, MOST_BITS = 18, 24
PRIOR = 2.0
MARGIN = 2.72
RATE = 0.01
LEAST_SHARE = 0.01
TEMPERATURE = 0.5
LABEL_LIMIT = 50_000
CLEAN_LOSS = 0.002
SEED = 97
SLICE = 4096
FLUSH = 1_000_000


def table_bits(text_bytes: int) -> int:
    """2**20 buckets for 2**26 n-grams (three bytes of text each), twice as many for four times the text."""
    return int(min(MOST_BITS, max(LEAST_BITS, 20 + np.ceil(np.log2(max(1, text_bytes / 3) / 2**26) / 2))))


def ngram_buckets(batch: pa.RecordBatch, text_col: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each n-gram, its bucket) for unigrams and bigrams."""
    w = words_of(batch.column(text_col), NON_SPACE, lower=True)
    pair, shift = inner(w, 2), U64(64 - bits)
    words, pairs = w.hashes >> shift, (windows(w.hashes, 2)[pair] >> shift) + U64(1 << bits)
    text = w.text_of
    return np.concatenate((text, text[pair])), np.concatenate((words, pairs)).astype(np.int64)


def _labelled(labels: DataFrame, id_col: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of clean labelled documents, to train on and held out."""
    worst = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("clean"))
    place = F.xxhash64(F.col(id_col).cast("long"), F.lit(5))
    rows = worst.select(F.col(id_col).cast("long").alias("id"), "clean", place.alias("place")).orderBy("place", "id").limit(limit).toPandas()
    clean = rows[rows["clean"].fillna(False).astype(bool)]
    held = (clean["place"].to_numpy(np.int64) % 5) == 0
    ids = clean["id"].to_numpy(np.int64)
    return np.sort(ids[~held]), np.sort(ids[held])


def _member(batch: pa.RecordBatch, id_col: str, among: np.ndarray) -> np.ndarray:
    ids = batch.column(id_col).cast(pa.int64())
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), among) & ids.is_valid().to_numpy(zero_copy_only=False)


def _packed(counts: np.ndarray) -> bytes:
    """A slice of counts: how many are not zero, their places, one byte each, and those of 255 and more in full."""
    place = np.flatnonzero(counts)
    own = counts[place]
    return b"".join((np.array([len(place)], "<u4").tobytes(), place.astype("<u2").tobytes(), np.minimum(own, 255).astype("u1").tobytes(), own[own >= 255].astype("<i8").tobytes()))


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros(SLICE, np.int64)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    own = np.frombuffer(raw, "u1", n, 4 + 2 * n).astype(np.int64)
    own[own == 255] = np.frombuffer(raw, "<i8", -1, 4 + 3 * n)
    out[np.frombuffer(raw, "<u2", n, 4)] = own
    return out


def _summed(table: pa.Table) -> pa.Table:
    out = {"slice": table.column("slice")[:1], "part": pa.array([table.column("part")[0].as_py() >> 8], pa.int32())}
    for c in ("raw", "target"):
        out[c] = pa.array([_packed(sum(_unpacked(blob.as_py()) for blob in table.column(c)))], pa.binary())
    return pa.table(out)


def ngram_counts(docs: DataFrame, id_col: str, text_col: str, train: np.ndarray, bits: int) -> DataFrame:
    """(slice, raw, target): bucket counts of all documents and of those to train on, 2 * 2**bits
    numbers each in packed slices; slices without any are left out."""
    size = 2 << bits
    chosen = docs.sparkSession.sparkContext.broadcast(train)
    schema = "slice int, part int, raw binary, target binary"

    def count(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sums = {"raw": np.zeros(size, np.int32), "target": np.zeros(size, np.int32)}
        held: dict[str, list[np.ndarray]] = {"raw": [], "target": []}

        def add(name: str, bucket: np.ndarray, least: int = FLUSH) -> None:
            held[name].append(bucket)
            if sum(map(len, held[name])) >= least:
                own, n = np.unique(np.concatenate(held[name]), return_counts=True)
                sums[name][own] += n.astype(np.int32)
                held[name].clear()

        for whole in batches:
            for batch in pieces(whole, text_col):
                text, bucket = ngram_buckets(batch, text_col, bits)
                add("raw", bucket)
                on = _member(batch, id_col, chosen.value)
                if on.any():
                    add("target", bucket[on[text]])
        for name in sums:
            add(name, np.zeros(0, np.int64), 0)
        raw, target = sums["raw"], sums["target"]
        for i in range(0, size, SLICE):
            a, b = raw[i : i + SLICE], target[i : i + SLICE]
            if a.any():
                yield pa.RecordBatch.from_pylist([{"slice": i // SLICE, "part": part >> 8, "raw": _packed(a), "target": _packed(b)}], pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("raw", pa.binary()), ("target", pa.binary())]))

    parts = docs.select(id_col, text_col).mapInArrow(count, schema)
    sums = parts.groupBy("slice", "part").applyInArrow(_summed, schema).groupBy("slice").applyInArrow(_summed, schema)
    return stored(sums.select("slice", "raw", "target"), "quality-counts")


def excess(raw: np.ndarray, target: np.ndarray, scale: float, prior: float, margin: float) -> np.ndarray:
    """(q - margin)+ of each bucket."""
    return np.maximum(0.0, (raw * scale + prior) / (target + prior) - margin)


def evidence(counts: DataFrame, bits: int, prior: float = PRIOR, margin: float = MARGIN, rate: float = RATE) -> np.ndarray:
    """The model: what an n-gram of each bucket adds to a log weight, worked out per slice where the counts are."""

    def totals(batches):
        for batch in batches:
            both = [sum(int(_unpacked(x.as_py()).sum()) for x in batch.column(c)) for c in ("raw", "target")]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in both], ["raw", "target"])

    raw, target = counts.mapInArrow(totals, "raw long, target long").agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    scale = target / max(1, raw)

    def pairs(batch):
        return zip(map(_unpacked, batch.column("raw").to_pylist()), map(_unpacked, batch.column("target").to_pylist()), strict=True)

    def other(batches):
        for batch in batches:
            mass = [float((excess(r, t, scale, prior, margin) * (t + prior)).sum()) for r, t in pairs(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(mass, pa.float64())], ["slice", "mass"])

    # rounded, so that the order of addition cannot show
    mass = counts.mapInArrow(other, "slice int, mass double").agg(F.coalesce(F.sum(F.col("mass").cast("decimal(30,6)")), F.lit(0))).first()[0]
    share = max(LEAST_SHARE, float(mass) / max(1, target))

    def added(r: np.ndarray, t: np.ndarray) -> np.ndarray:
        return -np.log(1 - rate + rate * excess(r, t, scale, prior, margin) / share).astype(np.float32)

    def weights(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array([added(r, t).tobytes() for r, t in pairs(batch)], pa.binary())], ["slice", "weight"])

    model = np.full(2 << bits, added(np.zeros(1), np.zeros(1))[0], np.float32)
    for row in counts.mapInArrow(weights, "slice int, weight binary").toLocalIterator():
        model[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["weight"], np.float32)
    return model


def weighed(docs: DataFrame, text_col: str, model: np.ndarray) -> DataFrame:
    """All columns of ``docs`` plus log_weight."""
    table, bits = docs.sparkSession.sparkContext.broadcast(model), int(np.log2(len(model) // 2))
    docs = renewed(docs, "log_weight")
    shaped = docs.withColumn("log_weight", F.lit(0.0))
    names = shaped.columns

    def score(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                text, bucket = ngram_buckets(batch, text_col, bits)
                weight = np.round(np.bincount(text, weights=table.value[bucket], minlength=batch.num_rows), 9) + 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names)

    return docs.mapInArrow(score, shaped.schema)


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest of the column ``key``, by counting ever finer bins."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return float("-inf")
    rest = k
    while True:
        inside = keys.where(F.col("key").between(low, high))
        width = (high - low) / bins
        if n <= few or width <= 0 or low + width == low:
            return sorted((r["key"] for r in inside.groupBy("key").count().limit(few).collect() for _ in range(r["count"])), reverse=True)[rest - 1] if n <= few else low
        place = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / width)).cast("int")
        rows = {r["place"]: r for r in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for i in sorted(rows, reverse=True):
            if rows[i]["n"] >= rest:
                low, high, n = rows[i]["lo"], rows[i]["hi"], rows[i]["n"]
                break
            rest -= rows[i]["n"]


def gumbel_key(log_weight, id_col: str, seed: int):
    u = uniform(seed, F.col(id_col)) + F.lit(0.5 / (1 << 52))
    return log_weight - F.log(-F.log(u))


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, prior: float = PRIOR, margin: float = MARGIN,
    rate: float = RATE, label_limit: int = LABEL_LIMIT, clean_loss: float = CLEAN_LOSS, temperature: float = TEMPERATURE, seed: int = SEED, k: int | None = None,
) -> DataFrame:
    """All columns of ``docs`` plus log_weight, gumbel_key and kept.  ``k`` sets the number to
    keep; by default the held-out floor decides it.  ``bits`` by default follow the size of the texts."""
    train, held = _labelled(labels, id_col, label_limit)
    if bits is None:
        bits = table_bits(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    model = evidence(ngram_counts(docs, id_col, text_col, train, bits), bits, prior, margin, rate)
    scores = stored(weighed(docs.select(id_col, text_col), text_col, model).select(id_col, "log_weight"), "quality-scores")
    chosen = docs.sparkSession.sparkContext.broadcast(held)

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(_member(batch, id_col, chosen.value)))

    clean = scores.mapInArrow(pick, scores.schema).groupBy(id_col).agg(F.min("log_weight").alias("w")).toPandas()["w"].to_numpy()
    floor = min(-1e-6, float(np.quantile(clean, clean_loss)) if len(clean) else float("-inf"))
    scaled = F.col("log_weight") / F.lit(temperature)
    keys = scores.select(gumbel_key(scaled, id_col, seed).alias("key"), "log_weight")
    if k is None:
        k = keys.where(F.col("log_weight") >= F.lit(floor)).count()
    cut = kth_largest(keys, k) if k else float("inf")
    out = weighed(renewed(docs, "log_weight", "gumbel_key", "kept"), text_col, model)
    return out.withColumn("gumbel_key", gumbel_key(scaled, id_col, seed)).withColumn("kept", F.col("gumbel_key") >= F.lit(cut))
