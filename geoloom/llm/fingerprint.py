"""Operator 2: document fingerprints as threshold-scaled sketches.  Built-in functions only.

A fingerprint keeps every hash of a five-word shingle that lies below a fixed fraction of the hash
range.  Membership depends on the shingle alone, so sketches of any two texts are comparable,
the sketch of a union is the union of sketches, and containment can be estimated between texts of
very unequal length: |A and B| / |A| over the kept hashes.  Where nothing is kept (a text of n
shingles: with probability 0.75**n) a hash of the whole set of shingles stands in its place.

Scale: a sketch is computed in the scan.  The next document is found without any global window: quantiles of the id (a bounded list, as long as the row count asks) cut the ids into
ranges, an id that fills several quantiles is cut further by a hash of its texts, each range is one
window group, and the first row of each range is copied to the range before it (one row per range).

Defined results: words are runs of characters other than space and U+0009-000D, lower-cased; a
text of one to four words is one shingle; null counts as the empty text; two empty sketches are
alike (1.0) if their whole sets are the same, as those of texts without words are, and else not
(0.0).  Null ids come last in descending order; rows of one id are ordered by a hash of their text.
The only row of a table is its own next one; an empty table gives an empty result.  Column names
that begin with ``_geoloom`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.workspace import renewed

SHINGLE = 5
FRACTION = 0.25
RANGE_ROWS = 5_000
MOST_RANGES = 65_536  # bounds the list of borders; rows of a range grow only beyond RANGE_ROWS times this
_HASHES, _RANGE, _TIE, _COPY = "_geoloom_hashes", "_geoloom_range", "_geoloom_tie", "_geoloom_copy"


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words, of the whole text if it has fewer, none if it has none; from a
    column (not an expression) of word hashes."""
    n = F.size(hashes)
    full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, full).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def sketch_of(shingles: Column, fraction: float = FRACTION) -> Column:
    """Sorted shingle hashes below the threshold."""
    limit = F.lit(int(-(1 << 63) + (1 << 64) * fraction))
    return F.sort_array(F.array_distinct(F.filter(shingles, lambda h: h < limit)))


def n_shingles(hashes: Column, k: int = SHINGLE) -> Column:
    return F.when(F.size(hashes) > 0, F.greatest(F.lit(1), F.size(hashes) - (k - 1))).otherwise(0)


def whole_set(sketch: Column, hashes: Column) -> Column:
    """A hash of the set of all shingles, where the sketch is empty; else null."""
    return F.when(F.size(sketch) == 0, F.xxhash64(F.sort_array(F.array_distinct(shingle_hashes(hashes)))))


def _hexadecimal(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def as_text(sketch: Column, n: Column, whole: Column) -> Column:
    """The fingerprint string: number of shingles, then the kept hashes in hexadecimal, or "=" and the
    hash of the whole set."""
    kept = F.array_join(F.transform(sketch, _hexadecimal), "")
    return F.concat(n.cast("string"), F.lit(":"), F.when(whole.isNull(), kept).otherwise(F.concat(F.lit("="), _hexadecimal(whole))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a's sketch is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a))


def jaccard(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Estimated likeness; of two empty sketches 1.0 if the whole sets agree, else 0.0."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.when(whole_a == whole_b, 1.0).otherwise(0.0)).cast("double")


def merged(sketches: Column) -> Column:
    """The sketch of a union of texts, from an array of sketches."""
    return F.sort_array(F.array_distinct(F.flatten(sketches)))


def with_sketch(docs: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Adds <prefix>sketch (hashes), <prefix>n (shingles) and <prefix>whole (hash of the whole set,
    null if the sketch has hashes)."""
    hashed = docs.withColumn(_HASHES, word_hashes(text))
    made = hashed.withColumns({f"{prefix}sketch": sketch_of(shingle_hashes(F.col(_HASHES))), f"{prefix}n": n_shingles(F.col(_HASHES))})
    return made.withColumn(f"{prefix}whole", whole_set(F.col(f"{prefix}sketch"), F.col(_HASHES))).drop(_HASHES)


def _ranged(docs: DataFrame, id_col: str, n: int) -> DataFrame:
    """Adds the range, which rises as the id falls (null ids: the last range).  An id that equals m
    borders has m + 1 ranges, by its tie."""
    want = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = sorted((float(x) for x in docs.approxQuantile(id_col, [(i + 1) / want for i in range(want - 1)], 0.2 / want)), reverse=True) if want > 1 else []
    if not bounds:
        return docs.withColumn(_RANGE, F.when(F.col(id_col).isNull(), 1).otherwise(0))
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads, fine = F.array(*[F.lit(b[0]) for b in blocks]), F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])

    def passed(docs: DataFrame, name: str, before) -> DataFrame:
        """Adds how many borders come before the id: whole blocks first, then the last block begun."""
        docs = docs.withColumn(f"{name}_block", F.size(F.filter(heads, before)))
        last = F.col(f"{name}_block") - 1
        return docs.withColumn(name, F.when(last >= 0, F.size(F.filter(F.get(fine, last), before)) + last * step).otherwise(0)).drop(f"{name}_block")

    docs = passed(docs, _RANGE, lambda b: b > F.col(id_col))
    if len(set(bounds)) < len(bounds):
        docs = passed(docs, f"{_RANGE}_end", lambda b: b >= F.col(id_col))
        m = F.col(f"{_RANGE}_end") - F.col(_RANGE)
        share = F.shiftrightunsigned(F.col(_TIE).bitwiseXOR(F.lit(-(1 << 63))), 33) / F.lit(float(1 << 31))  # of the ties below
        docs = docs.withColumn(_RANGE, F.col(_RANGE) + F.floor(share * m).cast("int")).drop(f"{_RANGE}_end")
    return docs.withColumn(_RANGE, F.when(F.col(id_col).isNull(), len(bounds) + 1).otherwise(F.col(_RANGE)))


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> for the carried columns of the next row by descending id, cyclically."""
    spark = docs.sparkSession
    n = docs.select(id_col).count()
    placed = _ranged(docs.withColumn(_TIE, F.xxhash64(text_col)), id_col, n)
    key = F.struct(F.col(id_col).isNotNull().alias("there"), F.col(id_col).alias("id"), (-F.col(_TIE).cast("decimal(20,0)")).alias("tie"))
    firsts = placed.select(_RANGE, key.alias("key"), _TIE).groupBy(_RANGE).agg(F.max_by(_TIE, "key").alias("tie"), F.max("key.id").alias("id")).orderBy(_RANGE).collect()
    moved = [(r["id"], r["tie"], firsts[i - 1][_RANGE]) for i, r in enumerate(firsts)]
    borders = spark.createDataFrame(moved, f"_id {docs.schema[id_col].dataType.simpleString()}, _t long, _before int")
    copies = placed.join(F.broadcast(borders), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(_TIE) == F.col("_t")))
    copies = copies.withColumn(_RANGE, F.col("_before")).drop("_id", "_t", "_before").withColumn(_COPY, F.lit(True))
    both = placed.withColumn(_COPY, F.lit(False)).unionByName(copies)
    order = Window.partitionBy(_RANGE).orderBy(_COPY, F.col(id_col).desc_nulls_last(), _TIE)
    ahead = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return ahead.where(~F.col(_COPY)).drop(_COPY, _RANGE, _TIE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_chars, sketch, n, edited text and sketch, next sketch, fingerprint strings,
    near_edited and near_next (Jaccard), contain_edited and contain_next).  The edited text is the
    text with its last third replaced by the beginning of the next one."""
    base = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    linked = with_next(with_sketch(base, F.col("text")), id_col, "text", ["text", "sketch", "whole"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    both = with_sketch(linked.withColumn("edited", edited).drop("next_text"), F.col("edited"), "edited_")
    a, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.withColumns({
        "fingerprint": as_text(a, F.col("n"), F.col("whole")), "edited_fingerprint": as_text(e, F.col("edited_n"), F.col("edited_whole")),
        "near_edited": jaccard(a, e, F.col("whole"), F.col("edited_whole")), "near_next": jaccard(a, x, F.col("whole"), F.col("next_whole")),
        "contain_edited": containment(a, e), "contain_next": containment(a, x),
    })


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus fingerprint."""
    own = [f"_geoloom_{c}" for c in ("sketch", "n", "whole")]
    made = with_sketch(renewed(docs, "fingerprint"), F.col(text_col), "_geoloom_")
    return made.withColumn("fingerprint", as_text(*map(F.col, own))).drop(*own)
