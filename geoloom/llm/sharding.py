"""Operator 6: sharding by extendible hashing.  Built-in functions only.

A row's address is the bits of a hash of its id, from the top.  The directory starts with one
bucket; only a bucket whose rows exceed the byte limit splits, on the next bit, until each
bucket fits.  A bucket is known by its prefix of bits, and its leaf is the shallowest prefix of an
address whose rows fit the limit.

Scale: byte sums are taken once for cells of ``start_bits`` bits (map-side combined) and added up
per depth from the cells, not from rows; only cells still too large are opened ``more_bits``
further, from their rows alone.  The directory has about as many rows as there are shards times
16 and is joined by cell; it is broadcast only while it has at most ``broadcast_cells`` cells.

Defined results: sizes are UTF-8 bytes, null text has none; a null id hashes as "null".  Rows that no
bit of the address tells apart (repeated ids) and still exceed the limit go to numbered pages of
their bucket, dealt by a hash of the text; a row larger than the limit has a page for itself.
An empty table gives an empty result.  Input columns of the names of output columns are replaced, all
others stay; names that begin with ``_geoloom`` are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.workspace import renewed, stored

LIMIT_BYTES = 32 << 20
START_SLACK = 4
MORE_BITS = 8
MOST_BITS = 56
BROADCAST_CELLS = 100_000
_ADDRESS, _BITS, _CELL, _KEY, _END, _PAGE = (f"_geoloom_{c}" for c in ("address", "bits", "cell", "key", "end", "page"))
_SUM, _DEPTH, _PART, _SUM_PARTS = (f"_geoloom_{c}" for c in ("sum", "depth", "part", "parts"))


def address(id_col: str) -> Column:
    """56 uniform bits of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(11)), 64 - MOST_BITS)


def _cell(bits: int) -> Column:
    return F.shiftright(_ADDRESS, MOST_BITS - bits)


def _leaves(cells: DataFrame, above: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, n_bytes): for each cell of ``bits`` bits the shallowest depth over ``above`` whose
    prefix fits; depth is null where even the cell does not."""
    per_depth = cells.withColumn("depth", F.explode(F.sequence(F.lit(above), F.lit(bits))))
    per_depth = per_depth.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = per_depth.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum"))
    own = per_depth.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"]).where(F.col("sum") <= limit)
    best = own.groupBy("cell").agg(F.min(F.struct("depth", "sum")).alias("b"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.col("b.depth").alias("depth"), F.col("b.sum").alias("n_bytes"))


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES, more_bits: int = MORE_BITS,
    most_bits: int = MOST_BITS, broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """All columns of ``docs`` plus bytes, shard (prefix bits, "-page" where a bucket has pages),
    depth and shard_bytes."""
    docs = renewed(docs, "bytes", "shard", "depth", "shard_bytes")
    sized = docs.withColumns({"bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), _ADDRESS: address(id_col)})
    rows = stored(sized.select(_ADDRESS, "bytes"), "shard-rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(most_bits, max(1, math.ceil(math.log2(max(1, total / limit_bytes)))) + START_SLACK)
    above, left, directory = 0, rows, None
    while True:
        cells = stored(left.groupBy(_cell(bits).alias("cell")).agg(F.sum("bytes").alias("bytes")), "shard-cells")
        leaves = stored(_leaves(cells, above, bits, limit_bytes), "shard-leaves")
        level = leaves.where("depth IS NOT NULL OR " + ("true" if bits == most_bits else "false")).withColumn("bits", F.lit(bits))
        directory = level if directory is None else directory.unionByName(level)
        large = leaves.where("depth IS NULL").select("cell")
        if bits == most_bits or large.isEmpty():
            break
        left = left.join(large, _cell(bits) == F.col("cell"), "left_semi")
        above, bits = bits + 1, min(most_bits, bits + more_bits)
    directory = stored(directory, "shard-directory")
    few = directory.count() <= broadcast_cells
    used = [r["bits"] for r in directory.select("bits").distinct().collect()]  # one per opening
    paged = not directory.where("depth IS NULL").isEmpty()
    directory = directory.withColumnsRenamed({"bits": _BITS, "cell": _CELL, "depth": _DEPTH, "n_bytes": _SUM})
    keys = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), _cell(b).alias("cell")) for b in sorted(used)]))
    if len(used) == 1:
        keyed = sized.withColumns({_BITS: F.lit(used[0]), _CELL: _cell(used[0])})
    elif used:
        keyed = sized.withColumn(_KEY, keys).withColumns({_BITS: F.col(f"{_KEY}.bits"), _CELL: F.col(f"{_KEY}.cell")}).drop(_KEY)
    else:
        keyed = sized.withColumns({_BITS: F.lit(0), _CELL: F.lit(0).cast("long")})
    placed = keyed.join(F.broadcast(directory) if few else directory, [_BITS, _CELL])
    prefix = F.when(F.col(_DEPTH) == 0, "").otherwise(F.expr(f"substring(lpad(bin({_ADDRESS}), {MOST_BITS}, '0'), 1, {_DEPTH})"))
    out = placed.where(F.col(_DEPTH).isNotNull()).withColumns({"shard": prefix, "depth": F.col(_DEPTH), "shard_bytes": F.col(_SUM)})
    if paged:
        out = out.unionByName(_paged(placed.where(F.col(_DEPTH).isNull()), text_col, limit_bytes, most_bits))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "bytes", "shard", "depth", "shard_bytes")


def _paged(rows: DataFrame, text_col: str, limit: int, bits: int) -> DataFrame:
    """Pages of rows that share all address bits.  They are dealt to parts by a hash of the text, so
    many that a part holds half a page on average.  In a part a row goes to the page in which it starts,
    and rows that would cross its end go to the odd page after it, so no page exceeds the limit."""
    own = F.least("bytes", F.lit(limit))
    parts = stored(rows.groupBy(_CELL).agg(F.greatest(F.lit(1), F.ceil(F.sum(own) * 2 / limit)).cast("int").alias(_SUM_PARTS)), "shard-parts")
    dealt = rows.join(parts, _CELL).withColumn(_PART, F.pmod(F.xxhash64(text_col, F.lit(29)), F.col(_SUM_PARTS)).cast("int"))
    within = Window.partitionBy(_CELL, _PART).orderBy(F.xxhash64(text_col))
    end = F.sum(own).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first, last = F.floor((F.col(_END) - own) / limit), F.floor((F.col(_END) - F.lit(1)) / limit)
    page = F.when(F.col("bytes") >= limit, F.concat(F.lit("r"), F.row_number().over(within).cast("string")))
    page = page.when(first == last, F.concat(F.lit("p"), first.cast("string"))).otherwise(F.concat(F.lit("c"), last.cast("string")))
    paged = dealt.withColumn(_END, end).withColumn(_PAGE, F.concat(F.col(_PART).cast("string"), page))
    shard = F.concat(F.expr(f"substring(lpad(bin({_ADDRESS}), {MOST_BITS}, '0'), 1, {bits})"), F.lit("-"), F.col(_PAGE))
    shard_bytes = F.sum("bytes").over(Window.partitionBy(_CELL, _PAGE))
    return paged.withColumns({"depth": F.lit(bits), "shard": shard, "shard_bytes": shard_bytes}).drop(_END, _PAGE, _PART, _SUM_PARTS)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard."""
    assigned.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
