"""Operator 7: token ids in training order, as fixed-stride records.

Texts are tokenised (byte-level BPE of a public vocabulary; its path is a parameter), ended by the
separator and cut into records of ``length`` ids, the last one of a text padded with the
separator.  Records are numbered 0..n-1; a keyed Feistel network over the smallest even number of
bits that holds n, applied again while its value is n or more (cycle-walking), is a bijection
of these numbers and gives each record its global slot.  Slots are dealt by range: shard s holds
slots [s * shard_records, (s + 1) * shard_records) in order, so a reader resumes at any slot
by seeking to a multiple of the stride.

The number of a record comes from its data alone: documents are dealt to buckets by a hash of id and
text, a bucket is ordered by id, that hash and the place in the text, and buckets follow one another.
So any rerun, on any partitioning, gives the same records the same slots.

Scale: records go to their bucket (``BUCKET_ROWS`` documents on average) in one shuffle and are written
to the shared folder with their number in it; first numbers of buckets are sums over one row per
bucket.  A lost executor then costs re-reads only.  The second shuffle deals records straight to
the partition of their shard, without sampling.  A text is cut before each space that follows a
non-space, which is always a border of the vocabulary's own pre-tokenisation; each distinct piece of
a chunk is encoded once.

Defined results: null or empty text makes no record; identical rows make records of their own, which
may stand for each other; an empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.llm.textkernel import U64, mix, pieces, segment_hashes, text_buffer
from geoloom.llm.workspace import stored

SEPARATOR = 50256
#: Fixed value: the pre-tokenisation that the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 512
SHARD_RECORDS = 16_384
KEY = 0x5DEECE66D
ROUNDS = 6
CHUNK_BYTES = 1 << 20
BUCKET_ROWS = 2_000
BROADCAST_BUCKETS = 500_000

_encodings: dict[int, tuple] = {}


def _encoding(raw: bytes):
    """(encoding, bytes of each token) of a vocabulary, made once per worker."""
    import tiktoken

    if (mark := hash(raw)) not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        _encodings.clear()
        _encodings[mark] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size)
    return _encodings[mark]


def feistel(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``number``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & (2**64 - 1)))
    out = number.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of pieces, per text its first piece, and where the byte before ends a non-space."""
    n = len(data)
    p1, p2, p3 = (np.concatenate((np.zeros(min(k, n + 1), np.uint8), data[: max(0, n + 1 - k)])) for k in (1, 2, 3))
    plain = ((p1 > 0x20) & (p1 < 0x7F)) | ((p1 >= 0x80) & (p2 != 0xC2) & ((p3 < 0xE1) | (p3 > 0xE3)))
    edge = (data == 0x20) & plain[:n]
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(edge)
    return starts, np.searchsorted(starts, offsets), plain


def _flat(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges source[start:start + length], one after another."""
    stop = np.cumsum(length)
    return source[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length, length) + np.repeat(start, length)]


def encode_texts(column: pa.Array, raw_vocabulary: bytes, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and the end of each text among them.

    Distinct pieces are encoded in one call: those that begin with a space and end with a non-space
    stay apart when joined, and the bytes of the tokens tell where each ends; the few others go
    alone."""
    encoding, token_bytes = _encoding(raw_vocabulary)
    data, offsets = text_buffer(column)
    starts, first, plain = _cuts(data, offsets)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    _, index, inverse = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
    begin, size = starts[index], ends[index] - starts[index]
    regular = (data[begin] == 0x20) & plain[begin + size]
    joined = _flat(data, begin[regular], size[regular]).tobytes().decode()
    ids = np.array(encoding.encode_ordinary(joined), np.int64)
    at = np.searchsorted(np.cumsum(token_bytes[ids]), np.cumsum(size[regular])) + 1
    own = np.zeros(len(index), np.int64)
    own[regular] = np.diff(at, prepend=0)
    base = np.zeros(len(index), np.int64)
    base[regular] = at - own[regular]
    parts, total = [ids], len(ids)
    raw = data.tobytes()
    for i in np.flatnonzero(~regular).tolist():
        alone = encoding.encode_ordinary(raw[begin[i] : begin[i] + size[i]].decode())
        base[i], own[i] = total, len(alone)
        total += len(alone)
        parts.append(np.array(alone, np.int64))
    length = own[inverse]
    return _flat(np.concatenate(parts).astype(dtype), base[inverse], length), np.concatenate(([0], np.cumsum(length)))[first[1:]]


_RECORD = "row long, chunk int, n_tokens int, tokens binary"


def records(docs: DataFrame, id_col: str, text_col: str, vocabulary: bytes, length: int, separator: int) -> DataFrame:
    """(id, row, chunk, n_tokens, tokens): the records of each text; row is a hash of id and text."""
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = np.dtype("<u2") if separator < 1 << 16 else np.dtype("<u4")
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK_BYTES):
                ids, ends = encode_texts(batch.column("text"), raw.value, dtype)
                size = np.diff(ends, prepend=0)
                size_all = np.where(size > 0, size + 1, 0)  # with the separator
                n = -(-size_all // length)
                text = np.repeat(np.arange(batch.num_rows), n)
                first = np.cumsum(n) - n
                flat = np.full(len(text) * length, separator, dtype)
                flat[np.arange(len(ids)) + np.repeat(first * length - (ends - size), size)] = ids
                chunk = np.arange(len(text)) - np.repeat(first, n)
                stride = length * dtype.itemsize
                blob = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((np.arange(len(text) + 1) * stride).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(own), batch.column("row").take(own), pa.array(chunk, pa.int32()), pa.array(np.minimum(length, size_all[text] - chunk * length), pa.int32()), blob],
                    ["id", "row", "chunk", "n_tokens", "tokens"],
                )

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    return named.mapInArrow(run, f"id {kind}, {_RECORD}")


def training_order(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, length: int = LENGTH,
    shard_records: int = SHARD_RECORDS, key: int = KEY,
) -> DataFrame:
    """(shard, slot, id, chunk, n_tokens, tokens), a partition per shard and sorted by slot;
    tokens are ``length`` little-endian ids of 16 bits (32 if the vocabulary needs them).  ``vocabulary``
    is the path of the ranks on the driver, which broadcasts them."""
    with open(vocabulary, "rb") as file:
        raw = file.read()
    buckets = docs.count() // BUCKET_ROWS + 1
    made = records(docs, id_col, text_col, raw, length, separator).withColumn("bucket", F.pmod("row", F.lit(buckets)))
    place = Window.partitionBy("bucket").orderBy("id", "row", "chunk")
    made = stored(made.withColumn("number", F.row_number().over(place) - 1).drop("row"), "token-records")
    per_bucket = made.groupBy("bucket").agg(F.max("number").alias("last"))
    base = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stored(per_bucket.withColumn("base", base).drop("last"), "token-buckets")
    n = made.count()

    @F.pandas_udf("long")
    def slot(number):
        import pandas as pd

        return pd.Series(feistel(number.to_numpy(), n, key))

    placed = made.join(F.broadcast(bases) if buckets <= BROADCAST_BUCKETS else bases, "bucket").withColumn("slot", slot(F.col("base") + F.col("number")))
    placed = placed.select(F.floor(F.col("slot") / shard_records).cast("long").alias("shard"), "slot", "id", "chunk", "n_tokens", "tokens")
    return placed.repartitionById(max(1, -(-n // shard_records)), F.col("shard").cast("int")).sortWithinPartitions("slot")


def write_shards(ordered: DataFrame, path: str) -> None:
    """One file per shard, in a folder shard=<s>: records in slot order, each followed by one 0x0A,
    so record i begins at byte i * (stride + 1).  Spark's commit makes each file whole or absent."""
    ordered.select("shard", F.col("tokens").cast("string").alias("value")).write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").text(path)


def read_from(ordered: DataFrame, slot: int) -> DataFrame:
    """The records of a materialised order from a slot on, in order."""
    return ordered.where(F.col("slot") >= slot).orderBy("slot")
