"""Vectorised word segmentation and hashing over Arrow string buffers.

Words are byte runs of one class, so a whole batch of texts is cut and hashed with a
handful of numpy passes and no per-word Python.  Every delimiter of the classes used here is
ASCII, hence working on UTF-8 bytes equals working on code points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

if "pyspark.worker" in sys.modules:  # a worker lives long: give freed batches back to the system
    pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
CHUNK_BYTES = 1 << 19

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: Per seed of word hashes.
_BYTE_VALUES = [np.random.default_rng(20240229 + seed).integers(1, 1 << 64, 256, dtype=U64) for seed in range(2)]
_STEP = U64(0xD6E8FEB86659FD93)

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def byte_class(delimiters: bytes) -> np.ndarray:
    """Boolean table over bytes: True where the byte belongs to a word."""
    table = np.ones(256, bool)
    table[list(delimiters)] = False
    return table


#: Words of the class [^\x20\x09-\x0D].
NON_SPACE = byte_class(SPACE_BYTES)
#: Words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], taken after A-Z became a-z.
ALNUM = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of several texts: byte ranges in ``data``, hashes, and per text the first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_texts + 1 word offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text stays near ``limit`` bytes (one longer text goes alone)."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte range of data; those of seeds 0 and 1 are independent."""
    n = len(data)
    if not n:
        return np.zeros(len(starts), U64)
    up, down = _grown(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[seed][data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge) & inside[1:])
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    first = np.searchsorted(starts, offsets)
    hashes = segment_hashes(data, starts, ends) if hashed else np.zeros(len(starts), U64)
    return Words(data, starts, ends, hashes, first)


def words_of(column: pa.Array, table: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    data, offsets = text_buffer(column)
    return cut(LOWER[data] if lower else data, offsets, table, hashed)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive words, ignoring text borders; len(hashes)-k+1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, U64((seed * 0x632BE59BD9B4E019 + k) & (2**64 - 1)))
    for j in range(k):
        total = total * _STEP + hashes[j : j + n]
    return mix(total)


def inner(words: Words, k: int) -> np.ndarray:
    """Positions at which k consecutive words of one text start."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    text = words.text_of
    return np.flatnonzero(text[:n] == text[k - 1 :])


def shingles(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every k-word shingle; a text of fewer words is one shingle."""
    at = inner(words, k)
    text, value = words.text_of[at], windows(words.hashes, k, seed)[at]
    counts = words.counts
    extra_text, extra_value = [text], [value]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            total = np.full(len(short), U64((seed * 0x632BE59BD9B4E019 + m) & (2**64 - 1)))
            for j in range(m):
                total = total * _STEP + words.hashes[words.first[short] + j]
            extra_text.append(short)
            extra_value.append(mix(total))
    return np.concatenate(extra_text), np.concatenate(extra_value)


def distinct_per_text(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs sorted by text, then value, each once."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[keep], value[keep]
