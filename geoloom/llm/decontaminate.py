"""Operator 4: benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item is a pattern (an item of one to nine
words is one shorter pattern).  For each pattern length the scan keeps a table of block shifts:
a block is the hash of two adjacent words (one word for patterns of one word), its shift is the
distance from the block's rightmost place in any pattern to the pattern's end.  A cursor reads
the block that ends at it and skips by the shift; at shift zero the block's suffix bucket names
the patterns to compare, and only equality of the words themselves counts as an occurrence.
Cursors of many text segments advance together in numpy; segments overlap by nothing, since a
window is owned by the segment in which it ends.

Scale: the documents are read once and never shuffled.  The benchmark is streamed into blocks of
at most ``block_words`` words, each compiled and broadcast; a task searches ``BLOCKS_AT_ONCE`` blocks,
which bounds what it holds, in one pass over its rows.  Only a benchmark beyond that (four million words)
takes another pass, over rows written to the shared folder in between.

Defined results: null or wordless text has no words and no hits; an empty benchmark hits
nothing; repeated items count once by item_id; a null item_id is the item "null"; repeated
documents are judged alike.  Input columns that clash with an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.textkernel import _STEP, ALNUM, LOWER, U64, Words, cut, pieces, text_buffer
from geoloom.llm.workspace import renewed, stored

WINDOW = 10
SEGMENT = 256
BLOCK_WORDS = 500_000
BLOCKS_AT_ONCE = 8
OUT = "n_words long, n_hit long, n_items long, items array<string>, hits array<struct<start:int,end:int>>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = cut(LOWER[raw], np.array([0, len(raw)]), ALNUM, hashed=False)
    data = w.data.tobytes()
    return [data[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    return cut(raw, np.array([0, len(raw)]), ALNUM).hashes


class Patterns:
    """Shift table, suffix buckets and words of all patterns of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.words = list(windows)
        self.items = [sorted(windows[w]) for w in self.words]
        self.m = len(self.words[0])
        self.b = min(2, self.m)
        distinct = sorted({x for w in self.words for x in w})
        number = {x: i for i, x in enumerate(distinct)}
        hashes = _word_hashes(distinct)[np.array([[number[x] for x in w] for w in self.words])]
        bits = max(12, min(22, int(np.ceil(np.log2(64 * len(self.words) + 1)))))
        self.drop = U64(64 - bits)
        self.shift = np.full(1 << bits, self.m - self.b + 1, np.uint8)
        for end in range(self.b - 1, self.m):
            before = hashes[:, end - 1] if self.b == 2 else None
            np.minimum.at(self.shift, self._block(before, hashes[:, end]), np.uint8(self.m - 1 - end))
        suffix = self._block(hashes[:, -2] if self.b == 2 else None, hashes[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes = suffix[self.order], hashes

    def _block(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        joined = last * _STEP if before is None else (before * _STEP + last) * _STEP
        return (joined >> self.drop).astype(np.int64)

    def ends(self, w: Words) -> np.ndarray:
        """Word positions at which the shift is zero."""
        low, high = w.first[:-1] + self.m - 1, w.first[1:]
        n_seg = np.maximum(0, -(-(high - low) // SEGMENT))
        text = np.repeat(np.arange(len(low)), n_seg)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        at = low[text] + rank * SEGMENT
        stop = np.minimum(at + SEGMENT, high[text])
        found = []
        while len(at):
            step = self.shift[self._block(w.hashes[at - 1] if self.b == 2 else None, w.hashes[at])]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, w: Words, raw: bytes) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each confirmed occurrence."""
        at = self.ends(w)
        if not len(at):
            return
        block = self._block(w.hashes[at - 1] if self.b == 2 else None, w.hashes[at])
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        n = hi - lo
        pick = np.repeat(np.arange(len(at)), n)
        pattern = self.order[np.repeat(lo, n) + np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)]
        begin = at[pick] - self.m + 1
        for j in range(self.m):  # by hash first, so that few pairs are compared word by word
            same = w.hashes[begin + j] == self.hashes[pattern, j]
            begin, pattern = begin[same], pattern[same]
        for a, p in zip(begin.tolist(), pattern.tolist(), strict=True):
            if all(raw[w.starts[a + j] : w.ends[a + j]] == word for j, word in enumerate(self.words[p])):
                yield a, p


def compile_patterns(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = _item_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])].add(item)
    return [Patterns(x) for _, x in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"] or "") // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, n_items, items (sorted ids), hits (word
    ranges, end exclusive), items_sha256 and contaminated."""
    added = [x.split(" ", 1)[0] for x in OUT.split(", ")[:4]] + ["hits"]
    docs = renewed(docs, *added, "items_sha256", "contaminated")
    kept = docs.columns
    out = docs
    for column in OUT.split(", "):
        name, kind = column.split(" ", 1)
        out = out.withColumn(name, F.lit(None).cast(kind))
    context, held, first = docs.sparkSession.sparkContext, [], True
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        if len(held) == BLOCKS_AT_ONCE:
            out, held, first = stored(_pass(out, text_col, held), "decontaminated"), [], False
        held.append(context.broadcast(compile_patterns(block, window)))
    if held or first:
        out = _pass(out, text_col, held)
    return out.select(
        *[F.col(f"`{c}`") for c in kept], *added,
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _pass(docs: DataFrame, text_col: str, blocks: list) -> DataFrame:
    names = [x.split(" ", 1)[0] for x in OUT.split(", ")]

    def scan(batches):
        patterns = [p for block in blocks for p in block.value]
        for whole in batches:
            for batch in pieces(whole, text_col):
                yield _scan(batch, text_col, patterns, names)

    return docs.mapInArrow(scan, docs.schema)


def _scan(batch: pa.RecordBatch, text_col: str, patterns: list[Patterns], names: list[str]) -> pa.RecordBatch:
    data, offsets = text_buffer(batch.column(text_col))
    w = cut(LOWER[data], offsets, ALNUM)
    raw = w.data.tobytes()
    delta = np.zeros(len(w.hashes) + 1, np.int32)
    found: dict[int, set[str]] = defaultdict(set)
    for p in patterns:
        hits = list(p.occurrences(w, raw))
        if hits:
            begin = np.array([a for a, _ in hits])
            np.add.at(delta, begin, 1)
            np.add.at(delta, begin + p.m, -1)
            for t, (_, k) in zip((np.searchsorted(w.first, begin, "right") - 1).tolist(), hits, strict=True):
                found[t].update(p.items[k])
    covered = np.cumsum(delta[:-1]) > 0
    old_items, old_hits = batch.column("items").to_pylist(), batch.column("hits").to_pylist()
    items, spans, n_hit = [], [], []
    for t in range(batch.num_rows):
        own = found.get(t)
        ranges = _ranges(covered[w.first[t] : w.first[t + 1]]) if own else []
        if old_hits[t]:
            ranges = _union(ranges + [(x["start"], x["end"]) for x in old_hits[t]])
        items.append(sorted((own or set()) | set(old_items[t] or ())))
        spans.append([{"start": a, "end": b} for a, b in ranges])
        n_hit.append(sum(b - a for a, b in ranges))
    new = {
        "n_words": pa.array(w.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items": pa.array(items, pa.list_(pa.string())), "hits": pa.array(spans, _HITS),
    }
    return pa.RecordBatch.from_arrays([new.get(n, batch.column(k)) for k, n in enumerate(batch.schema.names)], batch.schema.names)


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
