"""Operator 3: exact substring deduplication with a log-structured index of window hashes.

A window is 13 consecutive words of one document.  Documents arrive in batches of rising ids.
The index holds sorted immutable runs of the hashes of all windows seen before, cut into ranges of
the hash ("buckets").  A batch sends its windows to the buckets; there its sorted hashes are merged
with the sorted runs, one pass over both.  A window found in a run, or in the batch under a smaller
id, is a repeat; every word that a repeat covers is removed.  The batch's new hashes become a run
of their own, and ``FANOUT`` runs are compacted into one.  ``dedup_substrings`` cuts a corpus into
``BATCHES`` batches, keeps the run of each and saves the index, so that a later batch can be
held against it (``FingerprintIndex.open`` and ``add``).

Verification: a window has two 64-bit hashes, the second over word hashes of its own seed.  The first
picks the bucket; the first and the lower half of the second must both agree.  Two different windows
do so with probability 2**-96, so over n windows about n**2 / 2**97 are expected to be taken for
repeats: 2e-10 for the 5 * 10**9 windows of 30 GB, 2e-3 for the 1.6 * 10**13 of 100 TB.

Scale: runs lie as bucketed tables, so a batch is the only thing that moves: history is read by
the task of its bucket, and compaction shuffles nothing.  Window hashes travel as packed blobs
(about 14 bytes a window), never as rows.  Copies meet first within the task that reads them: there
only the smallest id of a hash is sent on and the others are settled at once, so a window that a
third of all documents share reaches its bucket once per task, not once per document.  Bucket count
follows the first corpus and doubles at compactions as history grows, so a bucket stays near
``BUCKET_WINDOWS`` windows.  Positions of repeats come back in blobs dealt by document, are
put together there and joined to the text by its id and a hash of (id, text).

Defined results: words are runs of characters other than space and U+0009-000D, unchanged; null or
wordless texts have n_words 0; a text of fewer than 13 words loses nothing; a window repeated
only within its document, or only in rows of the same id, stays; a null id counts as larger than
any other; identical rows get identical results; an empty table gives an empty result.  Input
columns of the names of output columns are replaced, all others stay; names that begin with
``_geoloom`` are reserved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom.llm.textkernel import NON_SPACE, U64, cut, inner, pieces, segment_hashes, text_buffer, windows, words_of
from geoloom.llm.workspace import discarded, lean, renewed, shared_folder

WINDOW = 13
BUCKET_WINDOWS = 1_000_000
FLUSH = 400_000
FANOUT = 4
BATCHES = 6
_LAST = np.iinfo(np.int64).max
_FIELDS = ("id", "row", "count", "hash", "check", "gap")
_SENT = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _FIELDS)
_POSTINGS, _RUN, _SETTLED = 0, 1, 2
_OWN, _ROW, _PLACES = "_geoloom_own", "_geoloom_row", "_geoloom_places"


def _planes(hashes: np.ndarray, checks: np.ndarray) -> bytes:
    """Sorted hashes as byte planes (generic compression then stores the high bytes in no space),
    then the checks in the same order."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() + checks.astype("<u4").tobytes()


def _from_planes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    hashes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view("<u8")
    return hashes, np.frombuffer(raw, "<u4", n, 8 * n)


def _ordered(value: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): places sorted by value, then check, and where a pair differs from the one before."""
    order = np.argsort(value)
    v, c = value[order], check[order]
    if ((v[1:] == v[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((check, value))
        v, c = value[order], check[order]
    head = np.ones(len(v), bool)
    head[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    return order, head


def _known(runs: list[tuple[np.ndarray, np.ndarray]], value: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which of the sorted, distinct pairs (value, check) stand in a sorted run.

    A merge join: the stable sort finds the sorted runs one after another and merges them in one
    pass; pairs that meet a hash of their own value there are then compared by both hashes."""
    values, checks = (np.concatenate(x) for x in zip(*runs, (value, check), strict=True))
    old = len(values) - len(value)
    order = np.argsort(values, kind="stable").astype(np.int32)
    merged = values[order]
    near = np.zeros(len(order) + 1, bool)
    near[1:-1] = merged[1:] == merged[:-1]
    met = order[near[1:] | near[:-1]]
    met = met[np.lexsort((met, checks[met], values[met]))]
    a, b = met[:-1], met[1:]
    same = (values[a] == values[b]) & (checks[a] == checks[b]) & (b >= old)
    found = np.zeros(len(value), bool)
    found[b[same] - old] = True
    return found


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the first hash; twice as many buckets cut each in two."""
    return ((value >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _grouped(bucket, kind: int, doc, place, hashes, checks, ids, rows) -> list[dict]:
    """Blobs per bucket of postings that are sorted by document and place."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, place = bucket[order], doc[order], place[order]
    if hashes is not None:
        hashes, checks = hashes[order], checks[order].astype("<u4")
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own, count = np.unique(doc[a:b], return_counts=True)
        out.append({
            "bucket": int(bucket[a]), "kind": kind, "id": ids[own].tobytes(), "row": rows[own].tobytes(), "count": count.astype("<i4").tobytes(),
            "hash": b"" if hashes is None else hashes[a:b].tobytes(), "check": b"" if hashes is None else checks[a:b].tobytes(), "gap": _gaps(place[a:b], count),
        })
    return out


def _gaps(place: np.ndarray, count: np.ndarray) -> bytes:
    """Places, rising within each document, as differences of 16 bits; 65535 stands for "and more"."""
    step = np.diff(place, prepend=0)
    first = np.cumsum(count) - count
    step[first] = place[first]
    over = step // 65535
    if not over.any():
        return step.astype("<u2").tobytes()
    out = np.full(len(step) + int(over.sum()), 65535, "<u2")
    out[np.arange(len(step)) + np.cumsum(over)] = step % 65535
    return out.tobytes()


def _places(raw: bytes, count: np.ndarray) -> np.ndarray:
    step = np.frombuffer(raw, "<u2").astype(np.int64)
    total = np.cumsum(step)[step != 65535]
    first = np.cumsum(count) - count
    before = total[first] - np.diff(total, prepend=0)[first]
    return total - np.repeat(before, count)


def _send(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Postings of (id, row, text), after what can be settled within the task."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in _FIELDS]])

    def flush(held) -> pa.RecordBatch:
        base, columns = 0, [[] for _ in range(6)]
        for ids, rows, doc, place, value, check in held:
            for c, x in zip(columns, (ids, rows, doc + base, place, value, check), strict=True):
                c.append(x)
            base += len(ids)
        ids, rows, doc, place, value, check = (np.concatenate(c) for c in columns)
        order, head = _ordered(value, check)
        group = np.empty(len(value), np.int64)
        group[order] = np.cumsum(head) - 1
        same = np.append(~head, False)
        shared = order[same[1:] | same[:-1]]
        shared = shared[np.lexsort((ids[doc[shared]], group[shared]))]
        settled = np.zeros(len(value), bool)
        if len(shared):
            v, i = group[shared], ids[doc[shared]]
            start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            least = np.repeat(i[start], np.diff(np.append(start, len(v))))
            settled[shared] = i > least
        out = []
        if settled.any():
            out += _grouped(-1 - (rows[doc[settled]].view(U64) % U64(buckets)).astype(np.int64), _SETTLED, doc[settled], place[settled], None, None, ids, rows)
        on = ~settled
        if on.any():
            bucket = _bucket(value[on], buckets)
            out += _grouped(bucket, _POSTINGS, doc[on], place[on], value[on], check[on] & U64(0xFFFFFFFF), ids, rows)
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                w = words_of(batch.column("text"), NON_SPACE, lower=False)
                at = inner(w, window)
                if len(at):
                    doc = w.text_of[at]
                    ids = batch.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False)
                    second = segment_hashes(w.data, w.starts, w.ends, seed=1)
                    held.append((ids, batch.column("row").to_numpy(), doc, at - w.first[doc], windows(w.hashes, window)[at], windows(second, window, seed=1)[at]))
                    size += len(at)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.select("id", "row", "text").mapInArrow(run, _SENT)


_MERGED = "kind int, bucket int, part int, own binary, row binary, count binary, blob binary"
_COLUMNS = [("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("own", "row", "count", "blob")]]


def _packed(ids: np.ndarray, rows: np.ndarray, owner: np.ndarray, place: np.ndarray, parts: int, bucket: int) -> list[dict]:
    """Repeats dealt by a hash of their document: a blob per part, not a row per document."""
    part = (rows[owner].view(U64) % U64(parts)).astype(np.int64)
    order = np.lexsort((place, owner, part))
    part, owner, place = part[order], owner[order], place[order]
    edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own, count = np.unique(owner[a:b], return_counts=True)
        out.append({"kind": _SETTLED, "bucket": bucket, "part": int(part[a]), "own": ids[own].tobytes(), "row": rows[own].tobytes(), "count": count.astype("<i4").tobytes(), "blob": place[a:b].astype("<u4").tobytes()})
    return out


def _per_document(table: pa.Table) -> pa.Table:
    """(own, row, places) once for each document of a part."""
    col = {c: b"".join(table.column(c).to_pylist()) for c in ("own", "row", "count", "blob")}
    count = np.frombuffer(col["count"], "<i4")
    ids, rows = (np.repeat(np.frombuffer(col[c], "<i8"), count) for c in ("own", "row"))
    place = np.frombuffer(col["blob"], "<u4")
    order = np.lexsort((place, ids, rows))
    ids, rows, place = ids[order], rows[order], place[order]
    start = np.ones(len(rows), bool)
    start[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    fresh = start.copy()
    fresh[1:] |= place[1:] != place[:-1]
    ids, rows, place, start = ids[fresh], rows[fresh], np.ascontiguousarray(place[fresh]), start[fresh]
    first = np.flatnonzero(start)
    offsets = np.append(first, len(rows)).astype(np.int32)
    return pa.table({_OWN: pa.array(ids[first]), _ROW: pa.array(rows[first]), _PLACES: pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))})


def _merger(parts: int):
    def merge(sent: pa.Table, history: pa.Table | None = None) -> pa.Table:
        """Of one bucket: the batch's repeats, and its new hashes as a sorted run."""
        blobs = {c: sent.column(c).to_pylist() for c in _FIELDS}
        out = []
        if len(sent):
            bucket = sent.column("bucket")[0].as_py()
            count = [np.frombuffer(x, "<i4") for x in blobs["count"]]
            place = np.concatenate([_places(x, c) for x, c in zip(blobs["gap"], count, strict=True)])
            ids, rows, value, check = (np.frombuffer(b"".join(blobs[c]), kind) for c, kind in (("id", "<i8"), ("row", "<i8"), ("hash", "<u8"), ("check", "<u4")))
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate(count))
            blobs.clear()
            if bucket >= 0:
                order, head = _ordered(value, check)
                fresh, fresh_check = value[order[head]], check[order[head]]
                runs = [_from_planes(x) for x in history.column("blob").to_pylist()] if history is not None else []
                known = _known(runs, fresh, fresh_check)
                runs.clear()
                group = np.cumsum(head) - 1
                i = ids[owner[order]]
                least = np.minimum.reduceat(i, np.flatnonzero(head))
                repeat = np.zeros(len(value), bool)
                repeat[order] = known[group] | (i > least[group])
                owner, place = owner[repeat], place[repeat]
                if not known.all():
                    out.append({"kind": _RUN, "bucket": bucket, "blob": _planes(fresh[~known], fresh_check[~known])})
            if len(owner):
                out += _packed(ids, rows, owner, place, parts, bucket)
        return pa.Table.from_pylist(out, pa.schema(_COLUMNS))

    return merge


def _compactor(buckets: int):
    def compacted(table: pa.Table) -> pa.Table:
        """One sorted run of a bucket's runs, cut at the borders of as many buckets."""
        value, check = (np.concatenate(x) for x in zip(*[_from_planes(x) for x in table.column("blob").to_pylist()], strict=True))
        order, head = _ordered(value, check)
        value, check = value[order[head]], check[order[head]]
        bucket = _bucket(value, buckets)
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        rows = [{"bucket": int(bucket[a]), "blob": _planes(value[a:b], check[a:b])} for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    return compacted


class FingerprintIndex:
    """Sorted runs of window hashes under one folder; ``runs`` are the folders of bucketed files,
    oldest first."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, window: int = WINDOW, runs: list[str] | None = None):
        self.spark, self.path, self.buckets, self.window, self.runs = spark, path.rstrip("/"), buckets, window, runs or []
        self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        state = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest").first()[0])
        return cls(spark, path, state["buckets"], state["window"], state["runs"])

    def save(self) -> None:
        state = json.dumps({"buckets": self.buckets, "window": self.window, "runs": self.runs})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    def _write(self, df: DataFrame, path: str, buckets: int, *partition: str) -> None:
        """Files of a bucketed table; the catalogue forgets it, the files stay."""
        name = f"geoloom_{uuid.uuid4().hex}"
        with lean(self.spark):
            df.write.partitionBy(*partition).bucketBy(buckets, "bucket").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    @contextmanager
    def _history(self) -> Iterator[DataFrame | None]:
        """(bucket, blob) of all runs as one bucketed table, which exists while it is used."""
        if not self.runs:
            yield None
            return
        name = f"geoloom_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (bucket INT, blob BINARY, run INT) USING parquet PARTITIONED BY (run) CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'")
        try:
            for i, run in enumerate(self.runs):
                self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (run={i}) LOCATION '{run}'")
            yield self.spark.table(name).select("bucket", "blob")
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Repeats of a batch (id, row, text) as packed window places, dealt by document; its new
        hashes become a run.  Ids must not lie below those added before."""
        sent = _send(docs, self.buckets, self.window).repartition(self.buckets, "bucket").groupBy("bucket")
        path, merge = f"{self.path}/batch-{uuid.uuid4().hex}", _merger(self.buckets)
        with self._history() as history:
            merged = sent.applyInArrow(lambda t: merge(t), _MERGED) if history is None else sent.cogroup(history.groupBy("bucket")).applyInArrow(lambda t, h: merge(t, h), _MERGED)
            self._write(merged, path, self.buckets, "kind")
        out = self.spark.read.schema(_MERGED).parquet(path)
        if not out.where(F.col("kind") == _RUN).isEmpty():
            self.runs.append(f"{path}/kind={_RUN}")
            if len(self.runs) >= FANOUT:
                self.compact()
        return out.where(F.col("kind") == _SETTLED).select("part", "own", "row", "count", "blob")

    def compact(self) -> None:
        """All runs into one.  Where history has outgrown its buckets they are cut in two, as often as
        it takes, and only then is the new run shuffled."""
        path, buckets = f"{self.path}/run-{uuid.uuid4().hex}", self.buckets
        with self._history() as history:
            entries = (history.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // 12
            while entries > 2 * BUCKET_WINDOWS * buckets:
                buckets *= 2
            made = history.groupBy("bucket").applyInArrow(_compactor(buckets), "bucket int, blob binary")
            self._write(made if buckets == self.buckets else made.repartition(buckets, "bucket"), path, buckets)
        for run in self.runs:
            discarded(self.spark, run)
        self.runs, self.buckets = [path], buckets
        self.compactions += 1


def _removed(docs: DataFrame, repeats: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept_text."""
    per_doc = repeats.groupBy("part").applyInArrow(_per_document, f"{_OWN} long, {_ROW} long, {_PLACES} array<int>")
    joined = docs.withColumns({_OWN: _own(id_col), _ROW: _row(id_col, text_col)}).join(per_doc, [_OWN, _ROW], "left").drop(_OWN, _ROW)
    shaped = joined.drop(_PLACES).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")})
    names = shaped.columns

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                data, offsets = text_buffer(batch.column(text_col))
                w = cut(data, offsets, NON_SPACE, hashed=False)
                delta = np.zeros(len(w.starts) + 1, np.int32)
                places = batch.column(_PLACES)
                text, flat = places.value_parent_indices().to_numpy(), places.flatten().to_numpy()
                at = flat + w.first[text]
                delta[at] += 1
                np.subtract.at(delta, at + window, 1)
                keep = np.cumsum(delta[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(keep)))[w.first]
                length = (w.ends - w.starts + 1)[keep]
                stop = np.cumsum(length)
                source = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - length, length) + np.repeat(w.starts[keep], length)
                flat = np.append(data, np.uint8(0))[source]
                flat[stop - 1] = 0x20
                raw = flat.tobytes()
                bound = np.concatenate(([0], stop))[left].tolist()
                kept = [raw[a : max(a, b - 1)].decode() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                n = w.counts
                own = [batch.column(c) for c in names[:-3]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), pa.array(kept, pa.string())], names)

    return joined.mapInArrow(run, shaped.schema)


def _own(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, index_path: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_removed and kept_text (kept words, one space apart).
    The index of all windows is left under ``index_path``, by default in the shared folder."""
    spark = docs.sparkSession
    docs = renewed(docs, "n_words", "n_removed", "kept_text")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _row(id_col, text_col).alias("row"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = FingerprintIndex(spark, index_path or f"{shared_folder(spark)}/geoloom/windows-{uuid.uuid4().hex}", max(8, int(size / 6 / BUCKET_WINDOWS) + 1), window)
    cuts = keyed.approxQuantile("id", [(i + 1) / batches for i in range(batches - 1)], 0.01) if batches > 1 else []
    repeats, low = None, None
    for i in range(len(cuts) + 1):
        part = keyed
        if low is not None:
            part = part.where((F.col("id") > low) | F.col("id").isNull())
        if i < len(cuts):
            low = int(cuts[i])
            part = part.where(F.col("id") <= low)
        found = index.add(part)
        repeats = found if repeats is None else repeats.unionByName(found)
    index.save()
    return _removed(docs, repeats, id_col, text_col, window)
