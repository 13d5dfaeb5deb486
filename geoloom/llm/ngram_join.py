"""Operator 1: n-gram Jaccard self-join by T-occurrence search in the manner of DivideSkip.

A text's set is its distinct five-word shingles.  Jaccard >= t means an overlap of at least
T = ceil(t * n) for a set of n shingles, so a partner must occur on T of the n inverted lists.
Lists are divided by length: the L longest are set aside, the others are merged, and a set that the
merge meets T - L times is a candidate, whose missing occurrences are looked up in the long lists by
binary search, dropped as soon as T is out of reach.

How it is laid out on a cluster
  * Sets are keyed by a fingerprint of the whole set, so exact copies are one class from the first
    shuffle on and are never expanded into pairs.  It has 64 bits; where different sets have the same
    one, told by 64 further bits, each of them goes by its further bits instead.
  * List lengths: every class sends its shingles, packed in blobs, to hash ranges ("buckets");
    a bucket sorts them and returns to each class only those shingles that another class has.
    A class with fewer than T of these has no partner and is gone: this removes almost
    all of an ordinary corpus before any candidate exists.  Shingles that are very frequent in
    a bounded sample of texts skip the bucket; the sample steers only the order of lists (any one
    order gives the same links), never a result.
  * Across the cluster the division has L = T - 1: the shortest lists of a class (its "prefix") are
    joined, where one occurrence makes a candidate, and the other T - 1 are never moved; the pair's
    sets are probed by binary search.  In a hub round each short list proposes pairs with one of
    its classes only (the smallest at first, then one by a hash of list and round), which is linear
    in the list; links found are contracted to components, and lists within one component close.
    A list is dealt in pieces of at most about ``SPREAD`` postings, so no task gets a hot one.
  * When such a round finds few links, the lists still open try every pair of classes in different
    components: short lists propose pairs, cut by the size and position bounds; long ones are
    cut into blocks, and a task searches the inverted lists of one block with the sets of another,
    L chosen for each search by its cost.  A pair inside a component cannot change the components,
    so they are exact, and a group of near copies makes no rows for its pairs.
  * Links of a document, when asked for, are counted by the same search within each component.

Shingles are compared by 48 bits of a hash within a bucket of at least 3 bits: two different
shingles of one pair of 500-shingle texts collide with probability below 1e-9.  Sets are told apart by
about 126 bits of their shingles' hashes: in 10**12 texts two collide with probability below 1e-13.
The list of shared 64-bit fingerprints, which goes through the driver, has by chance three entries in
10**10 texts and 30,000 in 10**12.

Defined results: words are runs of characters other than space and U+0009-000D, A-Z lower-cased;
a text of one to four words is one shingle; null or wordless texts have n_shingles 0 and are
linked with nothing; repeated rows share a component; a null id yields to any other id of its
component; an empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.llm.graph import components
from geoloom.llm.textkernel import NON_SPACE, U64, distinct_per_text, mix, pieces, shingles, words_of
from geoloom.llm.workspace import stored

SHINGLE = 5
PERCENT = 75
BUCKET_SHINGLES = 1_000_000
FLUSH = 400_000
SAMPLE_TEXTS = 4_000
COMMON_LIMIT = 200_000
HUB_TURNS = 6
LONG_LIST = 128
SPREAD = 1024
BLOCK = 512
BLOCK_TOKENS = 1_000_000
_TOKEN_BITS = 48
_MASK = U64((1 << _TOKEN_BITS) - 1)


def text_sets(batch: pa.RecordBatch, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size of each text, its fingerprint, further bits of it, text of each shingle, shingle)."""
    text, value = distinct_per_text(*shingles(words_of(batch.column(text_col), NON_SPACE, lower=True), k))
    n = np.bincount(text, minlength=batch.num_rows)
    ends = np.cumsum(n)

    def folded(terms: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, U64), np.cumsum(terms, dtype=U64)))
        return mix((total[ends] - total[ends - n]) ^ mix(n.astype(U64)))

    return n, folded(value), folded((value ^ (value >> U64(32))) * value), text, value


def class_keys(first: np.ndarray, second: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What sets go by: the fingerprint, or its further bits where different sets share the fingerprint."""
    return np.where(np.isin(first, shared), second, first) if len(shared) else first


def needed(n, percent: int):
    """The least overlap T that a set of n needs with any partner."""
    return -(-percent * n // 100)


def _pack(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column whose i-th value ends at byte ends[i] of data."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def membership(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n_shingles, class, further): class is the fingerprint of the set, further its further bits."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                n, first, second, _, _ = text_sets(batch, text_col, k)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), *[pa.array(x.view(np.int64)) for x in (first, second)]], ["id", "n_shingles", "class", "further"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, n_shingles long, class long, further long")


def classed_members(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n_shingles, class) with one class for each different set, and the shared fingerprints."""
    met = stored(membership(docs, id_col, text_col, k), "join-members")
    apart = met.groupBy("class").agg(F.min("further").alias("lo"), F.max("further").alias("hi")).where("lo != hi")
    shared = sorted(r["class"] for r in apart.select("class").collect())
    if shared:
        met = stored(met.withColumn("class", F.when(F.col("class").isin(shared), F.col("further")).otherwise(F.col("class"))), "join-members")
    return met.drop("further"), np.array(shared, np.int64).view(U64)


def _common(docs: DataFrame, text_col: str, k: int, shared: np.ndarray, n_docs: int, sample: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three of about ``sample`` texts have, and their order (200 to 255).
    Texts are picked by a hash of the text.  A hint for the order of lists; it bounds nothing."""
    part = docs.select(text_col)
    if n_docs > sample:
        part = part.where(F.pmod(F.xxhash64(text_col, F.lit(17)), F.lit(-(-n_docs // sample))) == 0)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                _, first, second, text, value = text_sets(batch, text_col, k)
                key = class_keys(first, second, shared)
                yield pa.RecordBatch.from_arrays([pa.array(key[text].view(np.int64)), pa.array(value.view(np.int64))], ["class", "token"])

    seen = part.mapInArrow(run, "class long, token long").distinct().groupBy("token").agg(F.count("*").alias("df"))
    rows = seen.where("df >= 3").orderBy(F.desc("df"), "token").limit(limit).toPandas()
    token = rows["token"].to_numpy(np.int64).view(U64)
    order = np.argsort(token)
    rank = np.minimum(255, 200 + 4 * np.log2(np.maximum(1, rows["df"].to_numpy(np.int64)))).astype(np.uint8)
    return token[order], rank[order]


def _blobs(key, n, text, value, rank, buckets: int) -> Iterator[dict]:
    """A row per bucket: classes, their sizes, tokens for each, tokens; rank only for common ones."""
    common = rank > 0
    bucket = ((value >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)
    bucket[common] = -1 - (key[text[common]] % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, text, value, rank = bucket[order], text[order], value[order], rank[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own, at, count = np.unique(text[a:b], return_index=True, return_counts=True)
        yield {
            "bucket": int(bucket[a]), "key": key[own].tobytes(), "n": n[own].astype("<i4").tobytes(), "count": count.astype("<i4").tobytes(),
            "token": _pack(value[a:b] & _MASK).tobytes(), "rank": rank[a:b].tobytes() if bucket[a] < 0 else b"",
        }


_SENT = "bucket int, key binary, n binary, count binary, token binary, rank binary"


def _send(docs: DataFrame, text_col: str, k: int, shared: np.ndarray, buckets: int, common) -> DataFrame:
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("key", "n", "count", "token", "rank")]])

    def flush(held) -> pa.RecordBatch:
        key, n, text, value = [], [], [], []
        base = 0
        for part_n, part_key, part_text, part_value in held:
            key.append(part_key)
            n.append(part_n)
            text.append(part_text + base)
            value.append(part_value)
            base += len(part_n)
        key, n, text, value = (np.concatenate(x) for x in (key, n, text, value))
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True  # copies within the task go once
        on = first[text]
        text, value = text[on], value[on]
        tokens, ranks = common.value
        rank = np.zeros(len(value), np.uint8)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
            same = tokens[at] == value
            rank[same] = ranks[at[same]]
        return pa.RecordBatch.from_pylist(list(_blobs(key, n, text, value, rank, buckets)), schema)

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for batch in pieces(whole, text_col):
                n, first, second, text, value = text_sets(batch, text_col, k)
                held.append((n, class_keys(first, second, shared), text, value))
                size += len(value)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.select(text_col).mapInArrow(run, _SENT)


_SHARED = "part int, key binary, n binary, count binary, token binary, rank binary"
_ARRAYS = {"key": "<u8", "n": "<i4", "count": "<i4", "token": None, "rank": "u1"}


def _gathered(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Class keys, sizes, the class of each token, tokens and ranks of all rows together."""
    col = {c: b"".join(x for x in table.column(c).to_pylist()) for c in _ARRAYS}
    key, n, count, rank = (np.frombuffer(col[c], _ARRAYS[c]) for c in ("key", "n", "count", "rank"))
    return key, n, np.repeat(np.arange(len(key), dtype=np.int32), count), _unpack(col["token"]), rank


def _once(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of equal neighbours."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _sharer(parts: int):
    def shared(table: pa.Table) -> pa.Table:
        """Of one bucket: the tokens that two classes have at least, with their class, dealt by class."""
        key, n, owner, token, rank = _gathered(table)
        if table.column("bucket")[0].as_py() < 0:
            order = np.lexsort((token, key[owner]))
            order = order[_once(token[order], key[owner[order]])]
            token, owner, rank = token[order], owner[order], rank[order]
        else:
            order = np.argsort(token)
            twin = np.zeros(len(token) + 1, bool)
            twin[1:-1] = token[order[1:]] == token[order[:-1]]
            order = order[twin[1:] | twin[:-1]]
            order = order[np.lexsort((key[owner[order]], token[order]))]
            order = order[_once(token[order], key[owner[order]])]
            token, owner = token[order], owner[order]
            edge = np.append(np.flatnonzero(_once(token)), len(token))
            length = np.repeat(np.diff(edge), np.diff(edge))
            on = length > 1
            token, owner = token[on], owner[on]
            rank = np.minimum(199, 8 * np.log2(np.maximum(1, length[on]))).astype(np.uint8)
        part = (key % U64(parts)).astype(np.int32)[owner]
        order = np.lexsort((owner, part))
        part, owner, token, rank = part[order], owner[order], token[order], rank[order]
        edge = np.append(np.flatnonzero(_once(part)), len(part))
        rows = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own, count = np.unique(owner[a:b], return_counts=True)
            rows.append({
                "part": int(part[a]), "key": key[own].tobytes(), "n": n[own].tobytes(), "count": count.astype("<i4").tobytes(),
                "token": _pack(token[a:b]).tobytes(), "rank": rank[a:b].tobytes(),
            })
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in _ARRAYS]]))

    return shared


_SETS = "class long, n int, token binary, prefix array<struct<list:long,spread:int>>"


def _pieces(rank: np.ndarray, per_sample: float) -> np.ndarray:
    """Into how many pieces a list goes, from its rank: its length, or that in the sample, as a power."""
    length = np.where(rank < 200, 2.0 ** (rank / 8), per_sample * 2.0 ** ((rank.astype(float) - 200) / 4))
    return np.ceil(length / SPREAD).astype(np.int32)


def _setter(percent: int, per_sample: float):
    def sets(table: pa.Table) -> pa.Table:
        """Classes that share at least T tokens: sorted tokens for probing, and the shortest lists."""
        key, n, owner, token, rank = _gathered(table)
        order = np.lexsort((token, key[owner]))
        token, owner, rank = token[order], owner[order], rank[order]
        edge = np.append(np.flatnonzero(_once(key[owner])), len(owner))
        shared, first = np.diff(edge), edge[:-1]
        size = n[owner[first]].astype(np.int64)
        short = shared - needed(size, percent) + 1
        on = np.repeat(short > 0, shared)
        token, rank, own = token[on], rank[on], key[owner[on]]
        first, size, shared, short = (x[short > 0] for x in (key[owner[first]], size, shared, short))
        order = np.lexsort((token, rank, own))
        place = np.arange(len(token)) - np.repeat(np.cumsum(shared) - shared, shared)
        order = order[place < np.repeat(short, shared)]
        lists = pa.StructArray.from_arrays([pa.array(token[order].view(np.int64)), pa.array(_pieces(rank[order], per_sample))], ["list", "spread"])
        offsets = np.concatenate(([0], np.cumsum(short))).astype(np.int32)
        return pa.table({
            "class": pa.array(first.view(np.int64)), "n": pa.array(size, pa.int32()), "token": _binary(_pack(token), 6 * np.cumsum(shared)),
            "prefix": pa.ListArray.from_arrays(pa.array(offsets), lists),
        })

    return sets


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets overlap enough, by binary probes of the smaller in the larger."""
    both = pairs.select("a", "b")
    for side in ("b", "a"):
        both = both.join(sets.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("token").alias(f"t_{side}")), side)

    def run(batches):
        for batch in batches:
            on = []
            for na, ta, nb, tb in zip(*(batch.column(c).to_pylist() for c in ("n_a", "t_a", "n_b", "t_b")), strict=True):
                x, y = sorted((_unpack(ta), _unpack(tb)), key=len)
                at = np.searchsorted(y, x)
                common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                on.append(100 * common >= percent * (na + nb - common))
            mask = pa.array(on, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.select("a", "b", "n_a", "t_a", "n_b", "t_b").mapInArrow(run, "a long, b long")


def _possible(percent: int):
    """Size and position bounds for a pair that meets at positions p and q of the list order."""
    most = 1 + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    return (most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _contracted(label: DataFrame, links: DataFrame) -> DataFrame:
    """(class, root) after the links: components are found on the graph of roots only."""
    for side in ("a", "b"):
        links = links.join(label.select(F.col("class").alias(side), F.col("root").alias(f"r_{side}")), side)
    merged = components(links.where("r_a != r_b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).distinct(), "join-components")
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return stored(label.join(merged, "root", "left").select("class", F.coalesce("_to", "root").alias("root")), "join-labels")


_PIECE = ["list", "piece"]


def _all_pieces(lists: DataFrame) -> DataFrame:
    """A row per list to a row per piece of it."""
    return lists.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).drop("spread")


def _open(postings: DataFrame) -> DataFrame:
    """Postings of the lists that still touch two components at least."""
    mixed = postings.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("spread").alias("spread")).where("lo != hi")
    return stored(postings.join(_all_pieces(mixed.select("list", "spread")), _PIECE, "left_semi"), "join-open-lists")


def _relabelled(postings: DataFrame, label: DataFrame) -> DataFrame:
    return postings.drop("root").join(label, "class")


def _side(postings: DataFrame, side: str, *keys: str) -> DataFrame:
    return postings.select(*keys, F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("p").alias(f"p_{side}"), F.col("root").alias(f"r_{side}"))


def _blocks(long: DataFrame, block: int) -> DataFrame:
    """Postings of long lists dealt to pairs of blocks: (list, i, j, side, class, n, root).

    Of each list the component with most postings is the base.  Its postings need not meet each
    other; the rest, cut into blocks, meets the base's blocks and its own."""
    of_root = long.groupBy("list", "root").agg(F.count("*").alias("m"), F.max("spread").alias("spread"))
    shape = of_root.groupBy("list").agg(F.max_by("root", F.struct("m", "root")).alias("base"), F.max("m").alias("most"), F.sum("m").alias("all"), F.max("spread").alias("spread"))
    blocks = {"n_base": F.ceil(F.col("most") / block).cast("int"), "n_rest": F.ceil((F.col("all") - F.col("most")) / block).cast("int")}
    placed = long.join(_all_pieces(shape.select("list", "spread", "base", *[c.alias(k) for k, c in blocks.items()])), _PIECE)
    rest = F.col("root") != F.col("base")
    own = F.pmod(F.xxhash64("class"), F.when(rest, F.col("n_rest")).otherwise(F.col("n_base"))).cast("int")
    placed = placed.withColumns({"_own": own, "_rest": rest})
    none = F.array().cast("array<int>")
    all_rest, all_base = F.sequence(F.lit(0), F.col("n_rest") - 1), F.transform(F.sequence(F.lit(0), F.col("n_base") - 1), lambda j: -1 - j)
    # a block pair is (i, j): i a block of the rest, j a block of the rest from i on, or -1 - (block of the base)
    left = placed.where("_rest").select("list", "class", "n", "root", F.col("_own").alias("i"), F.explode(F.concat(F.filter(all_rest, lambda j: j >= F.col("_own")), all_base)).alias("j"), F.lit(0).alias("side"))
    right_rest = placed.where("_rest").select("list", "class", "n", "root", F.explode(F.filter(all_rest, lambda i: i < F.col("_own"))).alias("i"), F.col("_own").alias("j"), F.lit(1).alias("side"))
    right_base = placed.where("NOT _rest").select("list", "class", "n", "root", F.explode(F.when(F.col("n_rest") > 0, all_rest).otherwise(none)).alias("i"), (-1 - F.col("_own")).alias("j"), F.lit(1).alias("side"))
    return left.unionByName(right_rest).unionByName(right_base)


class _Inverted:
    """Inverted lists of some sets, searched for the sets that share T tokens with a query."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16 if len(sets) <= 1 << 16 else np.int32), [len(x) for x in sets])
        order = np.argsort(token, kind="stable")
        self.token, self.owner, self.percent = token[order], owner[order], percent

    def _set_aside(self, length: np.ndarray, least: int) -> int:
        """How many of the lists, rising in length, to probe and not to merge: what the merge reads,
        and at most so many candidates with a binary search in each long list."""
        aside = np.arange(min(least, len(length) + 1))
        total = np.concatenate(([0], np.cumsum(length)))
        merged = total[len(length) - aside]
        steps = np.concatenate(([0], np.cumsum(np.log2(length[::-1] + 1.0))))[aside]
        return int(np.argmin(merged + merged / (least - aside) * steps + 2_000 * aside))

    def search(self, query: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlap) of those that share at least T tokens with a query whose whole set has n."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.searchsorted(self.token, query, "left"), np.searchsorted(self.token, query, "right")
        order = np.argsort(high - low, kind="stable")
        low, high = low[order], high[order]
        low, high = low[high > low], high[high > low]
        least, length = needed(n, self.percent), high - low
        if len(length) < least:
            return none
        aside = self._set_aside(length, least)
        k = len(length) - aside
        at = np.repeat(low[:k] - np.cumsum(length[:k]) + length[:k], length[:k]) + np.arange(int(length[:k].sum()))
        met = np.sort(self.owner[at], kind="stable")
        edge = np.append(np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1]))), len(met))
        count, found = np.diff(edge), met[edge[:-1]]
        on = count >= least - aside
        found, count = found[on], count[on]
        for j in range(k, len(length)):
            if not len(found):
                return none
            own = self.owner[low[j] : high[j]]
            count = count + (own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found)
            on = count + (len(length) - 1 - j) >= least
            found, count = found[on], count[on]
        return found.astype(np.int64), count


def _block_linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Links between the sides of a block pair (within the left one if it meets itself), one for
        each left class and component."""
        side = table.column("side").to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if table.column("i")[0].as_py() != table.column("j")[0].as_py() else left
        found = []
        if len(left) and len(right):
            key, n, root = (table.column(c).to_numpy() for c in ("class", "n", "root"))
            sets = [_unpack(x) for x in table.column("token").to_pylist()]
            lists = _Inverted([sets[i] for i in right], percent)
            for i in left.tolist():
                there, common = lists.search(sets[i], n[i])
                hit = right[there[100 * common >= percent * (n[right[there]] + n[i] - common)]]
                hit = hit[root[hit] != root[i]]
                hit = hit[np.unique(root[hit], return_index=True)[1]]
                found += [(int(key[i]), int(key[j])) for j in hit]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return link


def _block_counter(percent: int):
    def count(table: pa.Table) -> pa.Table:
        """(class, linked): for each class the documents of the classes that it links with, between
        the sides of a block pair or within each component of a pack of small ones."""
        key, n, root, weight, side = (table.column(c).to_numpy() for c in ("class", "n", "root", "weight", "side"))
        sets = [_unpack(x) for x in table.column("token").to_pylist()]
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        linked = np.zeros(len(key), np.int64)
        order = np.argsort(root, kind="stable")
        edge = np.append(np.flatnonzero(_once(root[order])), len(order))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows = order[a:b]
            left, right = (rows, rows) if within else (rows[side[rows] == 0], rows[side[rows] == 1])
            if not len(left) or not len(right):
                continue
            lists = _Inverted([sets[i] for i in right], percent)
            for i in left.tolist():
                there, common = lists.search(sets[i], n[i])
                hit = right[there[100 * common >= percent * (n[right[there]] + n[i] - common)]]
                hit = hit[hit != i]
                linked[i] += weight[hit].sum()
                if not within:
                    linked[hit] += weight[i]
        on = linked > 0
        return pa.table({"class": pa.array(key[on], pa.int64()), "linked": pa.array(linked[on], pa.int64())})

    return count


def link_counts(label: DataFrame, weights: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, linked): how many documents of other classes each class links with.

    Links lie within components.  Small components are packed together; larger ones are cut into
    blocks of about ``BLOCK_TOKENS`` tokens that meet pairwise, a task holding two blocks.  No pair
    becomes a row, but each pair of classes of a component is searched once, so the work is the square
    of its distinct sets, and a class travels as often as its component has blocks."""
    own = label.join(sets.select("class", F.col("n").cast("long").alias("tokens")), "class")
    sizes = stored(own.groupBy("root").agg(F.count("*").alias("m"), F.sum("tokens").alias("tokens")).where("m > 1"), "join-sizes")
    placed = stored(label.join(sizes, "root").join(weights, "class"), "join-weighed")
    packs = max(1, -(-(placed.where(F.col("tokens") <= BLOCK_TOKENS).join(own.select("class", F.col("tokens").alias("size")), "class").agg(F.sum("size")).first()[0] or 0) // BLOCK_TOKENS))
    columns = ["class", "root", "weight"]
    zero = F.lit(0)
    small = placed.where(F.col("tokens") <= BLOCK_TOKENS).select(*columns, F.pmod(F.xxhash64("root"), F.lit(packs)).alias("pack"), zero.alias("i"), zero.alias("j"), zero.alias("side"))
    n_blocks = F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int")
    large = placed.where(F.col("tokens") > BLOCK_TOKENS).withColumn("_own", F.pmod(F.xxhash64("class"), n_blocks).cast("int")).withColumn("_all", F.sequence(zero, n_blocks - 1))
    left = large.select(*columns, F.col("root").alias("pack"), F.col("_own").alias("i"), F.explode(F.filter("_all", lambda j: j >= F.col("_own"))).alias("j"), zero.alias("side"))
    right = large.select(*columns, F.col("root").alias("pack"), F.explode(F.filter("_all", lambda i: i < F.col("_own"))).alias("i"), F.col("_own").alias("j"), F.lit(1).alias("side"))
    dealt = small.withColumn("kind", zero).unionByName(left.unionByName(right).withColumn("kind", F.lit(1))).join(sets.select("class", "n", "token"), "class")
    counted = dealt.groupBy("kind", "pack", "i", "j").applyInArrow(_block_counter(percent), "class long, linked long")
    return stored(counted.groupBy("class").agg(F.sum("linked").alias("linked")), "join-link-counts")


def _across(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, from every pair of classes that a list still holds apart: pair by
    pair in short lists, block by block in long ones."""
    length = postings.groupBy("list").agg(F.count("*").alias("length"), F.max("spread").alias("spread"))
    sized = stored(postings.join(_all_pieces(length), _PIECE), "join-sized-lists")
    short, long = (sized.where(c).drop("length") for c in (F.col("length") <= LONG_LIST, F.col("length") > LONG_LIST))
    pairs = _side(short, "a", "list").join(_side(short, "b", "list"), "list").where("a < b AND r_a != r_b").where(_possible(percent)).select("a", "b").distinct()
    links = _verified(stored(pairs, "join-cross-pairs"), sets, percent)
    if not long.isEmpty():
        dealt = _blocks(long, BLOCK).join(sets.select("class", "token"), "class")
        links = links.unionByName(dealt.groupBy("list", "i", "j").applyInArrow(_block_linker(percent), "a long, b long").distinct())
    return stored(links, "join-cross-links")


def class_links(docs: DataFrame, members: DataFrame, shared: np.ndarray, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(class, root) of the classes that may have a partner, and their sets."""
    spark = docs.sparkSession
    total, n_docs = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    buckets = max(8, -(-total // BUCKET_SHINGLES))
    common = spark.sparkContext.broadcast(_common(docs, text_col, k, shared, n_docs, SAMPLE_TEXTS, COMMON_LIMIT))
    held = _send(docs, text_col, k, shared, buckets, common).groupBy("bucket").applyInArrow(_sharer(buckets), _SHARED)
    sets = stored(held.groupBy("part").applyInArrow(_setter(percent, max(1.0, n_docs / SAMPLE_TEXTS)), _SETS), "join-sets")
    own = F.size("prefix") - 1 + (F.ceil(F.lit(percent) * F.col("n") / 100)).cast("int")  # shared tokens
    lists = sets.select("class", "n", (F.col("n") - own).alias("unique"), F.posexplode("prefix").alias("at", "l"))
    piece = F.pmod(F.xxhash64("class"), F.col("l.spread")).cast("int").alias("piece")
    postings = _open(lists.select("l.list", piece, "l.spread", "class", "n", (F.col("unique") + F.col("at") + 1).alias("p"), F.col("class").alias("root")))
    label = sets.select("class", F.col("class").alias("root"))

    for turn in range(HUB_TURNS):
        rank = F.col("class") if turn == 0 else F.xxhash64("list", "class", F.lit(turn))
        hubs = postings.groupBy("list").agg(F.min_by(F.struct("class", "n", "p", "root"), rank).alias("hub"), F.max("spread").alias("spread"))
        hubs = _all_pieces(hubs.select("list", "spread", "hub.*"))
        pairs = _side(hubs, "a", *_PIECE).join(_side(postings, "b", *_PIECE), _PIECE).where("r_a != r_b").where(_possible(percent))
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-hub-pairs")
        links = stored(_verified(pairs, sets, percent), "join-hub-links")
        found, tried = links.count(), pairs.count()
        if found:
            label = _contracted(label, links)
            postings = _open(_relabelled(postings, label))
        if found * 10 <= tried:
            break

    links = _across(postings, sets, percent)
    return (label if links.isEmpty() else _contracted(label, links)), sets


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, count_links: bool = False
) -> DataFrame:
    """(id, n_shingles, class, root, component), a row per document: the component is named by
    its smallest id, root is the class that stands for it.  With ``count_links`` also n_links, the
    number of other rows that the document links with."""
    return _joined(docs, id_col, text_col, k, percent, count_links)[0]


def _joined(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, count_links: bool) -> tuple[DataFrame, np.ndarray]:
    """What ``jaccard_components`` returns, and the shared fingerprints."""
    members, shared = classed_members(docs, id_col, text_col, k)
    roots, sets = class_links(docs, members, shared, text_col, k, percent)
    rooted = stored(members.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "join-rooted")
    smallest = stored(rooted.where("n_shingles > 0").groupBy("root").agg(F.min("id").alias("component")), "join-smallest")  # so that the join can split a large component
    named = rooted.join(smallest, "root", "left")
    names = ["id", "n_shingles", "class", "root", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component")]
    if count_links:
        weights = members.where("n_shingles > 0").groupBy("class").agg(F.count("*").alias("weight"))
        linked = weights.join(link_counts(roots, weights, sets, percent), "class", "left")
        linked = stored(linked.select("class", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "join-linked")  # so that the join can split a class of many copies
        named = named.join(linked, "class", "left")
        names.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return named.select(*names), shared


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row of the smallest id
    (null last) stays, once if it is repeated; texts without words all stay."""
    found, shared = _joined(docs, id_col, text_col, k, percent, False)
    key = F.struct(F.col("id").isNull().alias("none"), "id", "class")
    keepers = found.where("n_shingles > 0").groupBy("root").agg(F.min(key).alias("keep")).select(F.col("keep.id").alias("_id"), F.col("keep.class").alias("_keeper"))
    shaped = docs.withColumns({"_class": F.lit(0).cast("long"), "_n": F.lit(0).cast("long")})
    names = shaped.columns

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                n, first, second, _, _ = text_sets(batch, text_col, k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(class_keys(first, second, shared).view(np.int64)), pa.array(n, pa.int64())], names)

    classed = docs.mapInArrow(run, shaped.schema)
    met = classed.join(keepers, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("_keeper")), "left")
    kept = met.where("_n = 0 OR _keeper IS NOT NULL")
    if not found.where("n_shingles > 0").groupBy("id", "class").count().where("count > 1").isEmpty():  # repeated rows
        place = F.row_number().over(Window.partitionBy(id_col, "_class").orderBy("_n"))
        kept = kept.withColumn("_place", F.when(F.col("_n") > 0, place)).where("_n = 0 OR _place = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
