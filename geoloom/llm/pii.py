"""Operator 8: information-theoretic sanitisation of personal data.

Base detection finds e-mail addresses, IP addresses, card numbers and phone numbers.  Each
distinct value is a protected entity.  From the whole corpus it is counted in how many documents a
term occurs at all (n), and in how many it shares the document with an entity (both).  A term
reveals an entity if knowing the term gives the entity away: P(entity | term) = both / n is at
least ``DISCLOSURE`` and above P(entity), on at least ``SUPPORT`` documents, and this is no chance:
the log-likelihood ratio of P(entity | term) against P(entity) over the n documents,
n * KL(both / n || P(entity)), is at least ``BITS`` bits.  The evidence adds up over documents, so
an entity that stands in a third of all rows, or in a small table, can be given away as well.
Revealing terms are spans of kind "term" wherever they occur.

Sanitisation: a revealing term is generalised to the class of what it reveals, such as "[ALIAS OF AN
EMAIL]": its class is the set of kinds of the entities that it gives away.  A class that itself gives
an entity away (one entity has at least ``DISCLOSURE`` of the class's evidence) says no less than
its terms, so those terms are removed.  Base spans become their kind in brackets.

Scale: four scans and no shuffle of text.  An entity or pair in fewer than ``SUPPORT`` documents
can't be given away, so pairs (entity, term) are made only for entities in at least that many
(recognised by a bitmap of fixed size, false positives are removed by the counts that follow), and
are summed within tasks before the shuffle.  Beside them it is counted in how many of these
documents a term occurs; that is at most n, so a pair whose share of it is under ``DISCLOSURE``
can't reach ``DISCLOSURE`` of n either and goes.  For a term only the rarest entity of each kind and
number of shared documents is kept, as the others have less evidence on the same share.  Counts of
terms over all documents are taken only for terms of such pairs, again by a bitmap.  Up to
``BROADCAST_TERMS`` revealing terms are broadcast (nine bytes each); if there are more, the words that
pass a bitmap of them are joined to the terms by hash and come back to their texts by a hash of the
text, so nothing that grows with the corpus goes through the driver.  All expressions are found in
linear time, also in runs of megabytes.

Entities and terms are counted by 64-bit hashes.  Spans are code points, end exclusive.

Defined results: null text counts as empty and has no spans; identical rows count as the
documents they are and get identical results; an empty table gives an empty result.  Input columns
of the names of output columns are replaced, all others stay; names that begin with ``_geoloom`` are
reserved.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.textkernel import ALNUM, LOWER, U64, cut, pieces, text_buffer, words_of
from geoloom.llm.workspace import renewed, stored

SUPPORT = 3
DISCLOSURE = 0.8
BITS = 6.0
BROADCAST_TERMS = 4_000_000
BITMAP_BITS = 23
FLUSH = 1_000_000
TERM_BYTES = 3

#: Kinds and characters, in the order of the result.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Whole chains of digits: with single dots, or with single spaces and hyphens, between them.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a text must contain for a card to be possible at all.
_DIGITS_12 = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, each looked for from its "@"."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+): of each dotted chain every four numbers."""
    for chain in DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in four):
                yield at, end
            at = end + 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, normal form) of the base kinds, sorted; ``digits`` False says there are none."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if digits:
        if text.count(".") > 2:
            out += [(a, 1, b, text[a:b]) for a, b in addresses(text)]
        if _DIGITS_12.search(text):
            out += [(m.start(), 2, m.end(), d) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end(), d) for m in PHONE.finditer(text) if 9 <= len(d := _digits(m[0])) <= 15]
    return sorted(out)


class Scanned:
    """Base spans of the texts of a batch."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffer(column)
        wanted = np.zeros(256, bool)
        wanted[[*range(0x30, 0x3A)]] = True
        digit = np.concatenate(([0], np.cumsum(wanted[self.data])))[self.offsets]
        at = np.concatenate(([0], np.cumsum(self.data == 0x40)))[self.offsets]
        self.digits, self.ats = np.diff(digit) > 0, np.diff(at) > 0
        self.raw = self.data.tobytes()
        self.spans: dict[int, list[tuple[int, int, int, str]]] = {}
        for t in np.flatnonzero(self.digits | self.ats).tolist():
            if found := base_spans(self.text(t), bool(self.digits[t])):
                self.spans[t] = found

    def text(self, t: int) -> str:
        return self.raw[self.offsets[t] : self.offsets[t + 1]].decode()


def _entity(kind: int, value: str) -> int:
    """Hash of an entity; its two lowest bits are the kind."""
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True) & -4 | kind


def _disjoint(spans: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of sorted spans."""
    start, end = (np.array([s[i] for s in spans], np.int64) for i in (0, 2))
    reach = np.maximum.accumulate(end)
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]


def _outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int, str]]) -> np.ndarray:
    """Which of the words [start, end) meet none of the sorted spans."""
    if not spans:
        return np.ones(len(start), bool)
    low, high = _disjoint(spans)
    before = np.searchsorted(low, end, "left") - 1  # the last span that begins before the word ends
    return (before < 0) | (high[np.maximum(before, 0)] <= start)


def _together(docs: DataFrame, text_col: str, entities: DataFrame, bits: int) -> DataFrame:
    """(entity, term, n): documents that have both, for terms outside base spans; entities that
    are not among ``entities`` may stand among them.  With a null entity: documents with the term,
    of those that have any of these entities."""
    flags = docs.sparkSession.sparkContext.broadcast(_bitmap(entities.select(F.col("entity").alias("term")), bits))

    def summed(held) -> pa.RecordBatch:
        entity, term, none = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((term, entity, none))
        entity, term, none = entity[order], term[order], none[order]
        first = np.flatnonzero(np.concatenate(([True], (entity[1:] != entity[:-1]) | (term[1:] != term[:-1]) | (none[1:] != none[:-1]))))
        n = np.diff(np.append(first, len(entity)))
        return pa.RecordBatch.from_arrays([pa.array(entity[first], mask=none[first]), pa.array(term[first]), pa.array(n, pa.int64())], ["entity", "term", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in pieces(whole, text_col):
                spans_of = Scanned(batch.column(text_col)).spans
                own = {t: np.unique(np.array([_entity(k, v) for _, k, _, v in spans], np.int64)) for t, spans in spans_of.items()}
                own = {t: x for t, keys in own.items() if len(x := keys[flags.value[(keys.view(U64) >> U64(64 - bits)).astype(np.int64)]])}
                if not own:
                    continue
                data, offsets = text_buffer(batch.column(text_col).take(pa.array(list(own))))
                w = cut(LOWER[data], offsets, ALNUM)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for i, (t, keys) in enumerate(own.items()):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    shift = points[offsets[i]]
                    start, end = points[w.starts[a:b]] - shift, points[w.ends[a:b]] - shift
                    outside = ((w.ends[a:b] - w.starts[a:b]) >= TERM_BYTES) & _outside(start, end, spans_of[t])
                    terms = np.unique(w.hashes[a:b][outside]).view(np.int64)
                    if not len(terms):
                        continue
                    held.append((np.zeros(len(terms), np.int64), terms, np.ones(len(terms), bool)))
                    size += len(terms)
                    step = max(1, FLUSH // len(terms))
                    for j in range(0, len(keys), step):
                        some = keys[j : j + step]
                        held.append((np.repeat(some, len(terms)), np.tile(terms, len(some)), np.zeros(len(some) * len(terms), bool)))
                        size += len(some) * len(terms)
                        if size >= FLUSH:
                            yield summed(held)
                            held, size = [], 0
        if held:
            yield summed(held)

    return docs.select(text_col).mapInArrow(run, "entity long, term long, n long")


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(entity) once for each document that has it."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                found = [x for spans in Scanned(batch.column(text_col)).spans.values() for x in {_entity(k, v) for _, k, _, v in spans}]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["entity"])

    return docs.select(text_col).mapInArrow(run, "entity long")


def _bitmap(terms: DataFrame, bits: int) -> np.ndarray:
    """2**bits flags, set where a term's hash falls: at most 2**bits / 64 numbers are collected."""
    place = F.shiftrightunsigned("term", 64 - bits)
    words = terms.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - bits}) & 63 as int))")).alias("m"))
    flags = np.zeros(1 << (bits - 6), np.int64)
    for row in words.collect():
        flags[row["w"]] = row["m"]
    return np.unpackbits(flags.view(np.uint8), bitorder="little").astype(bool)


def _spread(docs: DataFrame, text_col: str, terms: DataFrame, bits: int) -> DataFrame:
    """(term, n): in how many documents each of the terms occurs; others that share their flags may stand among them."""
    flags = docs.sparkSession.sparkContext.broadcast(_bitmap(terms, bits))

    def summed(found, count):
        own, inverse = np.unique(np.concatenate(found), return_inverse=True)
        return own, np.bincount(inverse, np.concatenate(count), len(own)).astype(np.int64)

    def run(batches):
        found, count, size = [], [], 0
        for whole in batches:
            for batch in pieces(whole, text_col):
                w = words_of(batch.column(text_col), ALNUM, lower=True)
                on = flags.value[(w.hashes >> U64(64 - bits)).astype(np.int64)]
                text, value = w.text_of[on], w.hashes[on]
                order = np.lexsort((text, value))
                text, value = text[order], value[order]
                fresh = np.ones(len(value), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
                own, n = np.unique(value[fresh], return_counts=True)
                found.append(own)
                count.append(n)
                size += len(own)
                if size >= FLUSH:
                    own, n = summed(found, count)
                    found, count, size = [own], [n], len(own)
                    if size >= FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["term", "n"])
                        found, count, size = [], [], 0
        if found:
            own, n = summed(found, count)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["term", "n"])

    return docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _divergence(share, chance):
    """Bits by which a document with probability ``share`` tells it from one with ``chance``."""

    def part(x, y):
        return F.when(x > 0, x * F.log2(x / y)).otherwise(0.0)

    return part(share, chance) + part(1 - share, 1 - chance)


def revealing_terms(
    docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = BITS, bitmap_bits: int = BITMAP_BITS
) -> DataFrame:
    """(term, reveals, removed): hashes of the terms that give an entity away, the kinds of what they
    give away as bits, and whether the class of these kinds gives an entity away itself."""
    entities = _entities(docs, text_col).groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= support)
    entities = stored(entities, "pii-entities")
    together = _together(docs, text_col, entities, bitmap_bits).groupBy("entity", "term").agg(F.sum("n").alias("both")).where(F.col("both") >= support)
    together = stored(together, "pii-together")
    kind = F.col("entity").bitwiseAND(F.lit(3)).cast("int").alias("kind")
    pairs = together.join(entities, "entity").groupBy("term", "both", kind).agg(F.min_by(F.struct("entity", "with_entity"), F.struct("with_entity", "entity")).alias("e")).select("term", "both", "kind", "e.*")
    least = together.where("entity is null").select("term", F.col("both").alias("least"))
    pairs = stored(pairs.join(least, "term").where(F.col("both") / F.col("least") >= disclosure).drop("least"), "pii-pairs")
    terms = stored(pairs.select("term").distinct(), "pii-terms")
    total = docs.count()
    spread = _spread(docs, text_col, terms, bitmap_bits)
    told, chance = F.col("both") / F.col("n"), F.col("with_entity") / F.lit(total)
    judged = pairs.join(spread, "term").where((told >= disclosure) & (told > chance) & (F.col("n") * _divergence(told, chance) >= bits))
    judged = stored(judged.select("term", "entity", "both", F.expr("shiftleft(1, kind)").alias("bit")), "pii-judged")
    reveals = judged.groupBy("term").agg(F.bit_or("bit").alias("reveals"))
    evidence = judged.join(reveals, "term").groupBy("reveals", "entity").agg(F.sum("both").alias("of_entity"))
    classes = evidence.groupBy("reveals").agg((F.max("of_entity") / F.sum("of_entity") >= disclosure).alias("removed"))  # 15 rows at most
    return stored(reveals.join(F.broadcast(classes), "reveals").select("term", "reveals", "removed"), "pii-revealing")


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND, _TERMS, _TEXT = "_geoloom_found", "_geoloom_terms", "_geoloom_text"
_REMOVED = 32  # beside the kinds, in the class of a term


def sanitise(docs: DataFrame, text_col: str = "text", broadcast_terms: int = BROADCAST_TERMS, **thresholds) -> DataFrame:
    """All columns of ``docs`` plus found (spans), n_<kind>, base_spans and spans (text forms) and
    sanitised (each span generalised or removed; overlapping spans together).  In found, kinds from 4
    on are terms: 4 + the kinds that the term reveals as bits, + 32 if it is to be removed."""
    docs = renewed(docs, "found", *[f"n_{k}" for k in KINDS], "base_spans", "spans", "sanitised")
    terms = revealing_terms(docs, text_col, **thresholds)
    terms = terms.select("term", (F.col("reveals") + F.when(F.col("removed"), _REMOVED).otherwise(0)).alias("class"))
    n = terms.count()
    if n <= broadcast_terms:
        rows = terms.orderBy("term").toPandas()
        table = np.sort(rows["term"].to_numpy(np.int64).view(U64)), rows["class"].to_numpy(np.uint8)[np.argsort(rows["term"].to_numpy(np.int64).view(U64))]
        out = _marked(docs, text_col, docs.sparkSession.sparkContext.broadcast(table), [])
    else:
        keyed = docs.withColumn(_TEXT, F.xxhash64(text_col))
        hits = _occurrences(keyed.select(_TEXT, text_col), text_col, terms, min(30, max(16, int(np.log2(n)) + 5)))
        out = _marked(keyed.join(hits, _TEXT, "left").drop(_TEXT), text_col, None, [_TERMS])
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, F.least(s["kind"], F.lit(4)) + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: int):
        return F.size(F.filter("found", lambda s: F.least(s["kind"], F.lit(4)) == kind)).cast("long")

    counts = {f"n_{k}": number(i) for i, k in enumerate(KINDS)}
    return out.withColumns(counts | {"base_spans": joined(F.filter("found", lambda s: s["kind"] < 4)), "spans": joined(F.col("found"))}).select(*docs.columns, "found", *counts, "base_spans", "spans", "sanitised")


def _occurrences(texts: DataFrame, text_col: str, terms: DataFrame, bits: int) -> DataFrame:
    """(text hash, terms): per text the revealing terms that occur in it.  A text is joined through its
    terms, once for each distinct text and term."""
    flags = texts.sparkSession.sparkContext.broadcast(_bitmap(terms, bits))

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                w = words_of(batch.column(text_col), ALNUM, lower=True)
                on = flags.value[(w.hashes >> U64(64 - bits)).astype(np.int64)]
                key = batch.column(_TEXT).to_numpy()[w.text_of[on]]
                own = np.unique(np.stack((key, w.hashes[on].view(np.int64))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], [_TEXT, "term"])

    met = texts.mapInArrow(run, f"{_TEXT} long, term long").distinct().join(terms, "term")
    return met.groupBy(_TEXT).agg(F.collect_list(F.struct("term", "class")).alias(_TERMS))


def label(kind: int) -> str:
    """What stands for a span in a sanitised text."""
    if kind < 4:
        return f"[{KINDS[kind].upper()}]"
    reveals = kind - 4
    return "" if reveals & _REMOVED else "[ALIAS OF AN " + " OR ".join(k.upper() for i, k in enumerate(KINDS[:4]) if reveals >> i & 1) + "]"


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with labels for its spans (start, kind, end); of overlapping ones the first and longest speaks."""
    at, parts = 0, []
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2])):
        if s >= at:
            parts += [text[at:s], label(k)]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _marked(docs: DataFrame, text_col: str, broadcast_terms, dropped: list[str]) -> DataFrame:
    """Adds found, base spans and terms, and the sanitised text.  Terms are broadcast (sorted hashes
    and classes), or stand beside each text."""
    shaped = docs.drop(*dropped).withColumns({"found": F.lit(None).cast(_SPAN), "sanitised": F.lit("")})
    names = shaped.columns[:-2]

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                scanned = Scanned(batch.column(text_col))
                w = cut(LOWER[scanned.data], scanned.offsets, ALNUM)
                if broadcast_terms is not None:
                    known, classes = broadcast_terms.value
                    at = np.searchsorted(known, w.hashes)
                    hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == w.hashes) if len(known) else np.zeros(0, np.int64)
                    of = classes[at[hits]]
                else:
                    hits, of = _beside(batch.column(_TERMS), w)
                points = np.concatenate(([0], np.cumsum((scanned.data & 0xC0) != 0x80))) if len(hits) else None
                text = w.text_of[hits]
                edge = np.searchsorted(text, np.arange(batch.num_rows + 1))
                found, clean = [], []
                for t in range(batch.num_rows):
                    base = scanned.spans.get(t, [])
                    spans = [(s, k, e) for s, k, e, _ in base]
                    if edge[t] < edge[t + 1]:
                        own = hits[edge[t] : edge[t + 1]]
                        start, end = (points[x[own]] - points[scanned.offsets[t]] for x in (w.starts, w.ends))
                        on = _outside(start, end, base)
                        spans += zip(start[on].tolist(), (4 + of[edge[t] : edge[t + 1]][on].astype(int)).tolist(), end[on].tolist(), strict=True)
                    spans.sort(key=lambda x: (x[0], min(x[1], 4), x[2]))
                    found.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    clean.append(replaced(scanned.text(t), spans))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, _KIND), pa.array(clean, pa.string())], [*names, "found", "sanitised"])

    return docs.mapInArrow(run, shaped.schema)


def _beside(column: pa.Array, w) -> tuple[np.ndarray, np.ndarray]:
    """(words that are terms of their own text, their classes), from lists of terms per text."""
    owner, flat = column.value_parent_indices().to_numpy(), column.flatten()
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    term, kind = (flat.field(c).to_numpy() for c in ("term", "class"))
    _, number = np.unique(np.concatenate((term, w.hashes.view(np.int64))), return_inverse=True)
    width = int(number.max()) + 1
    key, mine = owner * width + number[: len(term)], w.text_of * width + number[len(term) :]
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], mine), len(key) - 1)
    hits = np.flatnonzero(key[order][at] == mine)
    return hits, kind[order][at[hits]].astype(np.uint8)
