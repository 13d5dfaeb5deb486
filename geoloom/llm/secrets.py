"""Operator 5: secret scans with a trigram inverted index.  Built-in functions only.

From each rule's regular expression a Boolean query over trigrams is derived: strings that a match
must contain give the conjunction of their trigrams, alternatives a disjunction.  The index is a
table of postings (trigram, row) over the trigrams that any rule needs, made from lower-cased
texts.  Postings are intersected per row (a bit per trigram, or-ed by row), each rule's query is
evaluated on the bits, and only candidate rows are verified with the expression itself.  Rules
whose expression has no mandatory trigram (long hexadecimal runs) scan every text.

Scale: the index holds a row for each (needed trigram, text) at most, its aggregation combines on
the map side, and the bits are joined back by a hash of (id, text); if two rows ever share that hash
both are verified for either's rules, which changes no result.  Nothing is broadcast.

Spans are code points of the text, end exclusive.  Kinds: assign, access, hex are fixed; the
method adds private_key, github, slack, jwt and google.

Defined results: null text counts as empty and has no spans; identical rows get identical results;
a null id is an id like any other; an empty table gives an empty result.  Input columns that
clash with output columns are replaced, all others stay; names that begin with ``_geoloom`` are
reserved.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.workspace import renewed, stored

#: Marks the borders of matches; in the text it is first replaced by a neighbour that no rule mentions.
_MARK, _OTHER = "\u0001", "\u0002"
_ROW, _CANDIDATE, _FOUND = "_geoloom_row", "_geoloom_candidate", "_geoloom_found"
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_BITS = 62


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # for java.util.regex and for the query derivation alike
    least: int  # characters that group ``group`` of a match must have
    group: int = 0
    base: bool = False


#: Kinds and patterns.  A run is asked for at its least length where that is equivalent.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", 24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 1),
)

#: A query: True (anything), ("tri", t), ("and", ...) or ("or", ...).
Query = bool | tuple
_MOST_STRINGS = 64
MOST_TRIGRAMS = 4


def _both(*queries: Query) -> Query:
    parts = {q for q in queries if q is not True}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", *sorted(parts, key=str))


def _either(queries: list[Query]) -> Query:
    parts = set(queries)
    return True if True in parts else parts.pop() if len(parts) == 1 else ("or", *sorted(parts, key=str))


def _strings(found: set[str]) -> Query:
    """What a text holds if it holds one of these strings: of each string up to MOST_TRIGRAMS
    trigrams, spread over it; a string that contains another one adds nothing."""
    least = [s for s in found if not any(o != s and o in s for o in found)]
    parts = []
    for s in least:
        n = len(s) - 2
        at = sorted({round(i * (n - 1) / (MOST_TRIGRAMS - 1)) for i in range(MOST_TRIGRAMS)}) if n > 0 else []
        parts.append(_both(*[("tri", s[i : i + 3]) for i in at]))
    return _either(parts)


def _letters(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tokens) -> tuple[set[str] | None, Query]:
    """(all strings it can match, if few; what a match implies)."""
    run, known, exact = {""}, True, True

    def close() -> None:
        nonlocal run, known, exact
        known, run, exact = _both(known, _strings(run)), {""}, False

    for op, value in tokens:
        own: set[str] | None = None
        implied: Query = True
        if op is sre.LITERAL:
            own = {chr(value).lower()}
        elif op is sre.IN:
            own = _letters(value)
        elif op is sre.SUBPATTERN:
            own, implied = _walk(value[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            own = None if any(s is None for s, _ in parts) else set().union(*[s for s, _ in parts])
            implied = _either([q if s is None else _strings(s) for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = value
            inner, implied = _walk(body)
            if inner is not None and (low, high) == (0, 1):
                own = inner | {""}
            elif low == 0:
                implied = True
            elif inner is not None and len(inner) ** low <= _MOST_STRINGS:
                own = {""}
                for _ in range(min(low, 8)):
                    own = {a + b for a in own for b in inner}
                if high != low or low > 8:  # what follows is unknown
                    run = {a + b for a in run for b in own} if len(run) * len(own) <= _MOST_STRINGS else run
                    close()
                    continue
        if own is not None and len(run) * len(own) <= _MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        close()
        known = _both(known, implied if own is None else _strings(own))
    return (run, True) if exact else (None, _both(known, _strings(run)))


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies."""
    found, implied = _walk(sre_parser.parse(pattern))
    return _strings(found) if found is not None else implied


def _trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*[_trigrams(q) for q in query[1:]])


def _holds(query: Query, place: dict[str, int]) -> Column:
    """The query on the columns of bits that ``intersect`` makes."""
    if query is True:
        return F.lit(True)
    if query[0] == "tri":
        group, bit = divmod(place[query[1]], _BITS)
        return F.col(f"bits{group}").bitwiseAND(F.lit(1 << bit)) != 0
    parts = [_holds(q, place) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def build_index(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, row): which rows' lower-cased texts contain which of the trigrams."""
    low = docs.select(row_key(id_col, text_col).alias("row"), F.lower(text_col).alias("_low"))
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return low.select("row", F.explode(present).alias("trigram")).select("trigram", "row")


def intersect(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(row, candidate): candidate lists the rules, by number, whose query the row's postings satisfy.
    A row's postings are bits, 62 trigrams to a column."""
    place = {t: i for i, t in enumerate(trigrams)}
    number = F.element_at(F.create_map(*[x for t, i in place.items() for x in (F.lit(t), F.lit(i))]), F.col("trigram"))
    placed = index.select("row", number.alias("number")).withColumn("bit", F.expr(f"shiftleft(1L, number % {_BITS})"))
    groups = range(-(-len(trigrams) // _BITS))
    rows = placed.groupBy("row").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("number") / _BITS) == g, F.col("bit"))), F.lit(0)).alias(f"bits{g}") for g in groups])
    queries = [(k, trigram_query(rule.pattern)) for k, rule in enumerate(rules)]
    holds = [F.when(_holds(q, place), F.lit(k)) for k, q in queries if q is not True]
    found = F.array_compact(F.array(*holds)) if holds else F.array().cast("array<int>")
    return rows.select("row", found.alias("candidate")).where(F.size("candidate") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, end>> of the matches that pass.

    Every match is put between marks.  The places of the marks among the characters, less the marks
    before, are its borders; the parts between marks are the matches.  No step looks back, so a text of
    very many matches takes linear time."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), f"({rule.pattern})", f"{_MARK}$1{_MARK}")
    places = F.array_compact(F.transform(F.split(marked, ""), lambda c, i: F.when(c == _MARK, i)))
    match = F.filter(F.split(marked, _MARK), lambda _, i: i % 2 == 1)
    size = F.length if not rule.group else lambda part: F.length(F.regexp_extract(part, rule.pattern, rule.group))

    def span(pair: Column, i: Column) -> Column:
        return F.when(size(pair["match"]) >= rule.least, F.struct((pair["start"] - 2 * i).alias("start"), F.lit(order).alias("kind"), (pair["end"] - 2 * i - 1).alias("end")))

    starts, ends = F.filter(places, lambda _, i: i % 2 == 0), F.filter(places, lambda _, i: i % 2 == 1)
    found = F.array_compact(F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end"), match.alias("match")), span))
    return F.when(F.contains(marked, F.lit(_MARK)), found).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` plus n_<kind> of the fixed kinds, base_spans and spans (text form)."""
    base = [r for r in rules if r.base]
    docs = renewed(docs, *[f"n_{r.kind}" for r in base], "base_spans", "spans")
    trigrams = sorted(set().union(*[_trigrams(trigram_query(r.pattern)) for r in rules]))
    index = stored(build_index(docs, id_col, text_col, trigrams), "secret-postings")
    candidates = intersect(index, rules, trigrams).withColumnsRenamed({"row": _ROW, "candidate": _CANDIDATE})
    joined = docs.withColumn(_ROW, row_key(id_col, text_col)).join(candidates, _ROW, "left")
    kinds = [r.kind for r in rules]
    none = F.array().cast(_SPANS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    for k, rule in enumerate(rules):
        found = _spans(text, rule, k)
        if trigram_query(rule.pattern) is not True:
            found = F.when(F.coalesce(F.array_contains(_CANDIDATE, k), F.lit(False)), found).otherwise(none)
        joined = joined.withColumn(f"{_FOUND}_{k}", found)
    of = {r.kind: F.col(f"{_FOUND}_{k}") for k, r in enumerate(rules)}
    added = {f"n_{r.kind}": F.size(of[r.kind]).cast("long") for r in base}
    added["base_spans"] = _joined(F.sort_array(F.concat(none, *[of[r.kind] for r in base])), kinds)
    added["spans"] = _joined(F.sort_array(F.concat(*of.values())), kinds)
    return joined.withColumns(added).drop(_ROW, _CANDIDATE, *[f"{_FOUND}_{k}" for k in range(len(rules))])
