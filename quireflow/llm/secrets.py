"""Secret scans by a trigram inverted index. DataFrame and SQL functions only.

From each rule's regex a Boolean query of trigrams is derived: every match holds the trigrams of one of its
alternatives. The index has a posting list for each of these trigrams and each range of texts (a range is a hash class of
bounded size): the hashes of the texts that have the trigram, lower-cased. Queries intersect (AND) and unite (OR)
the lists of a range; the texts left over are joined with the documents and verified with the regex itself. A rule without
mandatory trigrams, such as a run of hex digits, scans all documents. Texts are known by their hash: copies are
indexed once, and two texts of one hash only cost a verification more.

Spans count code points, end exclusive. Defined results: null text is empty text, which has no spans; repeated rows
get a row each, and so do rows without doc_id; an empty table gives an empty result; very long texts are scanned whole;
matches are leftmost and do not overlap within a kind, kinds may overlap each other, and spans of one start come in the
order of the rules. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import lookup, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret; with group, a match counts only if that group has least characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Letters in either case are spelled out: engines differ in what else they fold.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),  # of AKIA[A-Z0-9]+ those of 16 characters: a shorter run holds no longer match
    Rule("hex", "[0-9a-f]{32,}"),  # likewise
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)
#: Sets of more strings than this are not followed on.
STRINGS = 64
#: Trigrams of an alternative that are indexed, texts in a range of the index, candidates that are broadcast at most.
TERMS, RANGE_TEXTS, BROADCAST_TEXTS = 2, 4096, 1 << 18
#: Matches of a text whose places are summed up together.
BLOCK = 256


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[k : k + 3] for k in range(len(s) - 2))


Query = frozenset  # of alternatives, each a frozenset of trigrams all of which must be there; {frozenset()} is always true
TRUE: Query = frozenset({frozenset()})


def _or(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _and(a: Query, b: Query) -> Query:
    out: Query = frozenset()
    for x in a:
        for y in b:
            out = _or(out, frozenset({x | y}))
    return out


def _of(strings: set[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = _or(out, frozenset({trigrams(s)}))
    return out


def _node(op: object, arg: object) -> tuple[set[str] | None, Query]:
    """(all strings that it matches, lower-cased, if they are few; a query that holds for each match)."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, TRUE
    if name == "IN":
        out = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, TRUE
        return (out if len(out) <= 8 else None), TRUE
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= STRINGS:
            return set().union(*(s for s, _ in parts)), TRUE
        query: Query = frozenset()
        for s, q in parts:
            query = _or(query, q if s is None else _of(s))
        return None, query
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, sub = arg
        strings, query = _sequence(sub)
        if strings is not None and most == 1:
            return (strings | {""} if least == 0 else strings), TRUE
        if strings is not None and least == most and len(strings) ** least <= STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, TRUE
        return None, (TRUE if least == 0 else query if strings is None else _of(strings))
    return ({""}, TRUE) if name in ("AT", "ASSERT", "ASSERT_NOT") else (None, TRUE)


def _sequence(items: object) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, TRUE, True
    for op, arg in items:
        strings, q = _node(op, arg)
        if strings is not None and len(strings) * len(run) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _and(_and(query, _of(run)), q), False
        run = {""}
        if strings is not None:
            query = _and(query, _of(strings))
    return (run, TRUE) if whole else (None, _and(query, _of(run)))


def query(regex: str) -> Query:
    """Alternatives of trigrams of the lower-cased text, one of which each match has; TRUE if there are none."""
    strings, q = _sequence(parser.parse(regex))
    return q if strings is None else _of(strings)


def _rarity(t: str) -> tuple[int, str]:
    """Trigrams with fewer of the letters that are common in prose come first."""
    return sum(" etaoinsrhldcum".find(c) >= 0 for c in t), t


def indexed(rules: tuple[Rule, ...]) -> dict[str, Query]:
    """Each kind's alternatives, cut to the TERMS trigrams that tell most: those of other alternatives first, then the rarest.

    With fewer trigrams an alternative holds for more texts, never for fewer, so no match is lost.
    """
    chosen: set[str] = set()
    out = {}
    for r in rules:
        cut: Query = frozenset()
        for x in sorted(query(r.regex), key=sorted):
            best = sorted(x, key=lambda t: (t not in chosen, *_rarity(t)))[:TERMS]
            chosen |= set(best)
            cut = _or(cut, frozenset({frozenset(best)}))
        out[r.kind] = cut
    return out


def postings(texts: DataFrame, queries: dict[str, Query], range_texts: int = RANGE_TEXTS) -> DataFrame:
    """The inverted index of texts (h, text): a row (range, trigram, texts) for each trigram of the queries in each range of texts.

    texts are the hashes of the range's texts that have the trigram, lower-cased, copies once: a list is bounded by the range.
    """
    names = sorted({t for q in queries.values() for x in q for t in x})
    ranges = max(1, -(-texts.count() // range_texts))
    has = F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in names)) if names else F.expr("cast(array() AS array<string>)")
    each = texts.select("h", F.lower("text").alias("low")).select("h", F.explode(F.array_compact(has)).alias("trigram"))
    return each.groupBy(F.pmod("h", F.lit(ranges)).alias("range"), "trigram").agg(F.collect_set("h").alias("texts"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], queries: dict[str, Query]) -> DataFrame:
    """(h, rules): texts that the postings allow a match, with a bit for each such rule. Lists of a range are intersected (AND) and united (OR) in its own row."""
    lists = index.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("lists"))
    none = F.expr("cast(array() AS array<bigint>)")
    found = []
    for k, r in enumerate(rules):
        if queries[r.kind] != TRUE:
            either = none
            for x in sorted(queries[r.kind], key=sorted):
                both = None
                for t in sorted(x):
                    own = F.coalesce(F.try_element_at("lists", F.lit(t)), none)
                    both = own if both is None else F.array_intersect(both, own)
                either = F.array_union(either, both)
            found.append(F.struct(F.lit(1 << k).cast("long").alias("rule"), either.alias("texts")))
    if not found:
        return index.select(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("rules")).limit(0)
    each = lists.select(F.explode(F.array(*found)).alias("x")).select("x.rule", F.explode("x.texts").alias("h"))
    return each.groupBy("h").agg(F.bit_or("rule").alias("rules"))


def selected(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, text and rules, the bits of the rules whose postings allow a match; rules without mandatory trigrams have no bit.

    Candidates are broadcast up to BROADCAST_TEXTS (16 bytes each), beyond that documents and candidates meet in a shuffle join.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    queries = indexed(rules)
    some = stored(candidates(postings(d.select("h", "text"), queries), rules, queries), "candidates")
    if some.count() <= BROADCAST_TEXTS:
        out = d.join(F.broadcast(some), "h", "left")
    else:
        counted = d.select("h").join(some, "h").groupBy("h").agg(F.count("*").alias("n"), F.first("rules").alias("rules"))
        out = lookup(d, stored(counted, "counted"), "h", F.col("doc_id"))
    return out.select("doc_id", "text", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))


def spans(rule: Rule, rank: int) -> Column:
    """The rule's matches in text: structs (start, rank, kind, end). Pieces between matches and matches by turns give the places.

    Places are running sums: first of blocks of BLOCK matches, then within each, so that a text with n matches costs about n * BLOCK.
    """
    quoted = rule.regex.replace("\\", "\\\\").replace("'", "\\'")
    group = f"regexp_extract_all(text, '{quoted}', {rule.group})"
    arrays = f"array(named_struct('m', regexp_extract_all(text, '{quoted}', 0), 'g', {group}, 'p', split(text, '{quoted}', -1)))"
    piece, match = "length(x.p[i])", "length(x.m[i])"
    own = f"sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size(x.m)) - 1)"
    begins = f"aggregate(sequence(0, cast((size(x.m) - 1) div {BLOCK} AS int)), named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, b) -> named_struct('at', a.at + aggregate({own}, 0, (n, i) -> n + {piece} + {match}), 'out', concat(a.out, array(a.at))), a -> a.out)"
    step = f"named_struct('at', a.at + {piece} + {match}, 'out', concat(a.out, array(named_struct('start', a.at + {piece}, 'rank', {rank}, 'kind', '{rule.kind}', 'end', a.at + {piece} + {match}, 'size', length(x.g[i])))))"
    empty = "cast(array() AS array<struct<start: int, rank: int, kind: string, end: int, size: int>>)"
    found = f"transform({arrays}, x -> flatten(transform({begins}, (at, b) -> aggregate({own}, named_struct('at', at, 'out', {empty}), (a, i) -> {step}, a -> a.out))))[0]"
    return F.when(F.col("text").rlike(rule.regex), F.expr(f"filter({found}, s -> s.size >= {rule.least})")).otherwise(F.expr(empty))


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, a count n_<kind> for each base rule, base_sha256 and spans (all kinds, kind:start:end in the order of start, then rule)."""
    rules = base + more
    empty = F.expr("cast(array() AS array<struct<start: int, rank: int, kind: string, end: int, size: int>>)")
    d, everywhere = selected(docs, rules), {k for k, q in indexed(rules).items() if q == TRUE}
    parts = [spans(r, k) if r.kind in everywhere else F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, spans(r, k)).otherwise(empty) for k, r in enumerate(rules)]
    d = d.select("doc_id", F.sort_array(F.concat(*parts)).alias("found"))
    d = d.withColumn("base", F.filter("found", lambda s: s["rank"] < len(base)))
    counts = [F.size(F.expr(f"filter(base, s -> s.rank = {k})")).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return d.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))
