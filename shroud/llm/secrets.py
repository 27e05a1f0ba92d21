"""Secret scans over a trigram inverted index, in DataFrame operations only.

``trigram_query`` derives from each rule's regular expression a Boolean query over lower-cased
trigrams that every match must satisfy (an OR of ANDs). ``build_index`` posts the documents under
the trigrams that some query names: for each block of 4,096 ids and each trigram, the sorted
offsets of the documents that hold it. ``candidates`` intersects and unites the posting lists of a
block, and ``scan`` verifies the candidates with the regular expressions. Rules without mandatory
trigrams (``hex``) scan every text.

The index holds a few bytes for each posting, and new rules over its trigrams need no new pass over
the texts. Candidates are broadcast where their measured size is small; beyond that, rows with at least
one posting carry their text into a shuffle join with them.

Edge cases: a null or empty text has no spans; a null id cannot be posted, so its row is verified
against every rule; rows that share an id are posted together and each verified on its own; ids must
be integers; spans of different kinds may overlap, spans of one kind do not; an empty table gives
an empty result; other input columns are not read.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, matches, span_text, stored, whole

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, group whose length is tested, least length). The first three are the base kinds.
RULES = {
    "assign": (_ASSIGN, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # all runs of 16 or more: shorter ones are dropped either way
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "hub_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "maps_key": (r"AIza[A-Za-z0-9_-]{35}", 0, 0),
}
BASE = ("assign", "access", "hex")
BLOCK_BITS = 12
LIMIT = 64  # most strings or clauses that are kept apart

Clauses = frozenset  # of frozensets of trigrams: an OR of ANDs; the empty AND is true
ALL = frozenset({frozenset()})


# --- from a regular expression to a trigram query -------------------------------------------
def _absorb(clauses) -> Clauses:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > LIMIT:
        return min((a, b), key=len)  # either one alone is implied
    return _absorb({x | y for x in a for y in b})


def _of_strings(strings) -> Clauses:
    return _absorb({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _strings(op, arg) -> set | None:
    """All lower-cased strings that a node matches; None if there are too many to list."""
    op = str(op)
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < LIMIT:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if op == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] <= 4:
        one = _sequence_strings(arg[2])
        if one is not None and len(one) ** arg[1] <= LIMIT:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return None


def _sequence_strings(items) -> set | None:
    out = {""}
    for item in items:
        s = _strings(*item)
        if s is None or len(out) * len(s) > LIMIT:
            return None
        out = {a + b for a in out for b in s}
    return out


def _of_node(op, arg) -> Clauses:
    op = str(op)
    if op == "SUBPATTERN":
        return _of_sequence(arg[3])
    if op == "BRANCH":
        parts = [_of_sequence(x) for x in arg[1]]
        return ALL if sum(map(len, parts)) > LIMIT else _absorb(frozenset().union(*parts))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
        return _of_sequence(arg[2])
    return ALL


def _of_sequence(items) -> Clauses:
    query, now = ALL, {""}
    for item in items:
        s = _strings(*item)
        if s is not None and len(now) * len(s) <= LIMIT:
            now = {a + b for a in now for b in s}
            continue
        query = _and(query, _of_strings(now))
        now = {""} if s is None else s
        if s is None:
            query = _and(query, _of_node(*item))
    return _and(query, _of_strings(now))


def trigram_query(pattern: str) -> Clauses:
    """An OR of ANDs of lower-cased trigrams that every text with a match satisfies; ``ALL`` if there is none."""
    return _of_sequence(re._parser.parse(pattern))


def _vocabulary(queries: dict) -> list[str]:
    return sorted({t for q in queries.values() for c in q for t in c})


# --- index ------------------------------------------------------------------------------
def _held(low: Column, vocabulary: list[str]) -> Column:
    """ARRAY of the numbers of those trigrams that a lower-cased text holds.

    ``low`` should be a column of its own: an expression would be evaluated for each trigram.
    """
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]).cast("array<int>"))


def build_index(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, trigram (its number), offsets (sorted): the posting lists of all rows with an id."""
    k = F.col(f"`{key}`").cast("long")
    low = docs.where(k.isNotNull()).select(
        F.shiftright(k, BLOCK_BITS).alias("block"), k.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("offset"),
        F.lower(whole(F.col(f"`{text}`"))).alias("low"))
    posts = low.select("block", "offset", F.explode(_held(F.col("low"), vocabulary)).alias("trigram"))
    return posts.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def candidates(index: DataFrame, queries: dict, vocabulary: list[str]) -> DataFrame:
    """key, rules (ARRAY of kinds): the ids whose postings satisfy each rule's query."""
    number = {t: i for i, t in enumerate(vocabulary)}
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "offsets"))).alias("lists"))
    none = F.array().cast("array<int>")

    def posting(t):
        return F.coalesce(F.try_element_at("lists", F.lit(number[t])), none)

    def clause(c):
        first, *rest = sorted(c)
        out = posting(first)
        for t in rest:
            out = F.array_intersect(out, posting(t))
        return out

    def named(hits, kind):
        return F.transform(hits, lambda o: F.struct(o.alias("offset"), F.lit(kind).alias("kind")))

    found = []
    for kind, query in queries.items():
        hits = none
        for c in sorted(query, key=sorted):
            hits = F.array_union(hits, clause(c))
        found.append(named(hits, kind))
    rows = block.select("block", F.explode(F.concat(*found)).alias("hit"))
    return rows.groupBy((F.shiftleft("block", BLOCK_BITS) + F.col("hit.offset")).alias("key")).agg(F.collect_set("hit.kind").alias("rules"))


# --- scan -------------------------------------------------------------------------------
def _spans(kind: str, text: Column, rules: dict) -> Column:
    pattern, group, least = rules[kind]
    found = matches(text, pattern, group=group or None)
    part = "part" if group else "match"
    if least:
        found = F.filter(found, lambda m: F.length(m[part]) >= least)
    order = list(rules).index(kind)
    return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), m.end.alias("end")))


_NONE = "array<struct<start:int,rank:int,kind:string,end:int>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict = RULES) -> DataFrame:
    """key, spans (ARRAY<STRUCT<start, rank, kind, end>>, by start, then kind as listed) of every row."""
    queries = {kind: trigram_query(pattern) for kind, (pattern, _, _) in rules.items()}
    queries = {kind: q for kind, q in queries.items() if q != ALL}
    vocabulary = _vocabulary(queries)
    t = whole(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias(key), t.alias("text"), F.lower(t).alias("low"))
    everywhere = F.concat(F.array().cast(_NONE), *[_spans(kind, F.col("text"), rules) for kind in rules if kind not in queries])
    rows = rows.select(key, everywhere.alias("scanned"), *([
        F.when(F.size(_held(F.col("low"), vocabulary)) > 0, F.col("text")).alias("text")] if queries else []))
    if not queries:
        return rows.select(key, F.array_sort("scanned").alias("spans"))
    hits = candidates(stored(build_index(docs, vocabulary, key, text), "trigram-index"), queries, vocabulary)
    hits = stored(hits.select(F.col("key").alias("hit"), "rules"), "trigram-hits")
    rows = join_checked(rows, hits, F.col(f"`{key}`").cast("long") == F.col("hit"))
    text = F.coalesce("text", F.lit(""))
    verified = [F.when(F.col(f"`{key}`").isNull() | F.array_contains("rules", kind), _spans(kind, text, rules))
                .otherwise(F.array().cast(_NONE)) for kind in queries]
    return rows.select(key, F.array_sort(F.concat("scanned", *verified)).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict = RULES) -> DataFrame:
    """key, number of spans of each base kind, digest of the base spans, and all spans as text."""
    found = scan(docs, key, text, rules)
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select(key, *[_count(kind).alias(f"n_{kind}") for kind in BASE],
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def report_sql(rules: dict = RULES) -> str:
    """The same rows in DuckDB, where each rule scans every text."""
    def spans(kind):
        pattern, group, least = rules[kind]
        p = pattern.replace("'", "''")
        test = f"length({'part' if group else 'match'}[i]) >= {least}"
        order = list(rules).index(kind)
        # start of match i: the pieces up to i and the matches before i
        at = "(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(match[1:i-1], lambda x: length(x))), 0))"
        return f"""SELECT row, list_transform(list_filter(range(1, len(match) + 1), lambda i: {test}), lambda i:
            {{'start': CAST({at} AS BIGINT), 'rank': {order}, 'kind': '{kind}', 'end': CAST({at} + length(match[i]) AS BIGINT)}}) AS s
            FROM (SELECT row, regexp_extract_all(t, '{p}', 0) AS match, regexp_extract_all(t, '{p}', {group}) AS part,
                  string_split_regex(t, '{p}') AS gap FROM docs)"""
    parts = " UNION ALL ".join(f"({spans(kind)})" for kind in rules)
    text = lambda x: f"list_aggregate(list_transform({x}, lambda y: y.kind || ':' || y.start || ':' || y.\"end\"), 'string_agg', ',')"
    counts = ", ".join(f"CAST(len(list_filter(s, lambda x: x.kind = '{kind}')) AS BIGINT) AS n_{kind}" for kind in BASE)
    base = ", ".join(f"'{kind}'" for kind in BASE)
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
        found AS (SELECT row, list_sort(flatten(list(s))) AS s FROM ({parts}) GROUP BY row)
        SELECT doc_id, {counts},
            sha256(coalesce({text(f"list_filter(s, lambda x: x.kind IN ({base}))")}, '')) AS base_sha256,
            coalesce({text('s')}, '') AS spans
        FROM docs JOIN found USING (row)"""
