"""Spans found by regexes on the raw text of a row, without tokens: positions of matches, resolution of
overlaps, projection onto tokens, rewriting by position.

A span is ``struct<start,end,rank>`` in code points, end exclusive; ``rank`` is the kind's number in
``KINDS``. Each finder is a few scans of the text by a compiled regex; no rule runs at each token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import at, let, marked, prefix_max, prefix_sum
from .batches import SENTINEL, match_marks, spans_of_marks

KINDS = ("PERSON", "DATE", "LOCATION", "EMAIL", "PHONE_NUMBER", "URL")
SPANS_TYPE = "array<struct<start:int,end:int,rank:int>>"

# --- fixed rule vocabulary --------------------------------------------------------------
NAME_CUES = ("name",)
HONORIFICS = ("Dr", "Mr", "Mrs", "Ms", "Prof")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December",
          "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec")
JOINERS = ("-", "'", "’")
# --- end of fixed rule vocabulary -------------------------------------------------------

_E = r"(?![\p{L}\p{N}_])"  # a token ends
_S = r"[^\S\n]"  # white space on the same line
_WORD = rf"\p{{Lu}}\p{{L}}*+{_E}"  # a capitalised word, an initial or a word in capitals
_NAME_PART = rf"(?:\p{{Lu}}\.(?={_S}+{_WORD})|{_WORD})"  # J. as an initial before a word
_HONORIFIC = "|".join(HONORIFICS)


def _first(chars: str) -> str:
    """One of these characters at the begin of a token. It is consumed before anything else is looked at, so that other places cost one step."""
    return rf"[{chars}](?<![\p{{L}}\p{{N}}_][{chars}])"


def _rest(words, fold: bool = False) -> str:
    """The rest of one of ``words``, longest first, whose first character was consumed."""
    by = {}
    for w in sorted(words, key=len, reverse=True):
        by.setdefault(w[0].lower() + w[0].upper() if fold else w[0], []).append(w[1:])
    return "(?:" + "|".join(f"(?<=[{c}])(?{'iu' if fold else ''}:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_CUE_FIRST = "".join(sorted({x for c in NAME_CUES for x in c[0].lower() + c[0].upper()} | {h[0] for h in HONORIFICS}))
_CUE = rf"{_first(_CUE_FIRST)}(?:{_rest(NAME_CUES, True)}{_S}*:{_S}*|{_rest(HONORIFICS)}(?:{_S}*\.{_S}*|{_S}+))"
_NAME = (rf"(?!(?:{_HONORIFIC})(?:{_S}*\.|{_S}+\p{{Lu}}))"
         rf"{_NAME_PART}(?:(?:{_S}+|[{''.join(JOINERS)}]){_NAME_PART})*")
# a cue, then the whole run of name parts on the line; a run does not begin with an honorific that is a cue itself
PERSON_PATTERN = rf"(?U){_CUE}({_NAME})"
PERSON_PARTS = rf"(?U)({_CUE})({_NAME})"
_M = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_CLOCK = rf"(?:(?:[T]|{_S}+)[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?{_E}|{_S}+(?:[01][0-9]|2[0-3])[0-5][0-9]{_E})"
_D, _Y = "[0-9]{1,2}", "[0-9]{4}"
# layouts of ``dates.DATE_LAYOUTS`` (with a time of day where one follows) and a month with its year
DATE_PATTERN = (
    rf"(?U){_first('0123456789' + ''.join(sorted({m[0] for m in MONTHS})))}(?:(?<=[0-9])(?:"
    rf"(?:[0-9]?(?:/{_D}/(?:{_Y}|[0-9]{{2}}){_E}|-{_D}-{_Y}{_E})|[0-9]{{3}}(?:-{_D}-{_D}(?:{_E}|(?=T[0-9]))|/{_D}/{_D}{_E})){_CLOCK}?"
    rf"|[0-9]?{_S}+{_M}{_S}+{_Y}{_E}|(?:(?<=1)9|(?<=2)0)[0-9]{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]){_E})"
    rf"|{_rest(MONTHS)}{_S}+(?:{_D}(?:,{_S}+|{_S}+))?{_Y}{_E})")
CAPITAL_PATTERN = rf"(?U)\p{{Lu}}(?<![\p{{L}}\p{{N}}_]\p{{Lu}})[\p{{L}}\p{{N}}_]*+"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """ARRAY<STRUCT<start,end,found>> of a literal pattern's matches, or of a group that ends where the match does.

    Pieces and matches come from the same left-to-right scan; ends are a running sum of their lengths.
    """
    width = 3 if group else 2

    def build(pieces):
        at_match = F.sequence(F.lit(1), F.size(pieces) - width, F.lit(width))
        ends = prefix_sum(F.transform(at_match, lambda k: F.length(pieces[k - 1]) + F.length(pieces[k])))
        return F.zip_with(at_match, ends, lambda k, e: let(pieces[k + width - 2], lambda m: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), m.alias("found"))))
    return let(marked(text, pattern, group), lambda pieces: F.when(
        F.size(pieces) > 1, build(pieces)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>")))


def as_spans(found: Column, kind: str) -> Column:
    """Located matches as spans of one kind."""
    return F.transform(found, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"))).cast(SPANS_TYPE)


def person_spans(text: Column) -> Column:
    return as_spans(located(text, PERSON_PATTERN, 1), "PERSON")


def date_spans(text: Column) -> Column:
    return as_spans(located(text, DATE_PATTERN), "DATE")


def found_spans(text: Column, entries=()) -> Column:
    """ARRAY of PERSON and DATE spans and of the words in ``entries`` (lower-cased) that begin with a capital, as ``left_to_right`` leaves them.

    One Arrow function over the marked texts; null for a text that is null or holds the sentinel.
    """
    none = F.lit(None).cast("string")
    persons, dates = match_marks(text, PERSON_PARTS, f"$1{SENTINEL}$2{SENTINEL}"), match_marks(text, DATE_PATTERN)
    words = match_marks(text, CAPITAL_PATTERN) if entries else none
    find = spans_of_marks([KINDS.index(k) for k in ("PERSON", "DATE", "LOCATION")], entries, SPANS_TYPE)
    return F.when(~text.contains(SENTINEL), find(persons, dates, words, F.lower(words)))


def left_to_right(spans: Column) -> Column:
    """Spans that do not overlap: from left to right, at each place the longest, then the lowest rank."""
    def take(acc, s):
        return F.when(s.start >= acc.free, F.struct(s.end.alias("free"), F.array_append(acc.taken, s).alias("taken"))).otherwise(acc)
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,neg:int,rank:int,end:int>>").alias("taken"))
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), (s.start - s.end).alias("neg"), s.rank.alias("rank"), s.end.alias("end")))
    return F.when(F.size(spans) < 2, spans).otherwise(F.transform(
        F.aggregate(F.array_sort(keyed), start, take, lambda acc: acc.taken),
        lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.rank.alias("rank"))))


def longest_first(spans: Column) -> Column:
    """Spans that do not overlap, in text order: the longest of all is taken, then the next that meets none taken (of equal ones the first, then the lowest rank).

    Spans that meet no other are taken at once; only the rest, rarely any, are compared with one another.
    """
    def alone(s):
        def mark(reach):  # bound: written out inside the lambda it would be computed again for each span
            return F.transform(s, lambda x, i: F.struct(
                (((i == 0) | (at(reach, i - 1) <= x.start)) & F.coalesce(F.try_element_at(s, i + 2).start >= x.end, F.lit(True))).alias("alone"), x.alias("span")))
        return let(prefix_max(F.transform(s, lambda x: x.end)), mark)

    def settle(marked):
        free = F.transform(F.filter(marked, lambda m: m.alone), lambda m: m.span)
        met = F.transform(F.filter(marked, lambda m: ~m.alone), lambda m: F.struct(
            (m.span.start - m.span.end).alias("neg"), m.span.start.alias("start"), m.span.rank.alias("rank"), m.span.end.alias("end")))

        def take(acc, s):
            return F.when(F.exists(acc, lambda t: (t.start < s.end) & (s.start < t.end)), acc).otherwise(F.array_append(acc, F.struct(
                s.start.alias("start"), s.end.alias("end"), s.rank.alias("rank"))))
        return F.array_sort(F.concat(free, F.aggregate(F.array_sort(met), F.array().cast(SPANS_TYPE), take)))
    return F.when(F.size(spans) < 2, spans).otherwise(let(F.array_sort(spans), lambda s: let(alone(s), settle)))


def bio_labels(tokens: Column, spans: Column) -> Column:
    """ARRAY<STRING>: spans that do not overlap, in text order, as labels of the tokens they cover."""
    def write(places):  # first and last token, 0-based, of each span
        def piece(p, j):
            free = F.when(j > 0, at(places, j - 1).last + 1).otherwise(0)
            kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), p["rank"] + 1)
            return F.concat(F.array_repeat(F.lit("O"), p["first"] - free), F.array(F.concat(F.lit("B-"), kind)),
                            F.array_repeat(F.concat(F.lit("I-"), kind), p["last"] - p["first"]))
        rest = F.size(tokens) - 1 - F.coalesce(F.try_element_at(places, F.lit(-1))["last"], F.lit(-1))
        return F.concat(F.flatten(F.transform(places, piece)), F.array_repeat(F.lit("O"), rest))

    def place(starts, ends):
        return F.transform(spans, lambda s: F.struct((F.array_position(starts, s.start) - 1).cast("int").alias("first"),
                                                     (F.array_position(ends, s.end) - 1).cast("int").alias("last"), s.rank.alias("rank")))
    return F.when(F.size(spans) == 0, F.array_repeat(F.lit("O"), F.size(tokens))).otherwise(
        let(tokens["start"], lambda starts: let(tokens["end"], lambda ends: let(
            place(starts, ends), write))))


def surface(text: Column, span: Column) -> Column:
    """The span's text with every run of white space as one blank."""
    return F.regexp_replace(F.substring(text, span.start + 1, span.end - span.start), r"(?U)\s+", " ")


def mentions_of(text: Column, spans: Column, kinds: tuple) -> Column:
    """ARRAY<STRUCT<entity,ord,value,start,end>>: spans of ``kinds`` in the order of ``kinds``, then of the text."""
    def of(kind):
        own = F.filter(spans, lambda s: s.rank == KINDS.index(kind))
        return F.transform(own, lambda s, i: F.struct(F.lit(kind).alias("entity"), i.alias("ord"), surface(text, s).alias("value"),
                                                      s.start.alias("start"), s.end.alias("end")))
    return let(spans, lambda s: F.concat(*[of(k) for k in kinds])) if len(kinds) != 1 else of(kinds[0])


def rewrite_spans(text: Column, pieces: Column) -> Column:
    """``text`` with every ``struct<start,end,fake>`` of ``pieces`` (in text order, not overlapping) replaced; a NULL fake keeps the text."""
    def piece(p, i):
        begin = F.when(i > 0, at(pieces, i - 1).end).otherwise(0)
        own = F.substring(text, p.start + 1, p.end - p.start)
        return F.concat(F.substring(text, begin + 1, p.start - begin), F.coalesce(p.fake, own))
    tail = F.coalesce(F.try_element_at(pieces, F.lit(-1)).end, F.lit(0))
    return F.when(F.size(pieces) == 0, text).otherwise(F.concat(
        F.array_join(F.transform(pieces, piece), ""), F.substring(text, tail + 1, F.length(text) - tail)))
