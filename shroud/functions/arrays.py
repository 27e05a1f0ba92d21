"""Array building blocks: prefix sums, regex tokens with character offsets, windows, padding.

Everything here is a column expression evaluated inside one row, so per-document work never
needs a shuffle. Offsets are code points, end exclusive (the same unit as ``substring``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python-style word pieces: a run of word characters, or one other non-space character.
TOKEN_PATTERN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TOKEN_PATTERN_RE2 = r"[\pL\pN_]+|[^\pL\pN_\s]"

TOKEN_STRUCT = "struct<token:string,start:int,end:int>"
TOKENS_TYPE = f"array<{TOKEN_STRUCT}>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A column expression referenced twice is evaluated twice, and inside a lambda once per
    element; binding it first keeps every step linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, cols, values: Column, out: str, pos: str = "_at") -> DataFrame:
    """``cols``, ``pos`` and ``out``: one row for each element of ``values``, as ``posexplode`` gives them.

    Of a plain ``posexplode`` Spark infers the filter that the array has elements, and moves it, with everything that makes the
    array, down to the scan: the work is done twice, once by the few tasks that read the file. The outer form infers none.
    """
    return df.select(*cols, F.posexplode_outer(values).alias(pos, out)).where(F.col(pos).isNotNull())


SENTINEL = "\u0000"


def split_on(text: Column, pattern: str | Column) -> Column:
    """``split(text, pattern, -1)``: the n+1 pieces around the n matches.

    Spark's ``split`` compiles its regex on every row. For a literal pattern the matches are
    first replaced by one sentinel character (``regexp_replace`` keeps the compiled pattern) and
    the text is split on that character, which needs no regex at all. A row that already holds
    the sentinel takes the plain path, so the result is always exact.
    """
    if not isinstance(pattern, str):
        return F.split(text, pattern, -1)
    fast = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(SENTINEL)), SENTINEL, -1)
    return F.when(F.instr(text, SENTINEL) == 0, fast).otherwise(F.split(text, pattern, -1))


def marked(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """The text as [gap, match, gap, ..., match, gap], or [gap, match, group, gap, ...] with a group, from a single scan by a pattern.

    Matches are set between sentinel characters and the text is split on those, which needs no regex. A row that
    already holds the sentinel takes two plain scans, so the result is always exact.
    """
    mark = SENTINEL + "$0" + SENTINEL + (f"${group}" + SENTINEL if group else "")
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    fast = F.split(F.regexp_replace(text, p, F.lit(mark)), SENTINEL, -1)
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = [F.split(text, pattern, -1), found] + ([F.regexp_extract_all(text, p, F.lit(group))] if group else [])
    names = ("gap", "match", "group")[:len(parts)]
    zipped = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, names)]), lambda z: F.array(*[z[n] for n in names]))
    plain = F.slice(F.flatten(zipped), 1, F.size(found) * len(parts) + 1)
    return F.when(F.instr(text, SENTINEL) > 0, plain).otherwise(fast)


def at(values: Column, i) -> Column:
    """0-based element, NULL when ``i`` is outside the array (never an error, never from the end)."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when((i >= 0) & (i < F.size(values)), values[i])


SHORT = 32  # elements up to which a scan goes step by step


def _scan(values: Column, combine) -> Column:
    """Inclusive scan of an array with an associative ``combine`` in O(n log n), one row at a time.

    Hillis-Steele: in round k every element combines with the element 2^k places before it;
    ceil(log2 n) rounds. Each round reads the previous round's array by index (O(1)). Arrays of at most ``SHORT``
    elements, where copying costs less than rounds do, are appended to one element after the other.
    """
    def scan(v):
        n = F.size(v)
        rounds = F.when(n <= 1, F.lit(0)).otherwise(F.ceil(F.log2(n.cast("double"))).cast("int"))

        def one_round(acc, k):
            d = F.pow(F.lit(2), k).cast("int")
            return let(d, lambda e: F.transform(acc, lambda x, i: F.when(i >= e, combine(x, acc[i - e])).otherwise(x)))

        def step(acc, x):
            return F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(combine(x, acc[F.size(acc) - 1])))

        return F.when(n <= 1, v).when(n <= SHORT, F.aggregate(v, F.slice(v, 1, 0), step)).otherwise(
            F.aggregate(F.sequence(F.lit(0), rounds - 1), v, one_round))

    return let(values, scan)


def prefix_sum(values: Column) -> Column:
    """Inclusive running sum of an ARRAY<INT> in O(n log n)."""
    return _scan(values, lambda a, b: a + b)


def prefix_max(values: Column) -> Column:
    """Inclusive running maximum of an ARRAY<INT> in O(n log n)."""
    return _scan(values, lambda a, b: F.greatest(a, b))


FEW = 64  # positions x spans up to which each position is tested against each span


def starts_inside(starts: Column, spans: Column) -> Column:
    """ARRAY<BOOLEAN>, one per element of ``starts`` (ascending): does some span
    ``(start, end)`` (end exclusive) hold it?

    A position p is inside a span iff the largest end among spans starting at or before p
    exceeds p, for any set of spans, sorted or not, overlapping or not. Sorting the span starts
    and the positions together and taking a running maximum of ends answers every position in
    O((n + m) log(n + m)), instead of testing each position against each span, which is done where they are few.
    """
    few = F.transform(starts, lambda p: F.exists(spans, lambda s: (s.start <= p) & (s.end > p)))
    events = F.concat(
        F.transform(spans, lambda s: F.struct(s.start.alias("key"), F.lit(0).alias("kind"), s.end.alias("end"))),
        F.transform(starts, lambda p: F.struct(p.alias("key"), F.lit(1).alias("kind"), F.lit(-1).alias("end"))))

    def answer(ev):
        reach = prefix_max(F.transform(ev, lambda e: e.end))
        marked = F.zip_with(ev, reach, lambda e, r: F.struct(e.kind.alias("kind"), (r > e.key).alias("inside")))
        return F.transform(F.filter(marked, lambda x: x.kind == 1), lambda x: x.inside)
    return F.when(F.size(starts) * F.size(spans) <= FEW, few).otherwise(let(F.array_sort(events), answer))


def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """ARRAY<STRUCT<token,start,end>>: every token of ``text`` with its character span."""
    def build(pieces):
        at_token = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        ends = prefix_sum(F.transform(at_token, lambda k: F.length(pieces[k - 1]) + F.length(pieces[k])))
        return F.zip_with(at_token, ends, lambda k, e: F.struct(
            pieces[k].alias("token"), (e - F.length(pieces[k])).alias("start"), e.alias("end")))

    return let(marked(text, pattern), lambda pieces: F.when(F.size(pieces) > 1, build(pieces)).when(
        pieces.isNotNull(), F.array().cast(TOKENS_TYPE)))


def token_texts(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t.token)


def add_special(tokens: Column, first: str = "<s>", last: str = "</s>") -> Column:
    """Sentinel tokens at both ends with (0, 0) offsets."""
    mk = lambda s: F.array(F.struct(F.lit(s).alias("token"), F.lit(0).alias("start"),
                                    F.lit(0).alias("end")))
    return F.concat(mk(first), tokens, mk(last))


def strip_edges(values: Column, k: int = 1) -> Column:
    """Drop ``k`` elements at both ends (never fewer than zero left)."""
    if k == 0:
        return values
    return F.slice(values, k + 1, F.greatest(F.size(values) - 2 * k, F.lit(0)))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """0-based start of every window: start 0, step size-overlap, stop after the first window
    that reaches the end; empty input gives no window."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    count = F.greatest(F.ceil((n - F.lit(overlap)) / F.lit(step)), F.lit(1)).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda w: w * F.lit(step)))


def windows(values: Column, size: int, overlap: int) -> Column:
    """ARRAY of windows (each an array slice) over ``values``."""
    return F.transform(window_starts(F.size(values), size, overlap),
                       lambda s: F.slice(values, s + 1, F.lit(size)))


def truncate_or_pad(values: Column, max_len: int | Column, pad) -> Column:
    """First ``max_len`` elements (a number or a column), or the elements followed by ``pad`` up to ``max_len``."""
    return F.when(F.size(values) >= max_len, F.slice(values, 1, max_len)).otherwise(
        F.concat(values, F.array_repeat(F.lit(pad), F.lit(max_len) - F.size(values))))


def attention_mask(padded_tokens: Column, pad: str = "[PAD]") -> Column:
    return F.transform(padded_tokens, lambda t: (t != F.lit(pad)).cast("int"))
