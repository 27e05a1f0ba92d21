"""Token classification: the native rule tagger (CLS4, default detector), argmax decoding of
scores (CLS2), attaching window predictions (CLS3) and the plug point for a user's own batch
scorer (CLS1).

The rule tagger finds spans on the raw text (``functions/textspans.py``), so no rule runs at each token:

* PERSON: the whole run of capitalised words on one line after a cue (``Name:``, ``Dr.``, ``Mr.``,
  ``Mrs.``, ``Ms.``, ``Prof.``; the dot may be left out). Words may be in capitals, have inner capitals, be joined
  by a hyphen or an apostrophe (``Smith-Jones``, ``O'Neill``), or be initials (``J. Berg``).
* DATE: the layouts that ``dates.parse_date`` reads, with a time of day where one follows.
* LOCATION: the longest run of tokens, the first one capitalised, whose lower-cased text
  is a gazetteer entry (the gazetteer is a table; see ``RuleTagger``).

Spans are taken from left to right, the longest first at each place (PERSON before DATE before
LOCATION if they are equally long), and never overlap. ``tag`` writes them onto tokens: the first token of a span
is ``B-``, the rest ``I-``; ``mentions`` needs no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import labels_by_id
from ..functions.arrays import TOKEN_PATTERN, at, let, tokenize
from ..functions.textspans import (CAPITAL_PATTERN, HONORIFICS, KINDS, MONTHS, SPANS_TYPE, as_spans, bio_labels, date_spans,
                                   found_spans, left_to_right, located, mentions_of, person_spans)
from .broadcast import fits

__all__ = ["HONORIFICS", "MONTHS", "RuleTagger", "argmax_ids", "argmax_labels", "attach_predictions", "batch_scorer"]

UPPER_FIRST = r"^\p{Lu}"


def rule_spans(text: Column) -> Column:
    """ARRAY of PERSON and DATE spans, which may overlap."""
    return F.concat(person_spans(text), date_spans(text))


def _pieces(tokens: Column) -> Column:
    """Lower-cased token texts, with a blank before each that stands apart from the one before."""
    return F.transform(tokens, lambda t, i: F.concat(
        F.when((i > 0) & (t.start > at(tokens, i - 1).end), F.lit(" ")).otherwise(F.lit("")), F.lower(t.token)))


class Trie:
    """A gazetteer of limited size as sets of strings: entries, and the prefixes (by tokens) that longer entries go on from."""

    def __init__(self, entries: list[str]):
        self.entries, self.first, self.prefixes, self.most = sorted(entries), set(), set(), 1
        for entry in entries:
            ends = [m.end() for m in re.finditer(r"\w+|[^\w\s]", entry)]
            if len(ends) > 1:
                self.first.add(entry[:ends[0]])
                self.prefixes.update(entry[:e] for e in ends[:-1])
                self.most = max(self.most, len(ends))

    def spans(self, text: Column) -> Column:
        """ARRAY of LOCATION spans, the longest entry at each capitalised token. Rows without the first word of a longer entry are not tokenized."""
        found = located(text, CAPITAL_PATTERN)
        alone = lambda c: as_spans(F.filter(c, lambda m: F.lower(m.found).isin(*self.entries)), "LOCATION")
        if self.most == 1:
            return alone(found)
        first, prefixes = sorted(self.first), sorted(self.prefixes)

        def extend(m, tokens, starts, pieces):
            """End of the longest entry that begins at m: tokens are added as long as the text so far is a prefix."""
            def from_token(i):
                begin = F.struct(F.lower(m.found).alias("text"), F.when(F.lower(m.found).isin(*self.entries), m.end).otherwise(-1).alias("end"),
                                 F.lit(True).alias("goes_on"))

                def step(acc, j):
                    return F.when(acc.goes_on & (i + j < F.size(tokens)), let(F.concat(acc.text, at(pieces, i + j)), lambda t: F.struct(
                        t.alias("text"), F.when(t.isin(*self.entries), at(tokens, i + j).end).otherwise(acc.end).alias("end"),
                        t.isin(*prefixes).alias("goes_on")))).otherwise(
                            F.struct(acc.text.alias("text"), acc.end.alias("end"), F.lit(False).alias("goes_on")))
                return F.aggregate(F.sequence(F.lit(1), F.lit(self.most - 1)), begin, step, lambda acc: acc.end)
            return let((F.array_position(starts, m.start) - 1).cast("int"), from_token)

        def longer(c):
            return let(tokenize(text), lambda tokens: let(F.transform(tokens, lambda t: t.start), lambda starts: let(_pieces(tokens), lambda pieces: F.filter(
                F.transform(c, lambda m: F.struct(m.start.alias("start"), F.when(F.lower(m.found).isin(*first), extend(m, tokens, starts, pieces)).when(
                    F.lower(m.found).isin(*self.entries), m.end).otherwise(-1).alias("end"), F.lit(KINDS.index("LOCATION")).alias("rank"))),
                lambda s: s.end > 0)))).cast(SPANS_TYPE)
        return let(found, lambda c: F.when(F.exists(c, lambda m: F.lower(m.found).isin(*first)), longer(c)).otherwise(alone(c)))


class RuleTagger:
    """Detector: ``tag(df)`` adds ``labels`` for ``tokens`` of ``text``; ``mentions(df)`` adds mentions without tokens.

    The gazetteer (a one-column table of lower-case entries) is inlined as a ``Trie`` of hash-set literals
    when its checked size is at most ``inline_limit`` entries: then tagging is one row-local
    expression. A larger gazetteer is matched by a join instead: runs of tokens that begin with a capitalised one and are as long as
    some entry are exploded, joined to the gazetteer (broadcast only below ``broadcast_limit`` checked rows,
    otherwise a shuffle join with AQE skew splitting), regrouped by text and joined back. The key is the
    text's digest, so rows that share an id, or have none, are matched like any other, and both ways give the same spans.
    """

    def __init__(self, gazetteer: DataFrame | None = None, entry_col: str = "entry", inline_limit: int = 50_000,
                 broadcast_limit: int = 2_000_000):
        self.gazetteer = gazetteer
        self.entry_col = entry_col
        self.inline_limit = inline_limit
        self.broadcast_limit = broadcast_limit
        self._trie: Trie | None = None
        self._inline: bool | None = None
        self._lengths: list[int] = []

    def _entries_df(self) -> DataFrame:
        return (self.gazetteer.select(F.col(self.entry_col).alias("entry")).where(F.col("entry").isNotNull())
                .distinct())

    def _load(self):
        if self.gazetteer is None or self._inline is not None:
            return
        g = self._entries_df()
        self._inline = fits(g, self.inline_limit)
        if self._inline:
            self._trie = Trie([r.entry for r in g.collect()])
        else:  # the numbers of tokens that entries have, a few
            n = F.size(F.regexp_extract_all("entry", F.lit(TOKEN_PATTERN), F.lit(0)))
            self._lengths = sorted(r.n for r in g.select(n.alias("n")).distinct().collect() if r.n)

    def find(self, df: DataFrame, text: str = "text", out: str = "_spans") -> DataFrame:
        """``df`` with the spans of each row, which do not overlap, in text order."""
        self._load()
        if self.gazetteer is not None and not self._inline:
            return self._find_with_join(df, text, out)
        key = (id(df.sparkSession), text, tuple(self._trie.entries) if self._trie else ())
        if key not in _BUILT:  # building the expression takes a call for each entry; it is reusable
            if len(_BUILT) >= 16:
                _BUILT.clear()
            t = F.col(text)
            entries = self._trie.entries if self._trie else []
            row_wise = let(F.concat(rule_spans(t), self._trie.spans(t)) if entries else rule_spans(t), left_to_right)
            if not entries or self._trie.most == 1:  # else, and for texts that hold the sentinel, each row by itself
                row_wise = F.coalesce(found_spans(t, entries), row_wise)
            _BUILT[key] = F.when(t.isNull(), F.array().cast(SPANS_TYPE)).otherwise(row_wise)
        return df.withColumn(out, _BUILT[key])

    def tag(self, df: DataFrame, text: str = "text", tokens: str = "tokens", out: str = "labels") -> DataFrame:
        found = self.find(df, text, "_spans")
        return found.withColumn(out, let(F.col("_spans"), lambda s: bio_labels(F.col(tokens), s))).drop("_spans")

    def mentions(self, df: DataFrame, kinds: tuple, text: str = "text", out: str = "mentions") -> DataFrame:
        """``df`` with the mentions of ``kinds``; a row without text has none."""
        found = self.find(df, text, "_spans")
        return found.withColumn(out, mentions_of(F.col(text), F.col("_spans"), kinds)).drop("_spans")

    def _find_with_join(self, df: DataFrame, text: str, out: str) -> DataFrame:
        from .broadcast import join_small
        lengths = F.array(*[F.lit(n) for n in self._lengths])

        def candidates(tokens, pieces):
            def runs(t, i):
                fit = F.filter(lengths, lambda n: (i + n <= F.size(tokens)))
                return F.when(t.token.rlike(UPPER_FIRST), F.transform(fit, lambda n: F.struct(
                    t.start.alias("start"), at(tokens, i + n - 1).end.alias("end"), F.ltrim(F.array_join(F.slice(pieces, i + 1, n), "")).alias("entry"))))
            return F.flatten(F.filter(F.transform(tokens, runs), lambda r: r.isNotNull()))

        own = df.withColumn("_text", F.md5(text))
        runs = let(tokenize(F.col(text)), lambda tokens: let(_pieces(tokens), lambda pieces: candidates(tokens, pieces)))
        cands = own.where(F.col(text).isNotNull()).select("_text", F.explode(runs).alias("c")).select("_text", "c.start", "c.end", "c.entry")
        hits = (join_small(cands, self._entries_df(), "entry", "inner", max_rows=self.broadcast_limit)
                .groupBy("_text", "start").agg(F.max("end").alias("end"))
                .groupBy(F.col("_text").alias("_hit")).agg(F.collect_list(F.struct(
                    "start", "end", F.lit(KINDS.index("LOCATION")).alias("rank"))).alias("_hits")))
        joined = own.join(hits, F.col("_text") == F.col("_hit"), "left")
        t, empty = F.col(text), F.array().cast(SPANS_TYPE)
        spans = F.concat(rule_spans(t), F.coalesce(F.col("_hits").cast(SPANS_TYPE), empty))
        return joined.withColumn(out, F.when(t.isNull(), empty).otherwise(let(spans, left_to_right))).drop("_text", "_hit", "_hits")


_BUILT: dict = {}  # built tagger expressions of a session, reused across DataFrames


# ----------------------------------------------------------------------- scores and scorers

def argmax_ids(scores: Column, mask: Column | None = None) -> Column:
    """ARRAY<ARRAY<FLOAT>> (one score vector per token) -> label ids; ties go to the lowest id, and
    slots whose ``mask`` is not 1 give NULL (CLS2)."""
    best = lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int")
    if mask is None:
        return F.transform(scores, best)
    return F.zip_with(scores, mask, lambda s, m: F.when(m == 1, best(s)))


def argmax_labels(scores: Column, mask: Column | None = None) -> Column:
    """``argmax_ids`` as label strings."""
    names = labels_by_id()
    return F.transform(argmax_ids(scores, mask), lambda i: F.when(i.isNotNull(), F.element_at(names, i + 1)))


def attach_predictions(windows_df: DataFrame, predictions: DataFrame, keys=("doc_id", "window_no")) -> DataFrame:
    """Predictions of a scorer joined back to their windows by key (CLS3)."""
    return windows_df.join(predictions, list(keys), "inner")


def batch_scorer(predict_fn: Callable, batch_size: int = 8, return_type: str = "array<string>"):
    """Wrap a user's batch classifier as an Arrow-batched column function (CLS1).

    ``predict_fn(list_of_token_lists) -> list_of_label_lists`` is called on batches of at most
    ``batch_size`` samples inside the executors. The model itself is the user's.
    """
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def score(tokens):
        out = []
        vals = [list(t) for t in tokens]
        for s in range(0, len(vals), batch_size):
            out.extend(predict_fn(vals[s:s + batch_size]))
        return pd.Series(out)
    score.__annotations__ = {"tokens": pd.Series, "return": pd.Series}  # real types, not strings
    return pandas_udf(score, return_type)
