"""Arrow functions that work on a whole batch of rows at once, where an array expression would take a step for each token.

What a text holds is found by Spark's regexes; they come here as texts with the matches between sentinel characters. The functions
are self-contained: executors need nothing but numpy and pyarrow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "\u0000"


def match_marks(text: Column, pattern: str, mark: str = f"{SENTINEL}$0{SENTINEL}") -> Column:
    """The text with every match, or what ``mark`` says, between two sentinels; null for a text that holds the sentinel itself."""
    return F.when(~text.contains(SENTINEL), F.regexp_replace(text, F.lit(pattern), F.lit(mark)))


def _arrow(fn, n: int, returns: str):
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf
    names = fn.__code__.co_varnames[:n]
    fn.__annotations__ = {**{k: pa.Array for k in names}, "return": pa.Array}  # real types, not strings
    return arrow_udf(fn, returns)


def _reader():
    """Function from marked texts to (row, start, end, string) of every match; offsets in code points of the text without its marks."""
    def read(texts):
        import numpy as np
        import pyarrow as pa
        if len(texts) == 0 or texts.null_count == len(texts):
            none = np.zeros(0, np.int64)
            return none, none, none, pa.array([], pa.string())
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        marks = np.flatnonzero(raw == 0)
        marks = marks[marks >= offsets[0]]
        before = np.searchsorted(marks, offsets)  # sentinels of earlier rows
        counts = np.diff(before) // 2
        row = np.repeat(np.arange(len(texts)), counts)
        # code points before a byte: all bytes but those that go on with a character
        more = np.flatnonzero((raw & 0xC0) == 0x80)
        points = lambda at: at - np.searchsorted(more, at) if len(more) else at
        own = points(marks) - np.arange(len(marks)) - np.repeat((points(offsets) - before)[:-1], 2 * counts)
        start, end = own[::2], own[1::2]
        bounds = np.empty(len(marks), np.int32)
        bounds[::2], bounds[1::2] = marks[::2] + 1, marks[1::2]
        if not len(marks):
            return row, start, end, pa.array([], pa.string())
        cut = pa.StringArray.from_buffers(len(marks) - 1, pa.py_buffer(bounds), data)  # match, gap, match, ..., match
        return row, start, end, cut.take(pa.array(np.arange(0, len(marks) - 1, 2)))
    return read


def _lister():
    """Function from rows (ascending) and their values to a list array of n rows, null where ``mask`` is."""
    def listed(row, values, n, mask=None):
        import numpy as np
        import pyarrow as pa
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)
    return listed


def tokens_of_marks(tokens_type: str):
    """Arrow function over ``match_marks`` of the token pattern: ARRAY<STRUCT<token,start,end>>."""
    read, listed = _reader(), _lister()

    def tokens(texts):
        import numpy as np
        import pyarrow as pa
        row, start, end, found = read(texts)
        values = pa.StructArray.from_arrays([found, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["token", "start", "end"])
        return listed(row, values, len(texts), texts.is_null() if texts.null_count else None)
    return _arrow(tokens, 1, tokens_type)


def spans_of_marks(ranks: Sequence[int], entries: Sequence[str], spans_type: str):
    """Arrow function over marked persons, dates, words in capitals and these lower-cased: spans that do not overlap, in text order.

    ``ranks`` are those of the three kinds. A word counts where ``entries`` has it. From left to right the longest span at each place is taken, then
    the lowest rank; only rows in which spans meet are gone through one span after the other. A null text has no spans.
    """
    read, listed = _reader(), _lister()
    ranks, entries = tuple(ranks), tuple(entries)

    def spans(persons, dates, words, lowered):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        parts = []
        for rank, marked in zip(ranks, (persons, dates, words)):
            row, start, end, _ = read(marked)
            if marked is words:
                known = pc.is_in(read(lowered)[3], value_set=pa.array(entries, pa.string())).to_numpy(zero_copy_only=False).astype(bool)
                row, start, end = row[known], start[known], end[known]
            parts.append((row, start, end, np.full(len(row), rank)))
        row, start, end, rank = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((rank, start - end, start, row))
        row, start, end, rank = row[order], start[order], end[order], rank[order]
        meets = np.flatnonzero((row[1:] == row[:-1]) & (start[1:] < end[:-1]))
        keep = np.ones(len(row), bool)
        for r in np.unique(row[meets]):
            free = -1
            for i in range(np.searchsorted(row, r), np.searchsorted(row, r, "right")):
                if start[i] >= free:
                    free = end[i]
                else:
                    keep[i] = False
        values = pa.StructArray.from_arrays([pa.array(x[keep].astype(np.int32)) for x in (start, end, rank)], names=["start", "end", "rank"])
        return listed(row[keep], values, len(persons))
    return _arrow(spans, 4, spans_type)
