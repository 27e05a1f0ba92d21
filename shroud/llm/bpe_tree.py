"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves of at most ``LEAF`` characters; leaves are encoded by the tiktoken
library, and neighbours are joined on the way up. ``join`` re-encodes a window around the seam, 4
tokens wide at first and doubled until the tokens outside provably stay as they are. An outer edge
of the window is settled when it is

* the end of the text;
* a place where the split pattern always cuts: white space after another character, or two
  characters of different classes (letter, number, other), unless the first is an apostrophe (it can
  open a contraction). What stands left of such a place cannot change the pieces right of it, and the
  reverse; or
* inside a run of one class (three or more of its characters before the edge, so it is no
  contraction), where the tokens on both sides of the edge form a stable pair: encoding their joined
  bytes gives the same two tokens. A sequence of tokens is the encoding of its bytes exactly if each
  pair of neighbours is stable, so the whole run is settled.

So a run of 100,000 letters without a space costs windows of a few tokens, not a new encoding. Ids
of a whole text are equal to the library's. Decoding joins the bytes of the ids' halves up the tree.

Edge cases: a null text encodes as an empty one (no ids); each row stands alone, so repeated rows,
ties and extra columns have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 512
WINDOW = 4


class Codec:
    """Encoder and decoder for a tiktoken rank file and ``public_tokenizers.PATTERN``."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = leaf
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.stable = functools.lru_cache(1 << 16)(self._stable)

    def _stable(self, a: int, b: int) -> bool:
        return self.plain._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    # --- encoding -----------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.plain.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        if not left or not right:
            return a + b
        width = WINDOW
        while True:
            i, p = self._edge(left, a, width)
            j, q = self._edge(right, b, width, front=True)
            middle = self.plain.encode_ordinary(left[p:] + right[:q])
            if (p == 0 or self._cut(left, p) or self._inside(left, p, middle[0], a[i - 1])) and (
                    q == len(right) or self._cut(right, q) or self._inside(right, q, b[j], middle[-1])):
                return a[:i] + middle + b[j:]
            width *= 2

    def _edge(self, text: str, ids: list[int], width: int, front: bool = False) -> tuple[int, int]:
        """(number of ids, number of characters) before an edge that is about ``width`` ids from the seam.

        The edge moves away from the seam until it lies between two characters; cuts are preferred.
        """
        n = len(ids)
        if width >= n:
            return (n, len(text)) if front else (0, 0)
        size = 0  # bytes between the edge and the seam
        for tok in (ids[:width] if front else ids[n - width:]):
            size += len(self.bytes_of[tok])
        k = width
        best = None
        while True:
            done = k >= n
            at = self._chars(text, size, front) if not done else (len(text) if front else 0)
            if done:
                return best or ((n, at) if front else (0, at))
            if at is not None:
                here = (k, at) if front else (n - k, at)
                if self._cut(text, at):
                    return here
                best = best or here
            if k >= width + WINDOW and best:
                return best
            size += len(self.bytes_of[ids[k] if front else ids[n - 1 - k]])
            k += 1

    @staticmethod
    def _chars(text: str, size: int, front: bool) -> int | None:
        """Characters before the edge that is ``size`` bytes from the seam; None inside a character."""
        if text.isascii():
            return size if front else len(text) - size
        part = text[:size] if front else text[max(0, len(text) - size):]
        raw = part.encode("utf-8")
        raw = raw[:size] if front else raw[len(raw) - size:]
        try:
            n = len(raw.decode("utf-8"))
        except UnicodeDecodeError:
            return None
        return n if front else len(text) - n

    @staticmethod
    @functools.lru_cache(1 << 16)
    def _kind(c: str) -> str:
        """s: white space; l, n, o: letter, number, other; ?: where Unicode versions may differ."""
        if c.isspace():
            return "?" if c in "\x1c\x1d\x1e\x1f" else "s"
        x = ord(c)
        if x < 0x500 or 0x3041 <= x <= 0x30FA or 0x4E00 <= x <= 0x9FA5 or 0xAC00 <= x <= 0xD7A3:
            return {"L": "l", "N": "n"}.get(unicodedata.category(c)[0], "o")
        return "?"

    def _cut(self, text: str, p: int) -> bool:
        """The pattern cuts before character ``p``, whatever stands further left or right."""
        before, after = self._kind(text[p - 1]), self._kind(text[p])
        if before == "s" or text[p - 1] in "\x1c\x1d\x1e\x1f":
            return False
        return after == "s" or "?" not in (before, after) and before != after and text[p - 1] != "'"

    def _inside(self, text: str, p: int, after: int, before: int) -> bool:
        """Character ``p`` is inside a run of letters, numbers or others, and the ids around it are a stable pair."""
        if p < 3 or p >= len(text):
            return False
        kind = self._kind(text[p])
        return kind in "lno" and "'" not in text[p - 3:p + 1] and all(self._kind(c) == kind for c in text[p - 3:p]) \
            and self.stable(before, after)

    # --- decoding -----------------------------------------------------------------------
    def decode(self, ids) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    """One codec for each Python worker and vocabulary file."""
    return Codec(path)


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers (binary)."""
    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(public_tokenizers.path(vocabulary))
        return pd.Series([np.array(c.encode(t or ""), "<u4").tobytes() for t in texts], dtype=object)
    return ids(text)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Bytes of binary ids; the bytes of an encoded text are its UTF-8."""
    @F.pandas_udf("binary")
    def raw(column: pd.Series) -> pd.Series:
        c = codec(public_tokenizers.path(vocabulary))
        return pd.Series([c.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in column], dtype=object)
    return raw(ids)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids, decoded of every row."""
    small_batches(docs.sparkSession)
    coded = docs.select(F.col(f"`{key}`").alias(key), encode(F.col(f"`{text}`"), vocabulary).alias("ids"))
    return coded.withColumn("decoded", decode(F.col("ids"), vocabulary))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row, all from ``round_trip``; ``with_ids`` adds the ids (binary)."""
    return round_trip(docs, key, text, vocabulary).select(
        key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *["ids"] * with_ids)
