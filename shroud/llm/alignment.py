"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled by their whole text and counted; each distinct one is encoded by a byte-level BPE (A) and by a piece model with
byte fallback (B). Where the bytes of both token sequences are those of a space and the text, the byte offsets at which an A and
a B token both end cut the tokens into groups, and every A and B token that share a byte are a link. A text's links
count as often as the text occurs. The measures go back to the ids by the text's SHA-256.

Encoding gives the libraries' ids by shorter ways. A runs the vocabulary of the ``tokenizers`` file in tiktoken, whose ranks are its
ids (same split pattern, same merges). B has no piece with a space inside or at its end (checked when the model is read; runs of
spaces apart), so a text whose spaces all stand single is encoded word by word, each word once; any other text goes to the library whole.

Links of all texts are summed by pair of ids, in the tasks first. The pairs seen most (at most ``HEAD``) are broadcast;
links of the others, which are rare each, are looked up by a join. Texts that more than one in ``HOT`` of all rows share number fewer than
``HOT``; their measures are broadcast, so no key of the last join has more than that share of the rows.

Edge cases: null and empty texts, and texts whose token bytes differ (U+2581 inside, for one), have no tokens: zeros and ''; repeated rows
count each; a null id is kept; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAD = 1 << 20
HOT = 2048
SLICE = 1 << 20  # characters of text that are aligned at once, or one text
CACHE = 300_000  # words whose ids a Python worker remembers
PENDING = 1 << 19  # links that a task adds up at once


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else the next from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, and the alignment of texts."""

    def __init__(self, first: str, second: str):
        with open(first, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_characters()
        vocabulary = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        self.a = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.vocab_size()
        if self.n_a * self.n_b > 1 << 32:
            raise ValueError("a pair of ids needs more than 32 bits")
        self.bytes_a = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a word after a single space is encoded on its own where no piece goes on from a word into the next space
        self.by_word = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # every id with what follows it: inside its group, at the end of it
        self.written = [b"%d%c" % (i, s) for i in range(self.n_a) for s in b",|"] + [b"%d%c" % (i, s) for i in range(self.n_b) for s in b",;"]
        self.words: dict[str, bytes | None] = {}

    def _checked(self, text: str, ids: list[int]) -> bytes | None:
        """B's ids of a text (4 bytes each); None where their bytes are not those of a space and the text."""
        return np.array(ids, "<u4").tobytes() if b"".join(map(self.bytes_b.__getitem__, ids)) == (" " + text).encode() else None

    def second(self, texts: list[str]) -> list[bytes | None]:
        """B's ids of each text, 4 bytes each; None where their bytes are not those of a space and the text."""
        split = [t.split(" ") if self.by_word and t and "▁" not in t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        if len(self.words) > CACHE:
            self.words.clear()
        new = list(set().union(*(s for s in split if s)).difference(self.words))
        self.words.update((w, self._checked(w, ids)) for w, ids in zip(new, self.b.encode(new, num_threads=1)))
        known = self.words.__getitem__
        out = []
        for text, words in zip(texts, split):
            if words is None:
                out.append(self._checked(text, self.b.encode(text, num_threads=1)))
            else:  # a text's bytes are right where those of its words are
                parts = list(map(known, words))
                out.append(None if None in parts else b"".join(parts))
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids of each text by A and by B; none where the bytes of either differ from a space and the text."""
        a, b = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], self.second(texts)
        for i, t in enumerate(texts):
            # A's tokens are pieces of the bytes, so their length tells whether any is missing
            if b[i] is None or int(self.length_a[a[i]].sum()) != len((" " + t).encode()):
                a[i], b[i] = a[i][:0], b""
        return a, b

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups (written out), codes and times (links by pair of ids) of the texts."""
        ids_a, ids_b = self.encode(texts)
        k = len(texts)
        n_a, n_b = np.fromiter(map(len, ids_a), np.int64, k), np.fromiter(map(len, ids_b), np.int64, k) // 4
        a = np.concatenate([*ids_a, np.zeros(0, np.uint32)]).astype(np.int64)
        b = np.frombuffer(b"".join(ids_b), "<u4").astype(np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        size = int(end_a[-1]) if len(a) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        any_end, both = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        last = np.concatenate([[0], end_a])[np.cumsum(n_a)]  # the end of each text
        place = lambda at: np.searchsorted(last, at, "left")
        # the text of an offset: the first whose end is not before it (texts without tokens end where the one before does)
        n_links = np.bincount(place(any_end), minlength=k) if size else np.zeros(k, np.int64)
        n_groups = np.bincount(place(both), minlength=k) if size else np.zeros(k, np.int64)
        code = a[np.searchsorted(end_a, any_end, "left")] * self.n_b + b[np.searchsorted(end_b, any_end, "left")]
        pair, times = np.unique(place(any_end) << 32 | code, return_counts=True)
        cut = np.searchsorted(pair, np.arange(k + 1) << 32)
        pair, times = (pair & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
        # tokens in the order they are written in: of each group those of A, then those of B
        group_a, group_b = np.searchsorted(both, end_a, "left"), np.searchsorted(both, end_b, "left")
        close_a, close_b = np.append(group_a[1:] != group_a[:-1], True)[:len(a)], np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
        up_to_a, up_to_b = np.cumsum(np.bincount(group_a, minlength=len(both))), np.cumsum(np.bincount(group_b, minlength=len(both)))
        token = np.empty(len(a) + len(b), np.int64)
        token[np.arange(len(a)) + (up_to_b - np.bincount(group_b, minlength=len(both)))[group_a]] = 2 * a + close_a
        token[np.arange(len(b)) + up_to_a[group_b]] = 2 * self.n_a + 2 * b + close_b
        token, at = token.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = [b"".join(map(self.written.__getitem__, token[i:j]))[:-1] for i, j in zip(at, at[1:])]
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
                "codes": [pair[i:j].tobytes() for i, j in zip(cut, cut[1:])], "times": [times[i:j].tobytes() for i, j in zip(cut, cut[1:])]}


@functools.lru_cache(2)
def pair_of(first: str, second: str) -> Pair:
    """One pair of tokenizers for each Python worker."""
    return Pair(public_tokenizers.path(first), public_tokenizers.path(second))


def slices(texts: list[str]):
    """(from, to) of neighbouring texts of about ``SLICE`` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_ALIGNED = "text_sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def aligned_texts(docs: DataFrame, text: str = "text", first: str = FIRST, second: str = SECOND, with_groups: bool = False) -> DataFrame:
    """Each distinct text once: its SHA-256, number of copies, measures and links (``codes``: A id * size of B + B id; ``times``).

    ``with_groups`` adds the text and its groups as they are hashed: ``a1,a2|b1;...``.
    """
    small_batches(docs.sparkSession)
    t = F.col(f"`{text}`")
    texts = docs.where(t.isNotNull() & (t != "")).groupBy(t.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    schema = _ALIGNED + (", text string, groups string" if with_groups else "")

    def align(batches):
        tokenizers = pair_of(first, second)
        for batch in batches:
            every, copies = batch.column("text").to_pylist(), batch.column("copies")
            for i, j in slices(every):
                part = every[i:j]
                x = tokenizers.align(part)
                columns = [pa.array([hashlib.sha256(s.encode()).digest() for s in part], pa.binary()), copies.slice(i, j - i),
                           *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                           pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in x["groups"]]), pa.array(x["codes"], pa.binary()), pa.array(x["times"], pa.binary())]
                if with_groups:
                    columns += [pa.array(part), pa.array([g.decode() for g in x["groups"]])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(align, schema)


def _size_of_second(second: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second)).vocab_size()


def pair_counts(aligned: DataFrame, second: str = SECOND) -> DataFrame:
    """a, b, links, best: how often each pair of ids is linked, copies counted, and whether no A id is linked to b more often.

    The sums are stored; what is added to them is cheap.
    """
    n_b = _size_of_second(second)

    def add(batches):
        codes, counts, pending = [], [], 0

        def total():
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            return code[first], np.add.reduceat(np.concatenate(counts)[order], first)

        def rows(code, sums):
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(sums, pa.int64())], ["code", "links"])

        for batch in batches:
            c, t, n = (batch.column(x).to_pylist() for x in ("codes", "times", "copies"))
            sizes = np.fromiter(map(len, c), np.int64, len(c)) // 4
            if not sizes.sum():
                continue
            codes.append(np.frombuffer(b"".join(c), "<u4").astype(np.int64))
            counts.append(np.frombuffer(b"".join(t), "<u4").astype(np.int64) * np.repeat(np.array(n, np.int64), sizes))
            pending += int(sizes.sum())
            if pending > PENDING:
                code, sums = total()
                codes, counts, pending = [code], [sums], len(code)
                if pending > PENDING // 2:
                    yield rows(code, sums)
                    codes, counts, pending = [], [], 0
        if codes:
            yield rows(*total())

    sums = aligned.select("codes", "times", "copies").mapInArrow(add, "code long, links long").groupBy("code").agg(F.sum("links").alias("links"))
    few = max(1, int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)  # a small table: fewer files than tasks that sum
    sums = stored(sums.select(F.expr(f"code div {n_b}").alias("a"), F.expr(f"code % {n_b}").alias("b"), "links").coalesce(few), "alignment-sums")
    most = sums.groupBy("b").agg(F.max("links").alias("most"))  # a row for each id of B at most
    return sums.join(F.broadcast(most), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


class Head(NamedTuple):
    """The pairs seen most, for the tasks: those of ``2 ** step`` links at least."""

    step: int
    whole: bool  # no other pairs
    n_b: int
    table: Broadcast  # (codes, links, best), by code

    @classmethod
    def of(cls, pairs: DataFrame, second: str = SECOND, most: int = HEAD) -> Head:
        """At most ``most`` of a ``pair_counts`` table, in whole powers of two from the top."""
        n_b, log = _size_of_second(second), F.floor(F.log2("links"))
        steps = pairs.groupBy(log.alias("step")).count().orderBy(F.desc("step")).collect()  # 64 at most
        step, taken = 64, 0
        for x in steps:
            if taken + x["count"] > most:
                break
            step, taken = x["step"], taken + x["count"]
        top = pairs.where(log >= step).select((F.col("a") * n_b + F.col("b")).alias("code"), "links", "best").toArrow().sort_by("code")
        table = pairs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("code", "links", "best")))
        return cls(step, taken == sum(x["count"] for x in steps), n_b, table)


def scored(aligned: DataFrame, pairs: DataFrame, head: Head) -> DataFrame:
    """text_sha, copies, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each distinct text.

    Pairs of the head are looked up in the tasks, the others by a join.
    """
    n_b, table = head.n_b, head.table

    def parts(batch):
        """Text of each entry, code, times, place in the table, found there."""
        c, t = (batch.column(x).to_pylist() for x in ("codes", "times"))
        sizes = np.fromiter(map(len, c), np.int64, len(c)) // 4
        code, times = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (c, t))
        known = table.value[0]
        at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        return np.repeat(np.arange(len(c)), sizes), code, times, at, known[at] == code if len(known) else np.zeros(len(code), bool)

    def score(batches):
        for batch in batches:
            of, _, times, at, found = parts(batch)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of[found], times[found] * table.value[1][at[found]])
            np.add.at(best, of[found], times[found] * table.value[2][at[found]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best), pa.array(total)], [*kept, "n_best", "count_sum"])

    def others(batches):
        for batch in batches:
            of, code, times, _, found = parts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("text_sha").take(pa.array(of[~found])), pa.array(code[~found]), pa.array(times[~found])],
                                             ["text_sha", "code", "times"])

    kept = ["text_sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = aligned.mapInArrow(score, "text_sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if head.whole:
        return out
    rare = pairs.where(F.floor(F.log2("links")) < head.step).select((F.col("a") * n_b + F.col("b")).alias("code"), "links", "best")
    rest = aligned.select("text_sha", "codes", "times").mapInArrow(others, "text_sha binary, code long, times long").join(rare, "code")
    rest = rest.groupBy("text_sha").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                        F.sum(F.col("times") * F.col("links")).alias("more_sum"))
    out = out.join(rest, "text_sha", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, head: int = HEAD) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    aligned = stored(aligned_texts(docs, text, first, second), "alignment-texts")
    pairs = pair_counts(aligned, second)
    top = Head.of(pairs, second, head)
    t = F.col(f"`{text}`")
    rows = docs.where(t.isNotNull() & (t != "")).select(F.col(f"`{key}`").alias(key), F.unhex(F.sha2(t, 256)).alias("text_sha"))
    total = aligned.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * HOT > total  # fewer than HOT texts
    hot, cold = (scored(aligned.where(x), pairs, top) for x in (often, ~often))
    known = F.broadcast(aligned.where(often).select("text_sha"))
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    out = rows.join(F.broadcast(hot), "text_sha").unionByName(rows.join(known, "text_sha", "left_anti").join(cold, "text_sha"))
    without = docs.where(t.isNull() | (t == "")).select(
        F.col(f"`{key}`").alias(key), *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("groups_sha256"))
    return out.select(key, *counts, "groups_sha256").unionByName(without)
