"""Token ids in binary shards with a minimal perfect hash index for access by document key.

``write`` deals the texts out by ranges of the key; each task encodes its own (the tokenizers library, plus an
end id) and writes one shard file in ascending key order::

    ids of all documents, little-endian (2 bytes each if the vocabulary fits, else 4)
    index: for each level of the hash, its bit table; then by slot: fingerprint (4 bytes),
           first id of the document in the shard (8), number of ids (4), rows with this key (4)
    keys in order of the rows (8 bytes each), then 12 numbers (``Footer``)

A key's slot is found through a few bit tables (on average under two): on each level the keys that share a
place with no other are settled there, the rest go on; a slot is the number of settled places before it. So n
keys have the slots 0 .. n - 1, and the index stores fingerprints instead of keys. A fingerprint of 32
bits answers an unknown key wrongly once in four billion times.

The table ``manifest`` (written by Spark, so one attempt of each task counts) names the shard files with their
smallest and largest keys. A task that runs again writes a file of another name; only the files
in the manifest are read. Files are opened through ``pyarrow.fs``, by the URI of the shared folder.

Edge cases: a null text is an empty one (the end id alone); rows with a null key come first, have no entry in the
index and are found by ``documents`` only; rows that share a key are neighbours in order of their texts, and the entry
names the first and their number (a shard that they go on in has an entry for the rest); an empty
table gives no shards and an empty result; keys are integers; other input columns are not read.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _WRITTEN, scratch, small_batches, whole

VOCABULARY = "word_bpe_49k.json"
END = 1
CACHE = 600_000  # pieces whose ids a Python worker remembers
AT_ONCE = 8 << 20  # bytes of text that are encoded together
MAX_FENCES = 1_000_000
MAGIC = 0x53484C4D
_U = np.uint64


# --- encoding ---------------------------------------------------------------------------
class Words:
    """Ids of texts by the tokenizers library, which is asked once for each piece of a word.

    The tokenizer drops white space, and none of its steps (NFC, lower case, split pattern, merges) looks
    across a space or line end, so a text's ids are those of its words between spaces and line ends. A batch's words are split and
    numbered by Arrow. Words of visible ASCII and Latin letters (already in NFC, and lower-cased alike by Arrow) are cut into the
    split pattern's pieces there too; words with an apostrophe or a special token's beginning go to the library whole. Pieces are asked
    for in lines of ``LINE``, which the tokens that end a word (``</w>``) cut again. Ids are gathered by numpy.
    """

    SIMPLE = "^[!-&(-~\u00a1-\u012f\u0131-\u024f]*$"  # U+0130 has two letters in lower case
    PIECE = r"(\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    LINE = 256

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all pieces; the end id stays, as number 0."""
        self.number: dict[str, int] = {}
        self.parts, self.sizes = [np.array([END], self.kind)], [np.ones(1, np.int64)]
        self.count = 1

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(keys, range(self.count, self.count + len(keys))))
        self.parts.append(ids.astype(self.kind))
        self.sizes.append(sizes)
        self.count += len(keys)

    def _ask(self, texts: list[str], keys: list[str]) -> None:
        ids = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(keys, np.concatenate([*ids, np.zeros(0, self.kind)]), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces, several on a line."""
        lines = [pieces[i:i + self.LINE] for i in range(0, len(pieces), self.LINE)]
        for line, e in zip(lines, self.library.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(line) and last[-1] == len(ids):
                self._add(line, ids, np.diff(last, prepend=0))
            else:
                self._ask(line, line)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with an end id."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        return [ids[i:j].tobytes() for i, j in zip(cut, cut[1:])]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with an end id; number of ids of each)."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        distinct, word = coded.dictionary, coded.indices.to_numpy()
        simple = pc.and_(pc.match_substring_regex(distinct, self.SIMPLE), pc.invert(pc.match_substring(distinct, "<|")))
        pieces = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(distinct.filter(simple)), self.PIECE, r"\1 "), " ")
        n_pieces = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) - 1  # an empty one follows the last
        found = pieces.flatten().dictionary_encode()
        names, at = found.dictionary.to_pylist(), found.indices.to_numpy()
        others = distinct.filter(pc.invert(simple)).to_pylist()
        if self.count > CACHE:
            self.clear()
        self._learn([x for x in names if x and x not in self.number])
        whole = ["\n" + x for x in others]  # no piece begins like this
        new = [i for i, x in enumerate(whole) if x not in self.number]
        self._ask([others[i] for i in new], [whole[i] for i in new])
        pool, sizes = np.concatenate(self.parts), np.concatenate(self.sizes)
        self.parts, self.sizes = [pool], [sizes]
        first = np.cumsum(sizes) - sizes
        # the pieces of the simple words, then the other words, then the end, each with its place in the pool
        number = np.array([self.number[x] if x else -1 for x in names], np.int64)[at] if len(at) else np.zeros(0, np.int64)
        number = np.concatenate([number[number >= 0], np.array([self.number[x] for x in whole], np.int64), [0]])
        ids = pool[_spread(first[number], sizes[number])]
        # the ids of each distinct word, the end last
        n_parts = np.ones(len(distinct) + 1, np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(is_simple), np.flatnonzero(~is_simple), [len(distinct)]])
        n_parts[:len(n_pieces)] = n_pieces  # in that order
        upto = np.concatenate([[0], np.cumsum(sizes[number])])
        close = np.cumsum(n_parts)
        start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        start[order], size[order] = upto[close - n_parts], upto[close] - upto[close - n_parts]
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.insert(word.astype(np.int64), np.cumsum(n_words), len(distinct))
        total = np.concatenate([[0], np.cumsum(size[word])])
        return ids[_spread(start[word], size[word])], np.diff(total[np.concatenate([[0], np.cumsum(n_words + 1)])])


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (size[0] of them), first[1], .."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


@functools.lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


# --- minimal perfect hash -------------------------------------------------------------------
def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1000) >> _U(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 .. n - 1 of n distinct integer keys, from a few bit tables."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables  # of booleans
        sizes = np.cumsum([0, *(int(t.sum()) for t in tables)])
        self.before = [int(s) + np.cumsum(t) - t for s, t in zip(sizes, tables)]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        tables, level = [], 0
        while len(keys):
            at = _hash(keys, level) % _U(2 * len(keys))
            alone = np.bincount(at.astype(np.int64), minlength=2 * len(keys)) == 1
            tables.append(alone)
            keys, level = keys[~alone[at.astype(np.int64)]], level + 1
        return cls(tables)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for a key that was not among those given."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (table, before) in enumerate(zip(self.tables, self.before)):
            at = (_hash(keys[left], level) % _U(len(table))).astype(np.int64)
            hit = table[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


# --- shard files ------------------------------------------------------------------------
class Footer(NamedTuple):
    width: int
    n_ids: int
    n_rows: int
    n_null: int
    n_keys: int
    levels: int
    tables_at: int
    slots_at: int
    keys_at: int
    least: int
    most: int
    magic: int


_SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u8"), ("n", "<u4"), ("rows", "<u4")])


def _open(uri: str):
    from pyarrow import fs
    where, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
    return where, path


def _write_shard(folder: str, batches, width: int) -> tuple | None:
    """Write one shard from batches of (known, keys, ids, number of ids of each); (file, rows, ids, rows without key, smallest, largest key), None without rows."""
    batches = iter(batches)
    batch = next(batches, None)
    if batch is None:
        return None
    where, top = _open(folder)
    name = f"shard-{uuid.uuid4().hex}.bin"
    where.create_dir(top, recursive=True)
    keys, lengths, null = [], [], 0
    with where.open_output_stream(f"{top}/{name}") as out:
        for known, key, ids, n in chain([batch], batches):
            null += int((~known).sum())
            keys.append(key)
            lengths.append(n)
            out.write(ids.tobytes())
        own, n = np.concatenate(keys)[null:], np.concatenate(lengths)
        first = np.cumsum(n) - n
        distinct, at, rows = np.unique(own, return_index=True, return_counts=True)
        index = PerfectHash.of(distinct)
        slot = index.slots(distinct)
        table = np.zeros(len(distinct), _SLOT)
        table["fingerprint"][slot], table["rows"][slot] = fingerprint(distinct), rows
        table["first"][slot], table["n"][slot] = first[null:][at], n[null:][at]
        place = int(n.sum()) * width
        tables = b"".join(np.uint64(len(t)).tobytes() + np.packbits(t).tobytes() for t in index.tables)
        out.write(tables)
        out.write(table.tobytes())
        out.write(own.astype("<i8").tobytes())
        out.write(n.astype("<u4").tobytes())
        least, most = (int(own[0]), int(own[-1])) if len(own) else (0, 0)
        foot = Footer(width, int(n.sum()), len(n), null, len(distinct), len(index.tables), place, place + len(tables),
                      place + len(tables) + table.nbytes, least, most, MAGIC)
        out.write(np.array(foot, "<i8").tobytes())
    return name, len(n), int(n.sum()), null, foot.least if len(own) else None, foot.most if len(own) else None


class Shard:
    """A shard file's ids and index."""

    def __init__(self, uri: str):
        where, path = _open(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        self.foot = f = Footer(*np.frombuffer(self._read(size - 8 * len(Footer._fields), 8 * len(Footer._fields)), "<i8").tolist())
        if f.magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        raw, at, tables = self._read(f.tables_at, f.slots_at - f.tables_at), 0, []
        for _ in range(f.levels):
            n = int(np.frombuffer(raw, np.uint64, 1, at)[0])
            tables.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8))[:n].astype(bool))
            at += 8 + (n + 7) // 8
        self.index = PerfectHash(tables)
        self.table = np.frombuffer(self._read(f.slots_at, f.n_keys * _SLOT.itemsize), _SLOT)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n else b""

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the rows with a key, number of ids of every row), in order."""
        f = self.foot
        n = f.n_rows - f.n_null
        return (np.frombuffer(self._read(f.keys_at, 8 * n), "<i8"),
                np.frombuffer(self._read(f.keys_at + 8 * n, 4 * f.n_rows), "<u4").astype(np.int64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index entry of each key (fingerprint, first, n, rows); ``rows`` is 0 where the key is unknown."""
        slot = self.index.slots(keys)
        out = self.table[slot].copy() if len(self.table) else np.zeros(len(keys), _SLOT)
        out[(slot < 0) | (out["fingerprint"] != fingerprint(keys))] = 0
        return out

    def ids(self, first: int, n: int) -> np.ndarray:
        w = self.foot.width
        return np.frombuffer(self._read(first * w, n * w), f"<u{w}")


# --- Spark ------------------------------------------------------------------------------
_MANIFEST = "shard int, file string, n_rows long, n_ids long, n_null long, least long, most long"


def _together(batches):
    """(known, key, text) of neighbouring batches that have about ``AT_ONCE`` bytes of text together."""
    held, size = [], 0

    def joined():
        known, key = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("known", "key"))
        return known, key, pa.concat_arrays([b.column("text") for b in held])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column("text").nbytes
            if size > AT_ONCE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
          shards: int | None = None) -> None:
    """Encode the texts and write shards and manifest to ``folder``, which all executors must reach.

    Without ``shards`` Spark sizes them (spark.sql.adaptive.advisoryPartitionSizeInBytes).
    """
    small_batches(docs.sparkSession)
    t = whole(F.col(f"`{text}`"))
    own = F.col(f"`{key}`").cast("long")
    # the texts are dealt, not their ids: Spark samples what it deals by range, and would encode twice
    rows = docs.select(own.isNotNull().alias("known"), F.coalesce(own, F.lit(0)).alias("key"), F.xxhash64(t).alias("tie"), t.alias("text"))
    order = ["known", "key", "tie"]
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)

    def shard(batches):
        coder = words(public_tokenizers.path(vocabulary))

        def encoded():
            for known, key, text_ in _together(batches):
                yield known, key, *coder.encode_all(text_)

        row = _write_shard(folder, encoded(), int(coder.kind[2:]))
        if row:
            values = (TaskContext.get().partitionId(), *row)
            types = (pa.int32(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in _MANIFEST.split(", ")])

    dealt.sortWithinPartitions(*order).drop("tie").mapInArrow(shard, _MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``, the number of ids before each; one row for each shard."""
    m = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    order = Window.orderBy("shard")
    return m.withColumn("start", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def documents(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files alone.

    Every key is looked up in its shard's index, and its ids are read at the place that the index
    names; rows that share a key follow the first.
    """
    def read(batches):
        for batch in batches:
            for row in batch.itertuples():
                s = Shard(f"{folder}/{row.file}")
                keys, n = s.rows()
                entry = s.find(keys)
                first = np.cumsum(n) - n
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                own = first[s.foot.n_null:].copy()
                own[new], length = entry["first"][new].astype(np.int64), n[s.foot.n_null:].copy()
                length[new] = entry["n"][new]
                if (entry["rows"] == 0).any():
                    raise ValueError(f"{row.file}: a key is not in the index")
                own, length = np.concatenate([first[:s.foot.n_null], own]), np.concatenate([n[:s.foot.n_null], length])
                crc = [zlib.crc32(s.ids(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(own, length)]
                out = pd.DataFrame({"start": own + row.start, "n_tokens": length, "ids_crc32": np.array(crc, np.int64)})
                out.insert(0, key, pd.array([None] * s.foot.n_null + keys.tolist(), "Int64"))
                yield out

    shards = manifest(spark, folder)
    n = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    return shards.select("file", "start").repartition(n, "file").mapInPandas(
        read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """key, ids (ARRAY<INT>) of the first document with each of the keys; null where there is none.

    Keys find their shard by its smallest key (at most ``MAX_FENCES`` shards, 8 bytes each, go to the
    tasks), and their place in it through the index.
    """
    spark = keys.sparkSession
    rows = manifest(spark, folder).where("least is not null").orderBy("start").select("file", "least", "most").limit(MAX_FENCES + 1).collect()
    if len(rows) > MAX_FENCES:
        raise ValueError("write fewer, larger shards")
    files, most = [r.file for r in rows], np.array([r.most for r in rows], np.int64)

    def find(batches):
        for batch in batches:
            k, known = batch["k"].to_numpy(np.int64), batch["known"].to_numpy(bool)
            out = [None] * len(k)
            place = np.searchsorted(most, k)  # the first shard that can hold the key
            for shard in np.unique(place):
                at = np.flatnonzero((place == shard) & known)
                if shard < len(files) and len(at):
                    s = Shard(f"{folder}/{files[shard]}")
                    for i, e in zip(at, s.find(k[at])):
                        if e["rows"]:
                            out[i] = s.ids(int(e["first"]), int(e["n"])).astype(np.int32)
            yield pd.DataFrame({key: pd.array([x if y else None for x, y in zip(k.tolist(), known)], "Int64"), "ids": pd.Series(out, dtype=object)})

    own = F.col(f"`{key}`").cast("long")
    return keys.select(own.isNotNull().alias("known"), F.coalesce(own, F.lit(0)).alias("k")).repartitionByRange("k").sortWithinPartitions("k").mapInPandas(find, f"`{key}` long, ids array<int>")


def stored_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts' ids to the shared folder and read every document back."""
    folder = scratch(docs.sparkSession, "token-store")
    _WRITTEN.append(folder)
    write(docs, folder, key, text)
    return documents(docs.sparkSession, folder, key)
