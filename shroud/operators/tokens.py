"""Token tables: tokens with offsets (TOK1-2), windows (WIN1-2), model samples (PREP1-7),
vocabulary building and token / label encoding.

Per-document steps stay inside the row (array expressions). Only vocabulary building and
token-id lookup need a shuffle; both are keyed so hot tokens cannot pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_BATCH_SIZE, LABEL2ID, MAX_LEN, WINDOW_OVERLAP, WINDOW_SIZE, label_map
from ..functions.arrays import TOKEN_PATTERN, TOKENS_TYPE, attention_mask, exploded, tokenize, truncate_or_pad, windows
from ..functions.batches import SENTINEL, match_marks, tokens_of_marks
from ..functions.hashing import hash32, hash_key

PAD, UNK = "[PAD]", "[UNK]"
PAD_ID, UNK_ID = 0, 1
SPECIAL_TOKENS = (PAD, UNK)
PREFIX = 6  # characters of a token that its rank is split by


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", python: bool = True) -> DataFrame:
    """Adds ``tokens ARRAY<STRUCT<token,start,end>>`` (row-local, no shuffle).

    Without ``python`` Spark's own functions make them. That takes more time, but Spark forgets how rows are dealt out where they pass
    through Python: windows that are gathered by the key their documents lie dealt out by then need not be shuffled.
    """
    t = F.col(text)
    if not python:
        return df.withColumn(out, tokenize(t))
    # a text that holds the sentinel is cut by itself; arrays are not sent to Python, where each costs more than its text
    return df.withColumn(out, F.coalesce(tokens_of_marks(TOKENS_TYPE)(match_marks(t, TOKEN_PATTERN)), F.when(t.contains(SENTINEL), tokenize(t))))


def token_rows(df: DataFrame, key: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """Long form ``(key, pos, token, start, end)``: the tokens of ``with_tokens``, one row each; ``(key, pos, token)`` without ``offsets``, which costs no Python."""
    if not offsets:
        return exploded(df, [key], F.regexp_extract_all(F.col(text), F.lit(TOKEN_PATTERN), F.lit(0)), "token", "pos")
    return (with_tokens(df.select(key, F.col(text).alias("_text")), "_text", "_tokens")
            .transform(exploded, [key], F.col("_tokens"), "t", "pos").select(key, "pos", "t.token", "t.start", "t.end"))


def to_windows(df: DataFrame, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP, key: str = "doc_id",
               tokens: str = "tokens", keep: tuple = ()) -> DataFrame:
    """One row per window: ``(key, window_no, tokens)``; each row holds at most ``size`` tokens,
    so a long document becomes many bounded rows. ``first_pos`` is the window's offset in the
    document's token list."""
    step = size - overlap
    return (exploded(df, [key, *keep], windows(F.col(tokens), size, overlap), tokens, "window_no")
            .withColumn("first_pos", F.col("window_no") * F.lit(step)))


def prepare_samples(df: DataFrame, max_len: int | Column = MAX_LEN, tokens: str = "tokens", tags: str | None = None,
                    vocab: DataFrame | None = None, key_cols: tuple = ("doc_id", "window_no"),
                    vocab_head_rows: int = 1_000_000) -> DataFrame:
    """Model samples: tokens truncated / padded to ``max_len``, attention mask, token ids (when a
    vocabulary is given) and label ids (when ``tags`` is given, training mode)."""
    words = F.transform(F.col(tokens), lambda t: t.token) if _is_struct_tokens(df, tokens) else F.col(tokens)
    padded = [truncate_or_pad(words, max_len, PAD).alias("padded"), *([truncate_or_pad(F.col(tags), max_len, "O").alias("padded_tags")] if tags else [])]
    if vocab is not None:
        out = encode_tokens(df.select(*key_cols, *padded), vocab, "padded", key_cols, "ids", vocab_head_rows,
                            carry=("padded_tags",) if tags else ())
        out = out.withColumn("mask", attention_mask(F.col("padded"), PAD))
        return out.withColumn("targets", encode_labels(F.col("padded_tags"))) if tags else out
    # a window's own elements are masked and encoded, then padded: most slots may be padding
    targets = [truncate_or_pad(encode_labels(F.slice(F.col(tags), 1, max_len)), max_len, LABEL2ID["O"]).alias("targets")] if tags else []
    return df.select(*key_cols, *padded, truncate_or_pad(attention_mask(words, PAD), max_len, 0).alias("mask"), *targets)


def _is_struct_tokens(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString().startswith("array<struct")


def encode_labels(tags, strict: bool = True):
    """Label strings -> ids; an unknown label fails the job when ``strict`` (PREP5)."""
    m = label_map()

    def one(lbl):
        v = F.element_at(m, lbl) if not strict else F.coalesce(
            F.try_element_at(m, lbl), F.raise_error(F.concat(F.lit("unknown label: "), lbl)).cast("int"))
        return v
    return F.transform(tags, one)


def build_vocabulary(tokens_long: DataFrame, token: str = "token", min_count: int = 1) -> DataFrame:
    """``(token, id, count)``: ids by descending count then token, after the reserved ids.

    Counting is a map-side-combined aggregation (hot tokens are pre-summed per task). An id is the
    number of tokens with a larger count, plus those of the same count with a smaller prefix, plus the rank among
    those of the same count and prefix. The first two are running sums over small tables (one
    row per distinct count, one per count and prefix), and a rank is taken within one prefix, so no task sees
    the whole vocabulary, and ids depend on the data alone, not on how Spark partitions it.
    """
    counts = (tokens_long.groupBy(token).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
              .withColumn("_pre", F.substring(F.col(token), 1, PREFIX)))
    sizes = counts.groupBy("count", "_pre").agg(F.count(F.lit(1)).alias("_n"))
    above = sizes.groupBy("count").agg(F.sum("_n").alias("_all")) \
        .withColumn("_above", F.sum("_all").over(Window.orderBy(F.col("count").desc())) - F.col("_all"))
    before = F.sum("_n").over(Window.partitionBy("count").orderBy("_pre")) - F.col("_n")
    offsets = sizes.withColumn("_before", before).join(above.select("count", "_above"), "count") \
        .select("count", "_pre", (F.col("_above") + F.col("_before")).alias("_offset"))
    within = Window.partitionBy("count", "_pre").orderBy(F.col(token).asc())
    return (counts.join(offsets, ["count", "_pre"])
            .withColumn("id", (F.col("_offset") + F.row_number().over(within) - 1 + len(SPECIAL_TOKENS)).cast("int"))
            .select(token, "id", "count"))


def encode_tokens(df: DataFrame, vocab: DataFrame, tokens: str, key_cols: tuple, out: str = "ids",
                  head_rows: int = 1_000_000, carry: tuple = ()) -> DataFrame:
    """Token strings -> vocabulary ids, unknown -> UNK_ID, PAD -> PAD_ID (PREP4).

    Ids follow the counts, so the ``head_rows`` most frequent tokens are those with the smallest ids: that part of the vocabulary, a
    proven bound, is broadcast. Tokens beyond it are rare each; they alone are shuffled, by token. No job runs while the plan is built.

    A sample is told apart by the digest of its keys, tokens and carried arrays, and counted: samples that share a key, or have a null
    one, keep their own ids, and repeated rows come out as often as they went in. Rows are hash-partitioned by that digest once; the
    exploded tokens stay in that partitioning. Padding behind the last token is not exploded.
    """
    text = [F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("\u0002"))), "\u0001") for c in (tokens, *carry)]
    digest = F.unhex(F.sha2(F.concat_ws("\u0003", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in key_cols], *text), 256))
    rows = df.withColumn("_sample", digest).groupBy("_sample").agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in (*key_cols, tokens, *carry)])
    behind = F.array_position(F.transform(F.reverse(tokens), lambda t: t != PAD), F.lit(True))  # 1 if the last slot is a token
    length = F.when(behind > 0, F.size(tokens) - behind + 1).otherwise(0).cast("int")
    long = exploded(rows, ["_sample"], F.slice(tokens, 1, length), "_tok", "_pos")
    n = len(SPECIAL_TOKENS) + head_rows
    v = vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_id"))
    found = long.join(F.broadcast(v.where(F.col("_id") < n)), "_tok", "left")
    found = found.withColumn("_id", F.when(F.col("_tok") == PAD, F.lit(PAD_ID)).otherwise(F.col("_id")))
    rare = found.where(F.col("_id").isNull()).drop("_id").join(v.where(F.col("_id") >= n), "_tok", "left")
    rare = rare.groupBy("_sample").agg(F.collect_list(F.struct("_pos", F.coalesce("_id", F.lit(UNK_ID)).alias("_id"))).alias("_rare"))
    known = found.where(F.col("_id").isNotNull()).groupBy("_sample").agg(F.collect_list(F.struct("_pos", "_id")).alias("_known"))
    none = F.array().cast("array<struct<_pos:int,_id:int>>")
    ids = F.array_sort(F.concat(F.coalesce("_known", none), F.coalesce("_rare", none)))
    padded = F.concat(F.transform(ids, lambda p: p["_id"]), F.array_repeat(F.lit(PAD_ID), F.size(tokens) - F.size(ids)))
    both = rows.join(known, "_sample", "left").join(rare, "_sample", "left")
    each = both.withColumn(out, padded).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return each.select(*key_cols, tokens, out, *carry)


def sample_batches(df: DataFrame, key_cols: tuple = ("doc_id", "window_no"), batch_size: int = DEFAULT_BATCH_SIZE,
                   buckets: int | None = None) -> DataFrame:
    """key_cols, sample_no, batch_no, slot: samples numbered from 0 in the order of a hash of their keys, and cut into batches (PREP7).

    Two passes over the keys alone: rows of each bucket (a range of the hash), their running sum over the buckets, and the rank of a
    sample in its bucket. The numbers are gapless over the whole table and the same for any number of buckets or partitions. The hash
    is of the full key, so no bucket grows with one document; there are four for each shuffle partition of the session unless
    ``buckets`` says otherwise. Samples with equal keys are numbered one after the other.
    """
    h = hash32(hash_key(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in key_cols]))
    keys = df.select(*key_cols, h.alias("_h"))
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.coalesce(F.floor(F.col("_h") * buckets / (1 << 32)).cast("int"), F.lit(0))  # never null, so both passes get one plan
    keys = keys.withColumn("_bucket", bucket)
    keys = keys.repartition("_bucket")  # both passes begin at this exchange, so the samples are made once
    sizes = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row for each bucket
    sizes = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *key_cols)) - 1
    no = (F.col("_before") + F.col("_rank")).cast("long")
    numbered = keys.withColumn("_rank", rank).join(F.broadcast(sizes), "_bucket").withColumn("sample_no", no)
    return numbered.select(*key_cols, "sample_no", F.floor(F.col("sample_no") / batch_size).alias("batch_no"),
                           (F.col("sample_no") % batch_size).cast("int").alias("slot"))


def assign_batches(df: DataFrame, key_cols: tuple = ("doc_id", "window_no"), batch_size: int = DEFAULT_BATCH_SIZE,
                   shards: int | None = None, rows_per_shard: int = 1_000_000) -> DataFrame:
    """Fixed-size batches (PREP7) without a global row number: samples are spread over ``shards``
    by a hash of their key, then numbered in key order inside each shard.

    Each shard is sorted by one task, so by default the shard count follows the data (about
    ``rows_per_shard`` samples per shard). Hashing the full key keeps shards even when one
    document holds a large share of all windows.
    """
    if shards is None:
        shards = max(1, -(-df.count() // rows_per_shard))
    shard = F.pmod(hash32(hash_key(*[F.col(c) for c in key_cols])), F.lit(shards)).cast("int")
    w = Window.partitionBy("shard").orderBy(*key_cols)
    return (df.withColumn("shard", shard)
            .withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / F.lit(batch_size)).cast("int")))
