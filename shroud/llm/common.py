"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_sum, split_on
from ..shipping import ship

WORD = r"[^ \t-\r]+"  # a run of characters other than space and \x09-\x0D
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the storage that driver and executors share.

    Where the setting is missing, a local session (tests) gets a private folder; any other
    session is refused, because its executors could not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shroud-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []  # folders of this driver that are not cleaned yet


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again: evaluated once, with no lineage left.

    The table stays until ``clean``: results read it whenever they are evaluated.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> frozenset[str]:
    """The folders of stored tables so far, for ``clean(before=...)``."""
    return frozenset(_WRITTEN)


def clean(spark: SparkSession, *keep: DataFrame, before: frozenset[str] = frozenset()) -> int:
    """Delete the stored tables of this driver that ``keep`` does not read and that are not in ``before``; the number of folders deleted.

    Call it once a result has been written: a DataFrame that is not in ``keep`` and reads a stored table cannot be evaluated any more.
    """
    used = [f for df in keep for f in df.inputFiles()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = [p for p in _WRITTEN if p not in before and not any(f"/{p.rstrip('/').rsplit('/', 1)[-1]}/" in f for f in used)]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _WRITTEN.remove(p)
    return len(gone)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """At most ``rows`` rows in an Arrow batch, so that a batch of very long texts stays small; the package goes to the workers.

    It is the session's setting; a smaller value that the user has chosen stays.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "left",
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts ``small`` only when its measured size is below ``max_bytes``.

    The size is one aggregate over ``small`` (rows, bytes of its string columns, elements of its arrays), so ``small``
    should be a stored table. Beyond the bound it is a plain join, which AQE splits on skew.
    """
    size = F.lit(16 * len(small.columns))
    for name, kind in small.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            size = size + 32 * F.coalesce(F.array_size(F.col(f"`{name}`")), F.lit(0))
    total = small.agg(F.sum(size.cast("long"))).first()[0] or 0
    return big.join(F.broadcast(small) if total <= max_bytes else small, on, how)


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def matches(text: Column, pattern: str, gate: Column | None = None, group: int | None = None) -> Column:
    """ARRAY<STRUCT<start, end, match[, part]>>: every match of a literal pattern, left to right, in code points.

    The pieces around the matches and the matches come from the same left-to-right scan; starts
    are a running sum of their lengths. Rows for which ``gate`` (by default the pattern itself)
    is false get an empty array at the cost of that test alone.
    """
    fields = "start:int,end:int,match:string" + (",part:string" if group else "")

    def build(found):
        gaps = split_on(text, pattern)
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        spans = F.zip_with(found, prefix_sum(steps), lambda m, e: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
        if group:
            spans = F.zip_with(spans, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s, p: F.struct(
                s.start.alias("start"), s.end.alias("end"), s.match.alias("match"), p.alias("part")))
        return spans

    gate = text.rlike(pattern) if gate is None else gate
    return F.when(gate, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)).otherwise(
        F.array().cast(f"array<struct<{fields}>>"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"),
                                                                 s.end.cast("string"))), ",")
