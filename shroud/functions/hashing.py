"""Deterministic picks: every fake value is a pure function of (seed, kind, scope, value).

A pick hashes the key with md5 and reads 32 bits from it, so results do not depend on row
order, partitioning or retries (a lost task recomputes the same values). The same numbers
come out of the oracle: ``('0x' || substr(md5(key), 1 + 8*word, 8))::BIGINT``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(p) -> Column:
    return p if isinstance(p, Column) else F.lit(str(p))


def hash_key(*parts) -> Column:
    """'|'-joined key; NULL parts are skipped (same as the oracle's concat_ws)."""
    return F.concat_ws("|", *[_as_col(p).cast("string") for p in parts])


def hash32(key: Column, word: int = 0) -> Column:
    """Unsigned 32-bit number from hex digits ``8*word+1 .. 8*word+8`` of md5(key)."""
    if not 0 <= word <= 3:
        raise ValueError("word must be 0..3")
    return digest32(F.md5(key.cast("binary")), word)


def digest32(digest: Column, word: int = 0) -> Column:
    """``hash32`` of a key whose md5 is already there: where several words of one key are read, the digest is bound once."""
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("long")


_POOL_CACHE: dict = {}


def pool_array(values: Sequence[str]) -> Column:
    """Constant array column; built once per Spark context (building costs one call per value)."""
    from pyspark import SparkContext
    key = (tuple(values), id(SparkContext._active_spark_context))
    col = _POOL_CACHE.get(key)
    if col is None:
        col = _POOL_CACHE[key] = F.array(*[F.lit(v) for v in values])
    return col


def pick(values: Sequence[str], h: Column) -> Column:
    """Element of a constant pool chosen by a hash number."""
    return F.element_at(pool_array(values), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def pick_int(h: Column, lo: int, hi: int) -> Column:
    """Integer in [lo, hi] from a hash number."""
    return (F.pmod(h, F.lit(hi - lo + 1)) + F.lit(lo)).cast("int")


# ---- the same picks as DuckDB SQL text (used by the oracle) -----------------------------

def sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def sql_hash_key(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_hash32(key_sql: str, word: int = 0) -> str:
    return f"CAST(('0x' || substr(md5({key_sql}), {1 + 8 * word}, 8)) AS BIGINT)"


def sql_pool(values: Sequence[str]) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def sql_pick(values: Sequence[str], h_sql: str) -> str:
    return f"({sql_pool(values)})[(({h_sql}) % {len(values)}) + 1]"


def sql_pick_int(h_sql: str, lo: int, hi: int) -> str:
    return f"CAST((({h_sql}) % {hi - lo + 1}) + {lo} AS INTEGER)"
