"""Pattern-found contacts (RGX1-3) and their rewrite (RW5-7) as DataFrame operators.

All of it is row-local: one narrow stage, no shuffle, whole-stage codegen around the
regex expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_SEED
from ..functions.patterns import find_all
from ..functions.rewrite import redact_contacts, redact_pattern


def _scope(df: DataFrame, key: str, scope: str):
    if scope == "doc":
        return F.col(key)
    if scope == "corpus":
        return None
    raise ValueError("scope is 'doc' (one map per document) or 'corpus' (one map overall)")


def find_contacts(df: DataFrame, kind: str, text: str = "text", key: str = "doc_id",
                  out: str = "value") -> DataFrame:
    """Long form ``(key, ord, value)``: every match in order, duplicates kept."""
    return (df.select(key, F.posexplode(find_all(kind, F.col(text))).alias("ord", out))
            .select(key, F.col("ord").cast("long").alias("ord"), out))


def redact_kind(df: DataFrame, kind: str, text: str = "text", key: str = "doc_id", seed: int = DEFAULT_SEED,
                scope: str = "doc", out: str = "redacted_text") -> DataFrame:
    """One kind (``email``, ``phone`` or ``url``) replaced by consistent fakes."""
    return df.withColumn(out, redact_pattern(kind, F.col(text), _scope(df, key, scope), seed))


def redact_contact_chain(df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = DEFAULT_SEED,
                         scope: str = "doc", order: tuple = ("email", "phone", "url"),
                         out: str = "redacted_text") -> DataFrame:
    """Emails, then phones, then URLs; each step sees the previous step's output."""
    return df.withColumn(out, redact_contacts(F.col(text), _scope(df, key, scope), seed, order))
