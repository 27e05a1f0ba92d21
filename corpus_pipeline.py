"""A corpus pipeline from five operators: quality rules, near duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies them to the table
``documents``; each result is written as Parquet to the shared folder and read again for the next.
All stages but the last return the columns of ``documents``. A null in any column, empty texts,
repeated rows, an empty table and further columns are handled as the operators' docstrings say.

SQL cannot express the stages (iterated estimates, signatures, expectation-maximisation, byte pair
merges), so ``ORACLE_SQL`` is None; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm import bpe_tree, mix, near_dup, pii, quality
from shroud.llm.common import clean, read, stored, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id."""
    return near_dup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars is that of the new text (null for a null text)."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian, 4 bytes each)."""
    return bpe_tree.digests(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what the stages stored on the way is deleted as soon as the next stage has its input."""
    docs, before = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        clean(spark, docs, before=before)  # other results may still read theirs
    return docs
