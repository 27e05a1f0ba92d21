"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, bpe_tree, fingerprint, licences, mix, near_dup, pii, quality, secrets, sharding, token_store, url_filter,
               whitening)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_trigram_secrets(spark, sf_dir):
    """Secrets in every document."""
    return secrets.report(read(spark, sf_dir, "documents"))


def op2_weak_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.report(read(spark, sf_dir, "documents"))


def op3_bpe_tree(spark, sf_dir):
    """Byte-level BPE round trip of every document."""
    return bpe_tree.digests(read(spark, sf_dir, "documents"))


def op4_mcd_quality(spark, sf_dir):
    """Statistics and verdict of every document."""
    return quality.verdicts(read(spark, sf_dir, "documents"))


def op5_token_store(spark, sf_dir):
    """Place and checksum of every document's ids, read back from the files."""
    return token_store.stored_documents(read(spark, sf_dir, "documents"))


def op6_pareto_mix(spark, sf_dir):
    """Words that the mix takes from every document."""
    rows = mix.plan(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target",
                       (F.col("copies") * F.col("size")).alias("taken"))


def op7_dart_minhash(spark, sf_dir):
    """Class of near duplicates of every document."""
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op8_content_chunks(spark, sf_dir):
    """Fingerprint of every document, held against an edited text's and the next document's."""
    return fingerprint.compare(read(spark, sf_dir, "documents"))


def op9_licence_digests(spark, sf_dir):
    """Licence and notices of every document."""
    return licences.scan(read(spark, sf_dir, "documents"))


def op10_url_filter(spark, sf_dir):
    """Rule and verdict of every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_qd_whitening(spark, sf_dir):
    """Whitened components of every embedding."""
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark, sf_dir):
    """Alignment of two tokenizers over every document."""
    return alignment.measures(read(spark, sf_dir, "documents"))


def op13_hypergeometric_shards(spark, sf_dir):
    """Shard and slot of every document."""
    return sharding.report(read(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_trigram_secrets, op2_weak_pii, op3_bpe_tree, op4_mcd_quality, op5_token_store, op6_pareto_mix, op7_dart_minhash,
        op8_content_chunks, op9_licence_digests, op10_url_filter, op11_qd_whitening, op12_token_alignment,
        op13_hypergeometric_shards)}


def all_sql() -> dict[str, str]:
    return {"op1_trigram_secrets": secrets.report_sql(), "op9_licence_digests": licences.scan_sql()}
