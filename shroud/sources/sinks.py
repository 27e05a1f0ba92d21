"""Sinks (SNK1-2): redacted documents written by the executors, and the paragraph table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_output_names(df: DataFrame, key: str = "doc_id", prefix: str = "REDACTED_") -> DataFrame:
    return df.withColumn("out_name", F.concat(F.lit(prefix), F.col(key).cast("string")))


def write_redacted(df: DataFrame, path: str, key: str = "doc_id", text: str = "redacted_text",
                   prefix: str = "REDACTED_", fmt: str = "parquet") -> None:
    """SNK1: one record per document named ``prefix + key``, overwriting ``path``.

    ``fmt="parquet"`` (default) writes a table, which scales to any number of documents.
    ``fmt="files"`` writes one file of that name for each document (``filesink.py``). Documents that share a key, or have none, get
    the beginning of their text's digest behind the name; equal texts of one key are one file.
    ``fmt="text"`` writes one folder per document (``out_name=<name>/part-*.txt``); rows are
    first clustered by name so each document is written by one task.
    """
    out = with_output_names(df, key, prefix).select("out_name", F.col(text).alias("value"))
    if fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    elif fmt == "files":
        from .filesink import register
        register(df.sparkSession)
        several = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull())
        several = several.select(F.col(key).alias("_key"), F.lit(True).alias("_several"))
        named = df.join(several, df[key].eqNullSafe(F.col("_key")), "left")
        name = F.concat(F.lit(prefix), F.coalesce(F.col(key).cast("string"), F.lit("unnamed")))
        digest = F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 16)
        named.select(F.when(F.col("_several"), F.concat(name, F.lit("-"), digest)).otherwise(name).alias("out_name"),
                     F.col(text).alias("value")).write.format("redacted_files").mode("append").save(path)
    elif fmt == "text":
        out.repartition("out_name").write.mode("overwrite").partitionBy("out_name").text(path)
    else:
        raise ValueError("fmt is 'parquet', 'files' or 'text'")


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "redacted_text") -> DataFrame:
    """SNK2: ``(key, para_no, para)`` - the text split on ``\\n``, blank lines kept, in order."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("para_no", "para"))
