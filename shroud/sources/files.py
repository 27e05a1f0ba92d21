"""File sources (SRC1-5): text directories, page tables, a single CSV, JSON objects.

All of them are Spark readers: files are listed and read by the executors, never by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_dir(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """SRC1: every file matching ``suffix`` directly in ``path`` -> ``(doc_id, text)``.

    One row per file (whole file), ``doc_id`` = file name. Line ends are normalised to ``\\n``
    (text-mode reading does the same). Case-sensitive suffix, not recursive; hidden files are
    skipped by Spark's listing; a 0-byte file yields no row.
    """
    df = (spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", False)
          .text(path, wholetext=True))
    # Spark gives the name as part of a URI (a blank is %20)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.select(name.alias("doc_id"),
                     F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def pages_to_documents(pages: DataFrame, key: str = "doc_id", page_no: str = "page_no",
                       page_text: str = "page_text") -> DataFrame:
    """SRC2: a page table -> one text per document: every non-empty page followed by ``\\n``,
    in page order. A document whose pages are all empty gives ``''`` (it still exists).

    The group is one document's pages (bounded by that document's size).
    """
    usable = F.when(F.coalesce(F.length(page_text), F.lit(0)) > 0, F.struct(F.col(page_no).alias("n"),
                                                                          F.col(page_text).alias("t")))
    g = pages.groupBy(key).agg(F.array_sort(F.collect_list(usable)).alias("_p"))
    return g.select(key, F.array_join(F.transform("_p", lambda p: F.concat(p.t, F.lit("\n"))), "").alias("text"))


def _names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The files of a folder (or the file itself) that match, by name; from the file listing, no data is read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(path))
    return sorted(found.inputFiles())


def read_single_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: the one ``.csv`` file in a directory, header + inferred types; an error when the
    directory holds none or several."""
    names = _names(spark, path, "*.csv")
    if not names:
        raise ValueError(f"no CSV file found in {path}")
    if len(names) > 1:
        raise ValueError(f"several CSV files found in {path}")
    return spark.read.option("header", True).option("inferSchema", True).csv(names[0])


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: one JSON object per file (multi-line). A directory gives the first ``.json`` by
    sorted name, so the choice is deterministic."""
    names = _names(spark, path, "*.json")
    if not names:
        raise ValueError(f"no JSON file found in {path}")
    return spark.read.option("multiLine", True).json(names[0])


def read_label_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A label -> id JSON object as a ``(label, id)`` table."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("label", "id"))


def union_formats(**sources: DataFrame) -> DataFrame:
    """SRC5: several ``(doc_id, text)`` sources as one frame with a ``format`` column (one pass
    over all of them instead of one run per format)."""
    out = None
    for name, df in sources.items():
        part = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(name).alias("format"))
        out = part if out is None else out.unionByName(part)
    return out
