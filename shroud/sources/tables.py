"""Table inputs: parquet scans with column pruning, and the document shapes the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan that reads only ``columns`` (the projection reaches ReadSchema)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


SCAN_PARTITIONS = "shroud.scan.partitions"
PER_CORE = 4  # partitions for each core, at least


def spread(raw: DataFrame, key: str, scan: DataFrame | None = None) -> DataFrame:
    """A raw scan dealt out by ``key``, because the work on each text is what costs.

    The number of splits of a scan says little: a row group is read by one task however many splits its file has, and a million
    short rows fit into one. Partitions are the session's shuffle partitions, the scan's splits or ``PER_CORE`` for each core, whichever are
    most, unless the session's ``shroud.scan.partitions`` gives their number (0 leaves the scan as it is). Rows that come out of
    joins are dealt out behind those, with the splits of their largest ``scan``: a join's own exchange would take their place.
    """
    spark = raw.sparkSession
    n = spark.conf.get(SCAN_PARTITIONS, None)
    if n is None:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PER_CORE * spark.sparkContext.defaultParallelism,
                (raw if scan is None else scan).rdd.getNumPartitions())
    return raw.repartition(int(n), key) if int(n) else raw


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1: ``documents(doc_id, text)``."""
    return spread(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: every page URL inside a sentence, keyed by page id."""
    pages = spread(read_table(spark, sf_dir, "pages", "page_id", "url"), "page_id")
    return pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see "), F.col("url"), F.lit(" for more")).alias("text"))


def contact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 and T2 as one corpus with a ``source`` column (SRC5-style union, one pass)."""
    return documents(spark, sf_dir).withColumn("source", F.lit("documents")).unionByName(
        page_texts(spark, sf_dir).withColumn("source", F.lit("pages")))


DOCUMENTS_SQL = "SELECT doc_id, text FROM documents"
PAGE_TEXTS_SQL = "SELECT page_id AS doc_id, 'see ' || url || ' for more' AS text FROM pages"
CONTACT_CORPUS_SQL = (f"SELECT doc_id, text, 'documents' AS source FROM documents UNION ALL "
                      f"SELECT page_id AS doc_id, 'see ' || url || ' for more' AS text, 'pages' AS source FROM pages")
