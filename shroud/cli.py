"""Command for a whole run: ``spark-submit shroud/cli.py settings.json`` or ``python -m shroud.cli settings.json`` (RW9).

Settings (JSON)::

    {"sources": [{"format": "txt", "path": "notes/"},
                 {"format": "pages", "path": "pages.parquet", "key": "doc_id", "page_no": "page_no", "page_text": "page_text"},
                 {"format": "table", "path": "docs.parquet", "key": "doc_id", "text": "text"}],
     "output": "redacted/", "output_format": "files",          # files, parquet or text
     "gazetteer": "places.parquet", "gazetteer_column": "entry",  # optional
     "labels": "label2id.json",                                # optional; must name this library's labels and ids
     "seed": 200, "mode": "chain", "span_entities": ["PERSON", "LOCATION", "DATE"]}

All sources are read, redacted and written in one run; file names are those of the documents, prefixed by ``REDACTED_``.
"""

from __future__ import annotations

import json
import os
import sys

if __package__ in (None, ""):  # started as a file by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession

from shroud.config import LABEL2ID, RedactionConfig
from shroud.operators.classify import RuleTagger
from shroud.operators.redact import redact
from shroud.sources.files import pages_to_documents, read_label_vocabulary, read_text_dir, union_formats
from shroud.sources.sinks import write_redacted

KNOWN = {"sources", "output", "output_format", "gazetteer", "gazetteer_column", "labels", "seed", "mode", "span_entities", "ref_date"}


def check_labels(spark: SparkSession, path: str) -> None:
    """Refuse a label file with labels or ids that this library does not have."""
    unknown = {(r.label, r.id) for r in read_label_vocabulary(spark, path).limit(10_000).collect()} - set(LABEL2ID.items())
    if unknown:
        raise ValueError(f"unknown labels in {path}: {sorted(unknown)}")


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """(doc_id, text) of one source."""
    kind, path = source["format"], source["path"]
    if kind == "txt":
        return read_text_dir(spark, path)
    if kind == "pages":
        return pages_to_documents(spark.read.parquet(path), source.get("key", "doc_id"), source.get("page_no", "page_no"),
                                  source.get("page_text", "page_text")).withColumnRenamed(source.get("key", "doc_id"), "doc_id")
    if kind == "table":
        df = spark.read.parquet(path)
        return df.select(df[source.get("key", "doc_id")].alias("doc_id"), df[source.get("text", "text")].alias("text"))
    raise ValueError(f"unknown source format {kind!r}: txt, pages or table")


def run(spark: SparkSession, settings: dict) -> None:
    unknown = set(settings) - KNOWN
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if settings.get("labels"):
        check_labels(spark, settings["labels"])
    cfg = RedactionConfig(**{k: tuple(settings[k]) if k == "span_entities" else settings[k]
                             for k in ("seed", "mode", "span_entities", "ref_date") if k in settings})
    gazetteer = spark.read.parquet(settings["gazetteer"]) if settings.get("gazetteer") else None
    detector = RuleTagger(gazetteer, settings.get("gazetteer_column", "entry"))
    docs = union_formats(**{f"s{i}": read_source(spark, s) for i, s in enumerate(settings["sources"])})
    write_redacted(redact(docs, detector, cfg=cfg), settings["output"], fmt=settings.get("output_format", "files"))


def main(argv: list[str]) -> None:
    if len(argv) != 1:
        raise SystemExit("usage: cli.py settings.json")
    with open(argv[0], encoding="utf-8") as f:
        settings = json.load(f)
    run(SparkSession.builder.appName("shroud-redact").getOrCreate(), settings)


if __name__ == "__main__":
    main(sys.argv[1:])
