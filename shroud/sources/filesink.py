"""SNK1 as a Spark data source: one file for each document, written by the executors.

``df.write.format("redacted_files").mode("append").save(folder)`` writes each row ``(out_name, value)`` as the file
``folder/out_name`` (UTF-8). A file is written beside its place and moved there, so a task that runs twice, or two attempts at
once, leave one whole file. ``_SUCCESS`` is written when all tasks are done. ``/`` and ``%`` in a name are percent-encoded.
The folder is any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _folder(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if ":/" in path else "file://" + os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        where, top = _folder(self.path)
        where.create_dir(top, recursive=True)
        n = 0
        for row in rows:
            name = row["out_name"].replace("%", "%25").replace("/", "%2F")
            part = f"{top}/.{uuid.uuid4().hex}.part"
            with where.open_output_stream(part) as out:
                out.write((row["value"] or "").encode())
            where.move(part, f"{top}/{name}")
            n += 1
        return Written(n)

    def commit(self, messages) -> None:
        where, top = _folder(self.path)
        where.create_dir(top, recursive=True)
        with where.open_output_stream(f"{top}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages) -> None:
        """Files that are whole stay; without ``_SUCCESS`` the run is not complete and can be run again."""


class RedactedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "redacted_files"

    def schema(self) -> str:
        return "out_name string, value string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("redacted_files adds to a folder: use mode('append') and a new folder")
        if not {"out_name", "value"} <= set(schema.names):
            raise ValueError("redacted_files writes the columns out_name and value")
        return FileWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    from ..shipping import ship
    ship(spark)
    spark.dataSource.register(RedactedFiles)
