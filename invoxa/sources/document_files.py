"""Sink that writes one file per row (S9, S12, S13), as a Spark data source.

Each task writes its files into a folder of its own below a hidden folder of the
job. Only when all tasks have ended well are the files moved to their names, so
neither a repeated task nor a failed job leaves a file that is incomplete or not
wanted.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "invoxa_document_files"
SCHEMA = "file_name string, content string"
#: Moves that run at a time when a job is committed.
MOVERS = 16


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, given as a path or as a uri."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.rstrip("/")
    fs, path = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/")
                                        and not uri.startswith("file://") else uri)
    return fs, path.rstrip("/")


def checked_name(name: str | None) -> str:
    if not name or name in (".", "..") or "/" in name or "\0" in name:
        raise ValueError(f"not the name of a file in a folder: {name!r}")
    return name


@dataclass
class TaskFiles(WriterCommitMessage):
    """What the driver hears of a task: its folder, whatever the number of files."""

    folder: str


class DocumentFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"_job-{uuid.uuid4().hex}"
        fs, base = open_folder(folder)
        fs.create_dir(f"{base}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> TaskFiles:
        fs, base = open_folder(self.folder)
        mine = f"{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/{mine}", recursive=False)  # fails if the job has ended without this task
        for row in iterator:
            with fs.open_output_stream(f"{base}/{mine}/{checked_name(row['file_name'])}") as out:
                out.write((row["content"] or "").encode())
        return TaskFiles(mine)

    def commit(self, messages: list[TaskFiles | None]) -> None:
        """Moves the files to their names; one task's names at a time are in memory."""
        fs, base = open_folder(self.folder)
        with ThreadPoolExecutor(MOVERS) as pool:
            for message in filter(None, messages):
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{message.folder}"))
                list(pool.map(lambda f: fs.move(f.path, f"{base}/{f.base_name}"), found))
        self._clear(fs, base)

    def abort(self, messages: list[TaskFiles | None]) -> None:
        self._clear(*open_folder(self.folder))

    def _clear(self, fs: pafs.FileSystem, base: str) -> None:
        """Also removes what tasks wrote that failed, were repeated or lost their executor.
        A task that still runs may add a file meanwhile, so a few attempts are made."""
        for pause in (0.1, 0.5, 2, 0):
            if fs.get_file_info(f"{base}/{self.job}").type != pafs.FileType.Directory:
                return
            try:
                fs.delete_dir(f"{base}/{self.job}")
            except OSError:
                if not pause:
                    raise
                time.sleep(pause)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files of the same name are replaced and no others removed: use mode append")
        return DocumentFilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)


def write_document_files(df: DataFrame, folder: str, name: Column, content: Column) -> None:
    """A file for each row of ``df`` in ``folder`` (a path or uri that all executors
    reach): UTF-8 ``content`` (null: an empty file) under ``name``.

    All files appear at the end, by renaming, or none if a task fails for good. A file
    that is there already is replaced, others stay. Names without a folder are asked
    for: a null or empty name, or one with a slash, fails the job. If two rows have one
    name, one of both files stays. The renames are calls of the driver, some at a
    time: for very many documents there are the sinks of JSON lines and parquet.
    """
    register(df.sparkSession)
    rows = df.select(name.cast("string").alias("file_name"), content.cast("string").alias("content"))
    rows.write.format(FORMAT).mode("append").save(folder)
