"""Sinks for files: a document and its metadata for each row, and CSV parts with a byte-order mark.

Both are Python data sources: every task writes its files under names of their own and moves each into place in one
step, so a task that runs again leaves the same files; the job's commit writes the success mark, its abort takes away
what its tasks have reported. Paths may be on any file system that Arrow knows.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


MARK = "﻿".encode()


@dataclass
class Written(WriterCommitMessage):
    files: int
    rows: int
    part: str | None = None


class _Folder:
    """A folder on a file system that Arrow knows; files appear whole or not at all."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def put(self, name: str, chunks: Iterator[bytes], attempt: str) -> None:
        target = posixpath.join(self.root, name)
        self.fs.create_dir(posixpath.dirname(target), recursive=True)
        own = f"{target}.{attempt}.part"
        with self.fs.open_output_stream(own) as out:
            for c in chunks:
                out.write(c)
        self.fs.move(own, target)

    def remove(self, name: str) -> None:
        from pyarrow import fs

        path = posixpath.join(self.root, name)
        if self.fs.get_file_info(path).type == fs.FileType.File:
            self.fs.delete_file(path)


def _attempt() -> str:
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        folder, attempt, n = _Folder(self.path), _attempt(), 0
        for row in iterator:
            folder.put(row["name"], iter([bytes(row["content"] or b"")]), attempt)
            n += 1
        return Written(n, n)

    def commit(self, messages) -> None:
        totals = {"files": sum(m.files for m in messages if m)}
        _Folder(self.path).put("_SUCCESS", iter([json.dumps(totals).encode()]), "commit")

    def abort(self, messages) -> None:
        """Files stay: each is whole, and the next run writes the same ones."""


class FilesSource(DataSource):
    """Rows (name: a path under the target, content: its bytes) as files."""

    @classmethod
    def name(cls) -> str:
        return "lexiweave_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite) -> _FilesWriter:
        return _FilesWriter(self.options["path"])


class _CsvWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        name, rows = f"part-{TaskContext.get().partitionId():05d}.csv", 0
        first = next(iterator, None)
        if first is None:
            return Written(0, 0)

        def lines() -> Iterator[bytes]:
            nonlocal rows
            text = io.StringIO()
            out = csv.writer(text)
            out.writerow(self.columns)
            yield MARK

            def rest():
                yield first
                yield from iterator

            for row in rest():
                out.writerow(["" if v is None else v for v in row])
                rows += 1
                if text.tell() > 1 << 20:
                    yield text.getvalue().encode()
                    text.seek(0)
                    text.truncate()
            yield text.getvalue().encode()

        _Folder(self.path).put(name, lines(), _attempt())
        return Written(1, rows, name)

    def commit(self, messages) -> None:
        folder = _Folder(self.path)
        if not any(m and m.files for m in messages):
            folder.put("part-00000.csv", iter([MARK]), "commit")  # no rows: an empty file, without a header
        folder.put("_SUCCESS", iter([json.dumps({"rows": sum(m.rows for m in messages if m)}).encode()]), "commit")

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.part:
                _Folder(self.path).remove(m.part)


class CsvSource(DataSource):
    """Rows as CSV parts, each with a byte-order mark and the header."""

    @classmethod
    def name(cls) -> str:
        return "lexiweave_csv"

    def schema(self) -> str:
        raise NotImplementedError("this source is written only")

    def writer(self, schema, overwrite) -> _CsvWriter:
        return _CsvWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    for source in (FilesSource, CsvSource):
        spark.dataSource.register(source)


def save_exhibits(exhibits: DataFrame, path: str) -> None:
    """exhibits: accession, filename, content (bytes), and what the metadata should say. Each becomes accession/filename and accession/filename.metadata.json.

    Accessions go without dashes; of file names only the last part counts. Rows with one name are written one after another: the last stays.
    """
    register(exhibits.sparkSession)
    name = F.concat(F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), F.regexp_extract(F.col("filename"), "([^/\\\\]+)$", 1))
    facts = F.to_json(F.struct(*[c for c in exhibits.columns if c != "content"]), {"ignoreNullFields": "false"})
    pair = F.array(F.struct(name.alias("name"), F.col("content").cast("binary").alias("content")), F.struct(F.concat(name, F.lit(".metadata.json")).alias("name"), facts.cast("binary").alias("content")))
    exhibits.select(F.explode(pair).alias("f")).select("f.name", "f.content").write.format("lexiweave_files").mode("append").save(path)


def write_csv(frames: list[DataFrame], path: str, spark: SparkSession | None = None) -> None:
    """Frames with different columns as one table of CSV parts, columns in the order first seen; without frames or rows one empty file. Text columns only differ by null, written empty."""
    if not frames:
        if spark is None:
            raise ValueError("without frames a session is needed")
        frames = [spark.createDataFrame([], "empty string")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    register(out.sparkSession)
    out.select([F.col(f"`{c}`").cast("string").alias(c) for c in out.columns]).write.format("lexiweave_csv").mode("append").save(path)


