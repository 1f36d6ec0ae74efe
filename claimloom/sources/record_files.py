"""Folders of JSON records as a Spark data source that keeps what it cannot read.

Files are listed below the folder, with size, and cut to ranges of bytes; a partition is some ranges of about `bytes`. A
record is a line, or with `lines` false a whole file. Paths may name any file system that pyarrow knows; files and folders
whose names begin with _ or . are passed over.

Defined cases: blank lines and empty files are no records; a record that is no UTF-8, no JSON or no object has a problem
and its text, with bytes that cannot be decoded replaced; read_records() does the same for fields of other types than the
schema's. A line belongs to the range that it begins in. A folder without files gives an empty table.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "path string, position long, body string, problem string"


@dataclass
class Ranges(InputPartition):
    """Stretches of files: path, first byte, and the byte where the next one begins."""

    of: list[tuple[str, int, int]]


class RecordFiles(DataSource):
    """Options: path, lines (true), bytes (64 MB). position is where in its file a record begins."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options["path"], self.options.get("lines", "true").lower() == "true", int(self.options.get("bytes", 64 << 20)))


def problem_of(record: bytes) -> str | None:
    try:
        return None if isinstance(json.loads(record.decode()), dict) else "no object"
    except UnicodeDecodeError:
        return "no UTF-8"
    except (ValueError, RecursionError):
        return "no JSON"


class RecordReader(DataSourceReader):
    def __init__(self, path: str, lines: bool, size: int):
        self.path, self.lines, self.size = path, lines, size

    def partitions(self) -> list[Ranges]:
        system, top = fs.FileSystem.from_uri(self.path)
        out, held = [], 0
        for file in sorted(system.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda f: f.path):
            hidden = any(name[:1] in "_." for name in file.path[len(top) :].strip("/").split("/"))
            if file.type != fs.FileType.File or hidden or not file.size:
                continue
            step = self.size if self.lines else file.size
            for at in range(0, file.size, step):
                end = min(at + step, file.size)
                if not out or held + end - at > self.size:
                    out.append(Ranges([]))
                    held = 0
                out[-1].of.append((file.path, at, end))
                held += end - at
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        found, held = [], 0
        for path, start, end in partition.of:
            with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as file:
                for at, record in self._records(file, start, end):
                    if record.strip():
                        found.append((path, at, record.decode(errors="replace"), problem_of(record)))
                        held += len(record)
                    if held > 1 << 20 or len(found) >= 4096:
                        yield self._batch(found)
                        found, held = [], 0
        yield self._batch(found)

    def _records(self, file: io.BufferedReader, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        if not self.lines:
            yield 0, file.read()
            return
        at = max(start - 1, 0)
        file.seek(at)
        if start:  # the rest of a line of the range before, or the end of its last one
            at += len(file.readline())
        while at < end and (line := file.readline()):
            yield at, line.rstrip(b"\r\n")
            at += len(line)

    def _batch(self, found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        types = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "position", "body", "problem"])


def read_records(spark: SparkSession, folder: str, schema: str, lines: bool = True, size: int = 64 << 20) -> DataFrame:
    """path, position, the schema's columns, problem and rejected (the text of a record with a problem, whose columns are null)."""
    spark.dataSource.register(RecordFiles)
    raw = spark.read.format("records").option("lines", str(lines).lower()).option("bytes", size).load(folder)
    parsed = F.from_json("body", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    read = raw.withColumn("r", F.when(F.col("problem").isNull(), parsed))
    read = read.withColumn("problem", F.coalesce("problem", F.when(F.col("r.__corrupt").isNotNull(), F.lit("other types"))))
    kept = F.when(F.col("problem").isNull(), F.col("r")).alias("r")
    names = spark.createDataFrame([], schema).columns
    read = read.select("path", "position", kept, "problem", F.when(F.col("problem").isNotNull(), F.col("body")).alias("rejected"))
    return read.select("path", "position", *[F.col(f"r.`{n}`").alias(n) for n in names], "problem", "rejected")
