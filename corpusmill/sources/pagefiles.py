"""Data source ``pagefiles``: pages at byte offsets of rolling data files, with a tab-separated manifest.

A folder holds

* data files ``data_<bucket>_<write>_<task>_<attempt>_<n>``, pages one after another; a file that has reached ``roll`` bytes is closed
  and the next one begun;
* per task of a write one manifest file ``manifest/<write>-<task>-<attempt>`` with a line ``url, retrieved, length, file,
  offset, content_type`` per page;
* per write one file ``commits/<write>`` that names its manifest files.

A write counts once its commit file stands, put there by one move after all tasks have ended; a task that ran twice or a
write that failed leaves files that nothing names.  Writes sort by their time, so "the last line of a url wins" holds
over all of them.  The reader takes one manifest file per partition and seeks to the places it names.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusmill.sources.files import _in_batches, filesystem, ranges_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLL_BYTES = 128 << 20
STORED = "url string, retrieved timestamp, length long, file string, offset long, content_type string, content binary"
COMMITS, MANIFEST = "commits", "manifest"


def _field(x: str | None) -> str:
    """A manifest field: white space that would end it is written as a URL does."""
    return "" if x is None else x.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _stamp(t: datetime | None) -> str:
    return "" if t is None else t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "+0000"


@dataclass
class Written(WriterCommitMessage):
    manifest: str | None


class PageFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int):
        self.path, self.roll = path.rstrip("/"), roll
        self.write_id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        task = f"{self.write_id}-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/{MANIFEST}")
        out, name, bucket, at, files, lines = None, "", None, 0, 0, None
        try:
            for batch in iterator:
                for b, url, retrieved, kind, content in zip(*(batch.column(c).to_pylist() for c in ("bucket", "url", "retrieved", "content_type", "content"))):
                    if out is None or b != bucket or at >= self.roll:
                        if out is not None:
                            out.close()
                        name, bucket, at, files = f"data_{b}_{task}_{files}", b, 0, files + 1
                        out = fs.open_output_stream(f"{root}/{name}")
                    if lines is None:
                        lines = fs.open_output_stream(f"{root}/{MANIFEST}/{task}")
                    data = content or b""
                    out.write(data)
                    place = (str(len(data)), name, str(at)) if content is not None else ("", "", "")
                    lines.write(("\t".join((_field(url), _stamp(retrieved), *place, _field(kind))) + "\n").encode())
                    at += len(data)
        finally:
            for f in (out, lines):
                if f is not None:
                    f.close()
        return Written(None if lines is None else task)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/{COMMITS}")
        names = sorted(m.manifest for m in messages if m is not None and m.manifest)
        with fs.open_output_stream(f"{root}/{MANIFEST}/{self.write_id}.commit") as f:
            f.write("\n".join(names).encode())
        fs.move(f"{root}/{MANIFEST}/{self.write_id}.commit", f"{root}/{COMMITS}/{self.write_id}")  # as a whole or not at all

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:  # their data files stay, named by nothing
            if m is not None and m.manifest:
                fs.delete_file(f"{root}/{MANIFEST}/{m.manifest}")


@dataclass
class ManifestFile(InputPartition):
    name: str


class PageFilesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[ManifestFile]:
        return [ManifestFile(n) for n in manifest_files(self.path)] or [ManifestFile("")]

    def read(self, partition: ManifestFile) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        schema = pa.schema([("url", pa.string()), ("retrieved", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("file", pa.string()),
                            ("offset", pa.int64()), ("content_type", pa.string()), ("content", pa.binary())])

        def pages() -> Iterator[tuple]:
            if not partition.name:
                return
            with fs.open_input_stream(f"{root}/{MANIFEST}/{partition.name}") as lines:
                rows = (line.split("\t") for line in _lines(lines))
                for name, group in groupby(rows, lambda r: r[3]):
                    if not name:
                        yield from ((r[0] or None, _time(r[1]), None, None, None, r[5] or None, None) for r in group)
                        continue
                    with fs.open_input_file(f"{root}/{name}") as f:
                        while part := [r for _, r in zip(range(4096), group)]:
                            for r, data in zip(part, ranges_of(f, [(int(r[4]), int(r[2])) for r in part])):
                                yield r[0] or None, _time(r[1]), int(r[2]), name, int(r[4]), r[5] or None, data

        return _in_batches(pages(), schema, 6)


def _time(x: str) -> datetime | None:
    return datetime.strptime(x, "%Y-%m-%dT%H:%M:%S.%f%z") if x else None


def _lines(stream: pa.NativeFile) -> Iterator[str]:
    rest = b""
    while data := stream.read(1 << 20):
        *whole, rest = (rest + data).split(b"\n")
        yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


class PageFiles(DataSource):
    """``spark.read.format("pagefiles").load(path)`` and ``df.write.format("pagefiles").mode("append").save(path)``.

    Written are columns ``bucket, url, retrieved, content_type, content`` in the order of each partition's rows, so rows
    should be sorted by bucket.  Option ``roll``: bytes after which a data file is closed.
    """

    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        return STORED

    def reader(self, schema) -> PageFilesReader:  # noqa: ARG002 - part of the interface
        return PageFilesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PageFilesWriter:  # noqa: ARG002
        if overwrite:
            raise ValueError("pagefiles can only be appended to")
        return PageFilesWriter(self.options["path"], int(self.options.get("roll", ROLL_BYTES)))


def manifest_files(path: str) -> list[str]:
    """Names of the manifest files of all complete writes, oldest write first."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    names = []
    for info in sorted(found, key=lambda i: i.base_name):
        with fs.open_input_file(info.path) as f:
            names += f.read().decode().split()
    return names


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)


def write_page_files(pages: DataFrame, path: str, roll: int = ROLL_BYTES) -> None:
    """Append ``(bucket, url, retrieved, content_type, content)`` rows, dealt by bucket and sorted in it."""
    register(pages.sparkSession)
    (pages.select("bucket", "url", "retrieved", "content_type", "content").write.format("pagefiles").mode("append")
     .option("roll", str(roll)).save(path))
