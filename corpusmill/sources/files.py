"""Bytes taken out of large files by place (S4, S5): ranges of data files and rows of Parquet files.

Only narrow rows that name places are shuffled; a task opens the files its places lie in and reads them in order, so
file contents go through no exchange.  Files are opened through ``pyarrow.fs`` (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import posixpath
import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Bytes that one task reads, that one read call takes, that may lie between two ranges of a call, and of an output batch.
TASK_BYTES, READ_BYTES, GAP_BYTES, BATCH_BYTES = 256 << 20, 8 << 20, 64 << 10, 8 << 20


def open_file(path: str) -> pa.NativeFile:
    """A file of a path or URI, for reading at any place."""
    fs, name = filesystem(path)
    return fs.open_input_file(name)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def tasks_for(rows: DataFrame, bytes_col: str, task_bytes: int = TASK_BYTES) -> int:
    """Tasks that share the bytes of ``rows`` evenly."""
    total = rows.agg(F.coalesce(F.sum(bytes_col), F.lit(0))).first()[0]
    return max(1, -(-int(total) // task_bytes))


def ranges_of(f: pa.NativeFile, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at rising ``(offset, length)`` of an open file; near ranges share a read call."""
    at = 0
    while at < len(places):
        start, end, last = places[at][0], sum(places[at]), at + 1
        while last < len(places) and places[last][0] - end <= GAP_BYTES and sum(places[last]) - start <= READ_BYTES:
            end = max(end, sum(places[last]))
            last += 1
        data = f.read_at(end - start, start)
        if len(data) < end - start:
            raise EOFError(f"bytes {start} to {end} asked for, the file ends at {start + len(data)}")
        for offset, length in places[at:last]:
            yield data[offset - start:offset - start + length]
        at = last


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, bytes_at: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_BYTES``; the value at ``bytes_at`` of a row counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[bytes_at] or b"")
        if size >= BATCH_BYTES or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _read_ranges(folder: str):
    schema = pa.schema([("url", pa.string()), ("content", pa.binary())])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "url"))))
        for name, places in groupby(rows, lambda r: r[0]):
            with open_file(posixpath.join(folder, name)) as f:
                while part := [p for _, p in zip(range(4096), places)]:
                    yield from zip((p[3] for p in part), ranges_of(f, [(p[1], p[2]) for p in part]))

    return lambda batches: _in_batches(contents(batches), schema, 1)


def read_ranges(places: DataFrame, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``url, content`` of ``places (url, file, offset, length)``; files are named below ``folder``.

    A place beyond its file's end fails; one without file, offset or length gives a null content.
    """
    known = F.col("file").isNotNull() & F.col("offset").isNotNull() & F.col("length").isNotNull()
    dealt = places.where(known).select("url", "file", "offset", "length")
    dealt = dealt.repartitionByRange(tasks_for(dealt, "length", task_bytes), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read_ranges(folder), "url string, content binary").unionByName(
        places.where(~known).select("url", F.lit(None).cast("binary").alias("content")))


def _read_rows(keep: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rows in groupby(range(b.num_rows), b.column("__f").to_pylist().__getitem__):
                at = list(rows)
                part = b.slice(at[0], len(at))
                place, done = part.column("__i").to_numpy(), 0
                with open_file(path) as f:
                    for first, values in _batches_with(pq.ParquetFile(f), column, place):
                        inside = place[done:done + np.searchsorted(place[done:], first + len(values))]
                        if len(inside):
                            taken = values.take(pa.array(inside - first))
                            yield pa.RecordBatch.from_arrays([*(part.column(c).slice(done, len(inside)) for c in keep), taken], [*keep, column])
                            done += len(inside)
                if done < len(place):
                    raise EOFError(f"{path} has no row {place[done]}")
    return run


def _batches_with(file: pq.ParquetFile, column: str, place: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, values)`` of the row groups that hold one of the rising ``place``, a few hundred rows at a time."""
    first = 0
    for g in range(file.num_row_groups):
        n = file.metadata.row_group(g).num_rows
        if np.searchsorted(place, first) < np.searchsorted(place, first + n):
            at = first
            for batch in file.iter_batches(batch_size=256, row_groups=[g], columns=[column]):
                yield at, batch.column(0)
                at += batch.num_rows
        first += n


def read_rows(places: DataFrame, column: str = "content", size: str = "length", task_bytes: int = TASK_BYTES) -> DataFrame:
    """``places`` without ``__f, __i`` and with a binary ``column``, read from row ``__i`` of Parquet file ``__f``.

    ``size`` names the column with the bytes of each row, by which the number of tasks is set.  Row groups without a row that
    is asked for are not read.
    """
    keep = [c for c in places.columns if c not in ("__f", "__i")]
    types = dict(places.dtypes)
    dealt = places.repartitionByRange(tasks_for(places, size, task_bytes), "__f", "__i").sortWithinPartitions("__f", "__i")
    return dealt.mapInArrow(_read_rows(keep, column), ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{column}` binary"]))
