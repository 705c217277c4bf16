"""Rows dealt by their id into buckets of a bounded size, and tables looked up bucket by bucket.

A bucket holds all rows of its ids and about ``BUCKET_BYTES`` of them, so there are more buckets, not larger ones, in a larger
table.  A lookup joins the different keys of each bucket with the table, not the items of every row; the rows themselves are
shuffled once, as texts where they are texts, and taken apart only within a task.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

BUCKET_BYTES = 16 << 20
BUCKET = "__bucket"
LEAST = 16  # buckets of a small table


def bucketed(df: DataFrame, id_col: str, weight: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``BUCKET``, partitioned by it; ``weight`` is about the bytes of a row."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    n = max(LEAST, int(total) // bucket_bytes + 1)
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")).repartition(BUCKET)


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Items of all lists, and the length of each (0 for null)."""
    lists = whole(lists)
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def numbered(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Different ids (null is one), and the number of each row's id among them."""
    coded = whole(ids).dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def places(lengths: np.ndarray) -> np.ndarray:
    """Place of each item in its list."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


SPLIT_BYTES = 2 << 20  # of texts whose words are Python strings at a time


def items_of(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Items of all lists, or the words between white space (``ws_tokens``) of all texts, and the number of each row's (0 for null)."""
    if pa.types.is_list(column.type):
        return flat(column)
    parts, counts = [pa.array([], pa.string())], [np.empty(0, dtype=np.int64)]
    for texts in column.chunks:
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SPLIT_BYTES
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(texts)] if len(texts) else [0]
        for a, b in zip(cuts, cuts[1:]):
            words = [t.split() if t else [] for t in texts[a:b].to_pylist()]
            parts.append(pa.array(list(chain.from_iterable(words)), pa.string()))
            counts.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    return pa.concat_arrays(parts), np.concatenate(counts)


def _different(cols: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        found = pc.unique(pa.chunked_array([items_of(rows[c])[0] for c in cols])).drop_null()
        return pa.table([pa.array(np.full(len(found), rows[BUCKET][0].as_py(), dtype=np.int32)), found], names=[BUCKET, "key"])
    return run


def met(rows: DataFrame, cols: list[str], table: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``function`` of each bucket of ``rows`` (as ``bucketed`` gives them) and the rows of ``table`` whose ``key`` is among the items of ``cols`` there.

    The different items of a bucket are joined with the table.  Both readers of ``rows`` take all their columns, so that one
    shuffle of the rows serves both.
    """
    kind = rows.schema[cols[0]].dataType
    spec = StructType([StructField(BUCKET, IntegerType()), StructField("key", kind.elementType if isinstance(kind, ArrayType) else StringType())])
    keys = rows.groupBy(BUCKET).applyInArrow(_different(cols), spec)
    found = keys.join(table, "key").select(F.col(BUCKET).alias("__of"), *table.columns)
    return rows.groupBy(BUCKET).cogroup(found.groupBy("__of")).applyInArrow(function, schema)


def _looker(id_col: str, cols: list[str], default, sep: str | None, over: str | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def look(rows: pa.Table, table: pa.Table) -> pa.Table:
        ids, group = numbered(rows[id_col])
        keys, values = whole(table["key"]), whole(table["value"])
        out = []
        for c in cols:
            items, lengths = items_of(rows[c])
            found = values.take(pc.index_in(items, value_set=keys))
            if default is not None:
                found = pc.fill_null(found, pa.scalar(default, values.type))
            if len(ids) < len(group):  # rows of one id become one list, by place and value
                owner = np.repeat(group, lengths)
                order = np.lexsort((pc.rank(found, tiebreaker="dense").to_numpy(), places(lengths), owner))
                found, lengths = found.take(pa.array(order)), np.bincount(owner, minlength=len(ids))
            ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), found)
            out.append(lists if sep is None else pc.binary_join(lists, sep))
        found = pa.table([ids, *out], names=[id_col, *cols])
        return found if over is None else found.filter(pa.array(np.bincount(group[whole(rows[over]).to_numpy(zero_copy_only=False)], minlength=len(ids)) == 0))
    return look


def looked_up(rows: DataFrame, id_col: str, cols: list[str], table: DataFrame, value_type: DataType, default, sep: str | None = None,
              over: str | None = None) -> DataFrame:
    """``(id_col, cols)``: the items of the array columns ``cols`` of ``rows`` (as ``bucketed`` gives them), or the words of text columns, replaced by the
    ``value`` of their ``key`` in ``table`` (different keys), or by ``default``; one row for each id.

    Items of rows with the same id are put together by place, then value.  With ``sep`` they are joined into a text.
    Ids of which a row is marked in the boolean column ``over`` give no row.
    """
    rows = rows.select(BUCKET, id_col, *cols, *([over] if over else []))
    result = ArrayType(value_type) if sep is None else StringType()
    schema = StructType([StructField(id_col, rows.schema[id_col].dataType), *[StructField(c, result) for c in cols]])
    return met(rows, cols, table.select("key", "value"), _looker(id_col, cols, default, sep, over), schema)
