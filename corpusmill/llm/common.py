"""What the operators of this subpackage share: scratch tables and connected components."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, ensure_checkpoint_dir
from corpusmill.sources.files import filesystem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder, read as it lies."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (a cut in the lineage)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(arrays: Iterable[tuple[str, np.ndarray]], path: str) -> None:
    """Write named arrays as files of a new folder."""
    fs, root = filesystem(path)
    fs.create_dir(root)
    for name, a in arrays:
        with fs.open_output_stream(f"{root}/{name}.npy") as f:
            np.save(f, a)


def shared(path: str, names: list[str]) -> dict[str, np.ndarray]:
    """Arrays of ``share``: mapped where the folder is a mounted one, so that processes of a machine hold them once; else read."""
    fs, root = filesystem(path)
    if fs.type_name == "local":
        return {n: np.load(f"{root}/{n}.npy", mmap_mode="r") for n in names}
    out = {}
    for n in names:
        with fs.open_input_file(f"{root}/{n}.npy") as f:
            out[n] = np.load(io.BytesIO(f.read()))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the links ``(a, b)``: rows ``(node, component)``, the smallest node id.

    Alternating large-star and small-star steps: every step hangs neighbours on the smallest one,
    as one aggregate and one join per step, until nothing changes; the number of steps grows with
    the logarithm of the longest path.  Steps are checkpointed.  Nodes without links give no row;
    links of a node to itself and null ends are ignored.
    """
    e = (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = cut_lineage(e)
    before = None
    while True:
        # large star: every larger neighbour of u moves to u's smallest neighbour (or u itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = (both.where("v > u").join(low, "u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut_lineage(
            e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                    F.col("m").alias("v")).where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
