"""Claim and movie record JSON.

The reference writes one top-level JSON array over many lines; Spark reads that
with ``multiLine=True`` (one file per task).  The sink writes JSON lines, one
claim per line, which splits across tasks; the reader takes both.  Schemas are
explicit: sentence objects are ``map<string,string>`` (inference would make one
struct field per sentence id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CLAIM_SCHEMA = T.StructType([
    T.StructField("_debate_id", T.StringType()),
    T.StructField("_claim", T.StringType()),
    T.StructField("_is_opposing", T.StringType()),
    T.StructField("_argument_sentences", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_counter_sentences", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_debate_name", T.StringType()),
    T.StructField("_claim_id", T.StringType()),
])


def movie_schema(critics_as_map: bool = True) -> T.StructType:
    """The movie corpus record; the shape of ``_critics`` is configurable."""
    critics = (T.MapType(T.StringType(), T.StringType()) if critics_as_map
               else T.ArrayType(T.StringType()))
    return T.StructType([
        T.StructField("_movie_name", T.StringType()),
        T.StructField("_movie_id", T.StringType()),
        T.StructField("_critics", critics),
        T.StructField("_critic_consensus", T.StringType()),
    ])


def read_claims_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Claim records; a missing ``_counter_sentences`` field reads as null."""
    return (spark.read.schema(CLAIM_SCHEMA).option("multiLine", multi_line)
            .option("mode", "FAILFAST").json(path))


def read_movies_json(spark: SparkSession, path: str, critics_as_map: bool = True,
                     multi_line: bool = True) -> DataFrame:
    """Movie records (critics -> consensus)."""
    return (spark.read.schema(movie_schema(critics_as_map)).option("multiLine", multi_line)
            .option("mode", "FAILFAST").json(path))


def write_claims_json(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, every string properly escaped."""
    records.write.mode(mode).json(path)
