"""Vector dictionary text files (S2, S3) and saved tables.

A line is ``word f1 ... fN``.  Line order is data: the dictionary id of a word
is its first position, while a repeated word keeps its last vector (dictionary
reassignment in the reference).  Positions come from the scan itself:
``(file, monotonically_increasing_id())`` sorts lines in file order, and a
distributed row number turns that into dense positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import ws_tokens
from corpusmill.operators.ranking import global_row_number
from corpusmill.session import cut_lineage


def read_lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """S3: lines of text files in ``charset`` (the charset is given, not detected)."""
    if charset.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        df = spark.read.text(path)
    else:
        df = (spark.read.option("encoding", charset).option("sep", "\u0000").option("quote", "")
              .option("escape", "").option("header", False).csv(path).toDF("value"))
    return (df.withColumn("__f", F.input_file_name())
            .withColumn("__l", F.monotonically_increasing_id()))


def read_vector_file(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """``(pos, word, vec array<float>)``, one row per distinct word.

    Only ``(file, line, word)`` is ranked and grouped; the vectors are joined to each word's last line.
    """
    lines = read_lines(spark, path, charset).withColumn("t", ws_tokens(F.col("value"))).filter(F.size("t") > 0)
    words = lines.select("__f", "__l", F.col("t")[0].alias("word"))
    at = F.struct("__f", "__l")
    places = cut_lineage(global_row_number(words, [F.col("__f"), F.col("__l")], "line").groupBy("word").agg(
        F.min("line").alias("pos"), F.max(at).alias("last")).select("word", "pos", "last.__f", "last.__l"))
    vec = F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x.cast("float"))
    return lines.select("__f", "__l", vec.alias("vec")).join(places, ["__f", "__l"]).select("pos", "word", "vec")


def write_vector_file(vectors: DataFrame, path: str, charset: str = "UTF-8") -> None:
    """Vector table ``(pos, word, vec)`` to text lines in ``pos`` order."""
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    lines = vectors.orderBy("pos").select(line.alias("value"))
    if charset.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        lines.write.mode("overwrite").text(path)
    else:
        (lines.write.mode("overwrite").option("encoding", charset).option("sep", "\u0000").option("quote", "")
         .option("escape", "").option("header", False).csv(path))


def save_table(df: DataFrame, path: str) -> None:
    """Vocabulary or vector table as Parquet."""
    df.write.mode("overwrite").parquet(path)
