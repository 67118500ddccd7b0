"""Helpers that several operators share: reading a table, written intermediate tables, text expressions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.session import fresh_path

#: Characters between words, and the words themselves, in Java's notation.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    It cuts the lineage so that a lost executor costs no more than the step at hand, it gives later joins an
    exchange on both sides (which the engine can split where a key is hot), and it fixes row numbers for good.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD + "+"), 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_id(docs: DataFrame, name: str = "__row") -> DataFrame:
    """Adds a key of each row that stays the same whenever the table is read again.

    For tables in files that is the file and the place in it; any other frame is written first.
    """
    try:
        return docs.withColumn(name, F.concat_ws(":", F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        return stage(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "numbered")
